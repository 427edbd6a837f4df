"""Chat messages: from turns to nested rows, and from nested rows to (system, prompt, chosen)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators.columns import drop_consumed
from pairloom.session import scratch_path, small_side, stage

BLOCK = 4096           # turns of one conversation that are put in order by one task
HOT_LISTED = 1000      # conversations above that size that are handled apart by name

# What is wrong with a conversation that cannot become a training pair.
NO_MESSAGES = "the conversation has no turns"
NO_USER = "nothing was said by the user"
NO_ASSISTANT = "nothing was said by the assistant"


def nest_turns(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role",
               content: str = "text", block: int = BLOCK, staged: bool = False) -> DataFrame:
    """One row per conversation with its `messages` in turn order, from a table with a row per turn.

    A conversation with more than `block` turns is first assembled in blocks that spread over many
    tasks; only its finished blocks meet, because the row they form is the result. The sizes come
    from a scan of the id column alone.

    `staged` writes the blocks as a table after one shuffle of the texts, dealt by conversation and block of turn
    numbers. What reads the result twice, such as the removal of duplicates, then shuffles no text again; only
    conversations of several blocks are put together on each reading.
    """
    rows = turns.select(F.col(id), F.col(turn).cast("long").alias("_t"),
                        F.struct(F.col(role).alias("role"), F.col(content).alias("content")).alias("_m"))
    if staged:
        return _from_blocks(stage(_blocks(rows, id, block), scratch_path(turns.sparkSession, "turns")), id)
    sizes = turns.groupBy(id).agg(F.count("*").alias("_n")).where(F.col("_n") > block)
    long_ids = [r[0] for r in sizes.select(id).limit(HOT_LISTED + 1).collect()]
    if not long_ids:
        return _collect_rows(rows, id)
    if len(long_ids) > HOT_LISTED:
        return _collect_blocks(rows, id, block)
    is_long = _listed(id, long_ids)
    return _collect_rows(rows.where(~is_long), id).unionByName(_collect_blocks(rows.where(is_long), id, block))


def _listed(id: str, ids: list) -> Column:
    return F.coalesce(F.col(id).isin([i for i in ids if i is not None]), F.lit(None in ids))


def _from_blocks(blocks: DataFrame, id: str) -> DataFrame:
    """Conversations of written blocks: most are one block and done; which are not, the column of ids tells."""
    several = blocks.groupBy(id).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select(F.col(id).alias("_long"))
    long_ids = [r[0] for r in several.limit(HOT_LISTED + 1).collect()]
    if len(long_ids) <= HOT_LISTED:
        single, parts = blocks.where(~_listed(id, long_ids)), blocks.where(_listed(id, long_ids))
    else:
        names = small_side(several)
        same = F.col(id).eqNullSafe(F.col("_long"))
        single, parts = blocks.join(names, same, "left_anti"), blocks.join(names, same, "left_semi")
    whole = single.select(id, F.col("_ms").alias("messages"))
    return whole.unionByName(_meet(parts, id)) if long_ids else whole


def _ordered(items: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(items)), lambda x: x["m"])


def _collect_rows(rows: DataFrame, id: str) -> DataFrame:
    return rows.groupBy(id).agg(_ordered(F.struct(F.col("_t").alias("t"), F.col("_m").alias("m"))).alias("messages"))


def _collect_blocks(rows: DataFrame, id: str, block: int) -> DataFrame:
    return _meet(_blocks(rows, id, block), id)


def _blocks(rows: DataFrame, id: str, block: int) -> DataFrame:
    return (rows.groupBy(id, F.expr(f"_t div {block}L").alias("_b"))
            .agg(_ordered(F.struct(F.col("_t").alias("t"), F.col("_m").alias("m"))).alias("_ms")))


def _meet(blocks: DataFrame, id: str) -> DataFrame:
    parts = F.struct(F.col("_b").alias("t"), F.col("_ms").alias("m"))
    return blocks.groupBy(id).agg(F.flatten(_ordered(parts)).alias("messages"))


def has_messages_format(df: DataFrame) -> bool:
    """Whether `messages` is a list of {role, content}, by schema alone; empty conversations are errors of their rows."""
    kind = df.schema["messages"].dataType if "messages" in df.columns else None
    return (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
            and {"role", "content"} <= set(kind.elementType.names))


def _of_role(messages: Column, role: str) -> Column:
    return F.filter(messages, lambda m: F.lower(m["role"]) == role)


def joined_role(messages: Column, role: str) -> Column:
    """All contents of one role, joined by blank lines; null content counts as empty text."""
    return F.array_join(F.transform(_of_role(messages, role), lambda m: F.coalesce(m["content"], F.lit(""))), "\n\n")


def _says_nothing(messages: Column, role: str) -> Column:
    """Whether the joined text of a role is empty, told without building it."""
    mine = _of_role(messages, role)
    only = F.coalesce(F.get(mine, F.lit(0))["content"], F.lit(""))
    return (F.size(mine) == 0) | ((F.size(mine) == 1) & (only == ""))


def messages_to_pair(messages: Column) -> dict[str, Column]:
    """system, prompt and chosen of a conversation; roles compare without case, unknown ones are skipped."""
    system, prompt, chosen = (F.coalesce(joined_role(messages, r), F.lit("")) for r in ("system", "user", "assistant"))
    return {"system": system, "prompt": prompt, "chosen": chosen}


def pair_error(messages: Column) -> Column:
    """Why a conversation makes no training pair; null when it does."""
    return (F.when(F.coalesce(F.size(messages), F.lit(0)) < 1, NO_MESSAGES)
            .when(_says_nothing(messages, "user"), NO_USER)
            .when(_says_nothing(messages, "assistant"), NO_ASSISTANT))


def handle_errors(df: DataFrame, on_error: str, error: str = "_error") -> DataFrame:
    """`fail` stops the job at the first bad row, `drop` leaves bad rows out, `quarantine` keeps the reason."""
    if on_error == "quarantine":
        return df
    if on_error == "drop":
        return df.where(F.col(error).isNull()).drop(error)
    if on_error == "fail":
        checked = F.when(F.col(error).isNull(), F.lit(True)).otherwise(F.raise_error(F.col(error)).cast("boolean"))
        return df.where(checked).drop(error)
    raise ValueError("on_error is 'fail', 'drop' or 'quarantine'")


def convert_messages(df: DataFrame, renderer=None, on_error: str = "fail") -> DataFrame:
    """Replace `messages` (and `tools`) by system, prompt and chosen; other columns stay.

    Plain conversations are converted by column expressions. Rows with tool schemas, calls or
    results are rendered by `renderer`, since their text form belongs to the target model.
    """
    from pairloom.functions.rendering import NEEDS_RENDERER, flatten_tools, row_has_tools

    messages, tooled = F.col("messages"), row_has_tools(df)
    pair = messages_to_pair(messages)
    if renderer is None:
        df = df.withColumns({**pair, "_tooled": tooled})
        tool_error = F.lit(NEEDS_RENDERER)
    else:
        df = df.withColumns({"_tooled": tooled, "_flat": flatten_tools(df, renderer)})
        df = df.withColumns({n: F.when(F.col("_tooled"), F.col(f"_flat.{n}")).otherwise(c) for n, c in pair.items()})
        tool_error = F.col("_flat.error")
    # An empty conversation is an error of its own, whatever schemas come with it.
    error = F.when(F.col("_tooled") & (F.size(messages) > 0), tool_error).otherwise(pair_error(messages))
    return drop_consumed(handle_errors(df.withColumn("_error", error).drop("_tooled", "_flat"), on_error))

"""Counts, lengths and row checks over a preference table; each is one distributed aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.operators.order import INTERNAL
from pairloom.functions.text import char_length, has_text, round_half_even, text_or_empty
from pairloom.operators.order import ORD

STAT_FIELDS = ("prompt", "chosen", "rejected", "system")
TOKEN_FIELDS = ("prompt", "chosen")


def length_histogram(df: DataFrame) -> DataFrame:
    """Rows per (field, length). Blank and null values count as length 0.

    The texts are read once and only small numbers leave the scan; the result has at most one row
    per field and distinct length, whatever the size of the table.
    """
    fields = [n for n in STAT_FIELDS if n in df.columns]
    if not fields:
        return df.sparkSession.createDataFrame([], "field string, length long, rows long")
    lengths = []
    for name in fields:
        value = F.col(name).cast("string")
        length = F.when(has_text(value), char_length(value)).otherwise(0).cast("long")
        lengths.append(F.struct(F.lit(name).alias("field"), length.alias("length")))
    return (df.select(F.explode(F.array(*lengths)).alias("l")).groupBy("l.field", "l.length")
            .agg(F.count("*").alias("rows")))


def field_stats(df: DataFrame, rounded: bool = False) -> DataFrame:
    """Per text field: average over non-empty values, extremes, upper median, empties, token estimate."""
    return stats_of(length_histogram(df), rounded)


def stats_of(histogram: DataFrame, rounded: bool = False) -> DataFrame:
    """The field statistics of a length histogram."""
    by_length = Window.partitionBy("field").orderBy("length")
    seen = F.sum("rows").over(by_length)
    stats = (histogram
             .withColumn("past_middle", seen > F.expr("sum(rows) OVER (PARTITION BY field) div 2"))
             .groupBy("field").agg(
                 F.sum("rows").alias("rows"),
                 (F.sum(F.col("length") * F.col("rows"))
                  / F.greatest(F.sum(F.when(F.col("length") > 0, F.col("rows")).otherwise(0)), F.lit(1))).alias("avg_length"),
                 F.min("length").alias("min_length"), F.max("length").alias("max_length"),
                 F.min(F.when(F.col("past_middle"), F.col("length"))).alias("median_length"),
                 F.sum(F.when(F.col("length") == 0, F.col("rows")).otherwise(0)).alias("empty_count"))
             .withColumn("est_avg_tokens", F.col("avg_length") / 4.0))
    if rounded:
        stats = stats.withColumns({"avg_length": round_half_even(F.col("avg_length"), 1),
                                   "est_avg_tokens": round_half_even(F.col("est_avg_tokens"), 0)})
    return stats


def total_tokens(df: DataFrame) -> DataFrame:
    """One row: the token estimate of prompts and answers, from the rounded per-field averages."""
    return tokens_of(length_histogram(df))


def tokens_of(histogram: DataFrame) -> DataFrame:
    """The token estimate of a length histogram."""
    stats = stats_of(histogram).where(F.col("field").isin(*TOKEN_FIELDS))
    per_field = round_half_even(F.col("est_avg_tokens"), 0) * (F.col("rows") - F.col("empty_count"))
    return stats.agg(F.coalesce(F.sum(per_field), F.lit(0.0)).alias("est_total_tokens"))


def length_balance(df: DataFrame, rounded: bool = False) -> DataFrame:
    """One row comparing chosen and rejected lengths.

    Averages cover non-empty values. `chosen_longer_pct` compares the two answers of one row, over
    the number of non-empty chosen answers.
    """
    c, r = F.col("chosen").cast("string"), F.col("rejected").cast("string")
    has_c, has_r = F.coalesce(c != "", F.lit(False)), F.coalesce(r != "", F.lit(False))
    sums = df.agg(
        F.coalesce(F.sum(F.when(has_c, char_length(c))), F.lit(0)).alias("c_chars"),
        F.coalesce(F.sum(F.when(has_r, char_length(r))), F.lit(0)).alias("r_chars"),
        F.count_if(has_c).alias("c_rows"), F.count_if(has_r).alias("r_rows"),
        F.count_if(has_c & has_r & (char_length(c) > char_length(r))).alias("longer"))
    one = F.lit(1)
    out = (sums.withColumns({
        "avg_chosen_length": F.col("c_chars") / F.greatest("c_rows", one),
        "avg_rejected_length": F.col("r_chars") / F.greatest("r_rows", one),
        "chosen_longer_pct": F.col("longer") / F.greatest("c_rows", one) * 100})
        .withColumn("ratio", F.col("avg_chosen_length") / F.greatest("avg_rejected_length", F.lit(1.0))))
    digits = {"avg_chosen_length": 1, "avg_rejected_length": 1, "ratio": 2, "chosen_longer_pct": 1}
    return out.select(*[(round_half_even(F.col(n), d) if rounded else F.col(n)).alias(n) for n, d in digits.items()])


def overview(df: DataFrame, mode: str) -> DataFrame:
    """One row: row count, column names and training mode."""
    names = F.array(*[F.lit(c) for c in df.columns if c not in INTERNAL])
    return df.agg(F.count("*").alias("total_rows")).withColumns({"columns": names, "training_mode": F.lit(mode)})


def _printed(df: DataFrame, name: str) -> Column:
    """The value as printed text: null reads `None` and so is not empty, a missing column is."""
    return F.coalesce(F.col(name).cast("string"), F.lit("None")) if name in df.columns else F.lit("")


def _checked_fields(mode: str, check_rejected: bool | None) -> list[str]:
    with_rejected = mode == "orpo" if check_rejected is None else check_rejected
    return ["prompt", "chosen", "rejected"] if with_rejected else ["prompt", "chosen"]


def validation_counts(df: DataFrame, max_prompt_length: int | None = None, max_chosen_length: int | None = None,
                      max_rejected_length: int | None = None, mode: str = "orpo",
                      check_rejected: bool | None = None) -> DataFrame:
    """One row of counters for empty and over-long fields; a falsy limit checks nothing."""
    limits = {"prompt": max_prompt_length, "chosen": max_chosen_length, "rejected": max_rejected_length}
    plural = {"prompt": "prompts", "chosen": "chosen", "rejected": "rejected"}
    checked = _checked_fields(mode, check_rejected)
    counters = [F.count("*").alias("total_samples")]
    for name, limit in limits.items():
        text = _printed(df, name)
        empty = ~has_text(text) if name in checked else F.lit(False)
        too_long = char_length(text) > limit if limit and name in checked else F.lit(False)
        counters += [F.count_if(empty).alias(f"empty_{plural[name]}"), F.count_if(too_long).alias(f"long_{plural[name]}")]
    return df.agg(*counters)


def validation_issues(df: DataFrame, mode: str = "orpo", ord: str = ORD,
                      check_rejected: bool | None = None) -> DataFrame:
    """A row per empty field: (ordinal, check number, message). Sort by the first two to read it in order."""
    wording = {"prompt": "prompt", "chosen": "chosen response", "rejected": "rejected response"}
    found = []
    for number, name in enumerate(_checked_fields(mode, check_rejected)):
        message = F.concat(F.lit("Row "), F.col(ord).cast("string"), F.lit(f": Empty {wording[name]}"))
        found.append(F.when(~has_text(_printed(df, name)), F.struct(F.lit(number).alias("check"), message.alias("issue"))))
    return (df.select(F.col(ord), F.explode(F.array_compact(F.array(*found))).alias("i"))
            .select(ord, "i.check", "i.issue"))


def row_has_reasoning(columns: list[str]) -> Column:
    """Whether a row carries reasoning: its own column, or a think block inside one of the texts."""
    found = has_text(F.col("reasoning").cast("string")) if "reasoning" in columns else F.lit(False)
    for name in ("prompt", "chosen", "rejected", "system"):
        if name in columns:
            text = text_or_empty(F.col(name))
            found = found | (text.contains("<think>") & text.contains("</think>"))
    return found


def fits_length(messages: Column, is_text: bool, max_seq_length: int = 4096) -> Column:
    """Whether a row is short enough, at four units to a token: characters of JSON text, or messages of a list."""
    return (F.length(messages) if is_text else F.size(messages)) <= max_seq_length * 4


def filter_long(df: DataFrame, max_seq_length: int = 4096, column: str = "messages") -> DataFrame:
    is_text = df.schema[column].dataType.typeName() == "string"
    return df.where(fits_length(F.col(column), is_text, max_seq_length))


def filter_report(df: DataFrame, max_seq_length: int = 4096, column: str = "messages") -> DataFrame:
    """One row: rows before the length filter, after it, and dropped by it."""
    is_text = df.schema[column].dataType.typeName() == "string"
    kept = F.count_if(fits_length(F.col(column), is_text, max_seq_length))
    return df.agg(F.count("*").alias("before"), kept.alias("after"), (F.count("*") - kept).alias("dropped"))


def step_plan(df: DataFrame, batch_size: int, accumulation: int, world_size: int, epochs: int,
              eval_steps: float | None) -> DataFrame:
    """One row: steps per epoch, total steps and the evaluation interval (below 1 it is a share of all steps)."""
    effective = batch_size * accumulation * world_size
    plan = (df.agg(F.ceil(F.count("*") / effective).cast("long").alias("steps_per_epoch"))
            .withColumn("total_steps", F.col("steps_per_epoch") * epochs))
    if not eval_steps:
        every = F.lit(None).cast("long")
    elif eval_steps < 1:
        every = F.greatest(F.lit(1), F.floor(F.col("total_steps") * F.lit(float(eval_steps)))).cast("long")
    else:
        every = F.lit(int(eval_steps)).cast("long")
    return plan.withColumn("eval_steps", every)

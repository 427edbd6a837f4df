"""Rendering by a model's own chat template.

A renderer is a picklable callable

    render(messages, tools=None, add_generation_prompt=False, enable_thinking=None) -> str

It runs in Arrow batches inside Spark's Python workers, and only for rows that need it: all other
rows pass as nulls. Everything a column expression can do stays outside.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.functions.templates import RowFormatter, from_columns, plain, reasoning_block, row_texts
from pairloom.operators.messages import NO_ASSISTANT, NO_USER

Renderer = Callable[..., str]
PIECE = 2 << 20   # bytes of rows that Python holds as objects at once

NEEDS_RENDERER = "The row uses tools; pass the target model's renderer to flatten it"


class ToolRenderError(ValueError):
    """A tool conversation cannot be written as plain texts without changing its rendering."""


class TokenizerRenderer:
    """Adapts an object with `apply_chat_template`; `has_template` tells whether it carries one."""

    def __init__(self, tokenizer: Any):
        self.tokenizer = tokenizer
        self.has_template = getattr(tokenizer, "chat_template", None) is not None

    def __call__(self, messages, tools=None, add_generation_prompt=False, enable_thinking=None):
        extra = {} if enable_thinking is None else {"enable_thinking": enable_thinking}
        return self.tokenizer.apply_chat_template(
            messages, tools=tools, tokenize=False, add_generation_prompt=add_generation_prompt, **extra)


class LazyRenderer:
    """Builds the renderer on first use in each Python worker instead of shipping it."""

    has_template = True

    def __init__(self, factory: Callable[[], Renderer]):
        self.factory, self._built = factory, None

    def __getstate__(self):
        return {"factory": self.factory, "_built": None}

    def __call__(self, *args, **kwargs):
        if self._built is None:
            self._built = self.factory()
        return self._built(*args, **kwargs)


# ---- tool calls: native columns ------------------------------------------------------------------

def _message_fields(df: DataFrame) -> list[str]:
    kind = df.schema["messages"].dataType if "messages" in df.columns else None
    nested = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)
    return kind.elementType.names if nested else []


def _filled(c: Column, kind: T.DataType) -> Column:
    full = F.size(c) > 0 if isinstance(kind, (T.ArrayType, T.MapType)) else c.cast("string") != ""
    return F.coalesce(full, F.lit(False))


def row_has_tools(df: DataFrame) -> Column:
    """Whether a row carries tool schemas, a tool call or a tool result."""
    found = _filled(F.col("tools"), df.schema["tools"].dataType) if "tools" in df.columns else F.lit(False)
    fields = _message_fields(df)
    if fields:
        calls = "tool_calls" in fields
        kind = df.schema["messages"].dataType.elementType
        found = found | F.coalesce(F.exists("messages", lambda m: (
            F.coalesce(m["role"] == "tool", F.lit(False))
            | (_filled(m["tool_calls"], kind["tool_calls"].dataType) if calls else F.lit(False)))), F.lit(False))
    return found


def dataset_has_tools(df: DataFrame) -> bool:
    """Whether a table is a tool-calling one: a `tools` column, or any row with tools."""
    if "tools" in df.columns:
        return True
    if not _message_fields(df) or df.isStreaming:
        return False
    return not df.where(row_has_tools(df)).select(F.lit(1)).isEmpty()


def normalise_calls(calls: Column, element: T.StructType) -> Column:
    """Tool calls as (name, arguments): the function wrapper removed and JSON text parsed.

    Text that is not JSON stays text; missing arguments become an empty object.
    """
    wrapped = "function" in element.names
    inner = element["function"].dataType if wrapped else element
    kind = inner["arguments"].dataType

    def one(call: Column) -> Column:
        fn = call["function"] if wrapped else call
        args = fn["arguments"]
        if isinstance(kind, T.StringType):
            value = F.coalesce(F.try_parse_json(args), args.cast("variant"))
        elif isinstance(kind, T.VariantType):
            value = args
        else:
            value = F.to_variant_object(args)
        return F.struct(fn["name"].alias("name"), F.coalesce(value, F.parse_json(F.lit("{}"))).alias("arguments"))

    return F.transform(calls, one)


# ---- tool calls: what Python gets --------------------------------------------------------------------

def _json(c: Column) -> Column:
    """A text as a JSON string, null as `null`."""
    listed = F.to_json(F.array(c.cast("string")))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _call_json(call: Column, element: T.StructType) -> Column:
    """One call as the JSON a template expects. Argument text that is JSON goes in as it stands, so its keys keep their order."""
    wrapped = "function" in element.names
    fn = call["function"] if wrapped else call
    kind = (element["function"].dataType if wrapped else element)["arguments"].dataType
    args = fn["arguments"]
    if isinstance(kind, T.StringType):
        parsed = F.try_parse_json(args)
        text = F.when(parsed.isNull(), _json(args)).when(~F.is_variant_null(parsed), args)
    else:
        text = F.to_json(args)
    return F.concat(F.lit('{"type":"function","function":{"name":'), _json(fn["name"]), F.lit(',"arguments":'),
                    F.coalesce(F.when(args.isNotNull(), text), F.lit("{}")), F.lit("}}"))


def _turn_json(df: DataFrame, m: Column) -> Column:
    """One message in normal form: lower-case role, content never null, calls only where there are some."""
    kind = df.schema["messages"].dataType.elementType
    calls = F.lit("")
    if "tool_calls" in kind.names and isinstance(kind["tool_calls"].dataType, T.ArrayType):
        element = kind["tool_calls"].dataType.elementType
        listed = F.array_join(F.transform(m["tool_calls"], lambda c: _call_json(c, element)), ",")
        calls = F.when(_filled(m["tool_calls"], kind["tool_calls"].dataType), F.concat(F.lit(',"tool_calls":['), listed, F.lit("]"))).otherwise("")
    return F.concat(F.lit('{"role":'), _json(F.lower(m["role"])), F.lit(',"content":'), _json(F.coalesce(m["content"], F.lit(""))), calls, F.lit("}"))


# ---- tool calls: per-row rendering -----------------------------------------------------------------

class TurnFrames:
    """What a template puts around the content of a plain turn, learned once for each role.

    The frame of a role is the text before and after a mark that stands as the content. `content_like` returns the content
    with which a plain turn of that role renders like another turn does; so for every turn t that it accepts,
    frame + content_like(t) + frame is the template's own text of t.
    """

    MARK, OPENING = "PAIRLOOM-MARK-5C7E", {"role": "user", "content": "PAIRLOOM-OPENING-5C7E"}

    def __init__(self, render: Renderer):
        self.render, self.known = render, {}

    def scene(self, turn: dict) -> list[dict]:
        """A chat that any template accepts: with a user turn, and the system turn first."""
        return [turn, self.OPENING] if turn["role"] == "system" else [self.OPENING, turn]

    def frame(self, role: str) -> tuple[str, str]:
        if role not in self.known:
            parts = self.render(self.scene({"role": role, "content": self.MARK})).split(self.MARK)
            if len(parts) != 2:
                raise ToolRenderError(f"the template shows the content of a {role} turn {len(parts) - 1} times, not once")
            self.known[role] = tuple(parts)
        return self.known[role]

    def content_like(self, turn: dict, role: str, tools: Any = None) -> str:
        head, tail = self.frame(role)
        text = self.render(self.scene(turn), tools=tools)
        inner = text.removeprefix(head).removesuffix(tail) if len(text) >= len(head) + len(tail) else text
        if head + inner + tail != text:
            raise ToolRenderError(f"a {turn['role']} turn does not fit into the frame of a plain {role} turn")
        return inner


def _turn_texts(frames: TurnFrames, turns: list[dict], system: str, tools: Any) -> tuple[list[str], str]:
    """The plain text of every turn, and the system text with the tools in it."""
    plain = {"assistant": "assistant", "tool": "user"}   # whose frame a turn must fit into
    texts = [frames.content_like(t, plain[t["role"]]) if t["role"] in plain else t["content"] for t in turns]
    return texts, frames.content_like({"role": "system", "content": system}, "system", tools) if tools else system


_TEXTS = "texts array<string>, system string, error string"


def _texts_udf(renderer: Renderer):
    @F.pandas_udf(_TEXTS)
    def texts(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        frames = TurnFrames(renderer)
        for columns in batches:
            out = []
            for turns, system, tools in zip(*columns, strict=True):
                if turns is None:
                    out.append((None, None, None))
                    continue
                try:
                    out.append((*_turn_texts(frames, [json.loads(t) for t in turns], system, json.loads(tools) if tools else None), None))
                except Exception as e:  # noqa: BLE001 - a bad row becomes data; on_error decides what to do with it
                    out.append((None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["texts", "system", "error"], dtype=object)

    return texts


def _survives_udf(renderer: Renderer):
    @F.pandas_udf("boolean")
    def survives(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            out = []
            for turns, tools, system, prompt, chosen, error in zip(*columns, strict=True):
                if turns is None or error is not None:
                    out.append(None if turns is None else False)
                    continue
                flat = [("system", system)] * bool(system) + [("user", prompt), ("assistant", chosen)]
                try:
                    whole = renderer([json.loads(t) for t in turns], tools=json.loads(tools) if tools else None)
                    out.append(renderer([{"role": r, "content": c} for r, c in flat]) == whole)
                except Exception:  # noqa: BLE001 - what cannot be rendered does not survive
                    out.append(False)
            yield pd.Series(out, dtype=object)

    return survives


def _tools_json(df: DataFrame) -> Column:
    if "tools" not in df.columns:
        return F.lit(None).cast("string")
    kind = df.schema["tools"].dataType
    return F.when(_filled(F.col("tools"), kind), F.col("tools") if isinstance(kind, T.StringType) else F.to_json("tools"))


def flatten_tools(df: DataFrame, renderer: Renderer, audit: bool = False) -> Column:
    """A struct (system, prompt, chosen, error, survives) for rows with tools, null for all others.

    Python only renders; messages reach it in normal form, and the texts it returns are joined here. Empty texts are left out
    of the joins. `survives` is filled by an audit.
    """
    tooled, messages = row_has_tools(df), F.coalesce(F.col("messages"), F.array().cast(df.schema["messages"].dataType))
    role = lambda m: F.coalesce(F.lower(m["role"]), F.lit(""))
    told = F.filter(messages, lambda m: role(m).isin("user", "assistant", "tool"))
    said = F.filter(messages, lambda m: (role(m) == "system") & (F.coalesce(m["content"], F.lit("")) != ""))
    system = F.array_join(F.transform(said, lambda m: m["content"]), "\n\n")
    tools = _tools_json(df)
    texts = _texts_udf(renderer)(F.when(tooled, F.transform(told, lambda m: _turn_json(df, m))), system, tools)

    def side(t: Column, assistant: bool) -> Column:
        mine = F.zip_with(told, t["texts"], lambda m, x: F.when((role(m) == "assistant") == F.lit(assistant), F.nullif(x, F.lit(""))))
        return F.array_join(mine, "\n\n")   # nulls are left out

    def joined(t: Column) -> Column:
        prompt, chosen = side(t, False), side(t, True)
        error = F.coalesce(t["error"], F.when(prompt == "", NO_USER).when(chosen == "", NO_ASSISTANT))
        good = lambda c: F.when(error.isNull(), c)
        return F.struct(good(t["system"]).alias("system"), good(prompt).alias("prompt"), good(chosen).alias("chosen"), error.alias("error"))

    flat = joined(texts)
    if not audit:
        survives = F.lit(None).cast("boolean")
    else:
        whole = F.when(tooled, F.transform(messages, lambda m: _turn_json(df, m)))
        survives = _survives_udf(renderer)(whole, tools, flat["system"], flat["prompt"], flat["chosen"], flat["error"])
    parts = [flat[n].alias(n) for n in ("system", "prompt", "chosen", "error")]
    return F.when(tooled, F.struct(*parts, survives.alias("survives")))


def audit_tools(df: DataFrame, renderer: Renderer) -> DataFrame:
    """Rows with tools, with `survives`: does the flat form render back byte for byte?"""
    tooled = df.where(row_has_tools(df))
    return tooled.withColumn("_flat", flatten_tools(tooled, renderer, audit=True)).select(
        *df.columns, F.col("_flat.survives").alias("survives"), F.col("_flat.error").alias("error"))


def audit_report(df: DataFrame, renderer: Renderer) -> DataFrame:
    """Rows per audit outcome over the whole table."""
    return audit_tools(df, renderer).groupBy("survives").agg(F.count("*").alias("rows"))


# ---- formatting by the template --------------------------------------------------------------------

def pieces(columns: tuple[pa.Array, ...], size: int = PIECE) -> Iterator[list[pa.Array]]:
    """Consecutive rows of an Arrow batch, of about `size` bytes at a time: Python holds no more of them as objects."""
    rows = len(columns[0])
    step = max(1, int(size * rows / max(sum(c.nbytes for c in columns), 1)))
    for i in range(0, rows, step):
        yield [c.slice(i, step) for c in columns]


def _attempt(render: Renderer, turns: list[tuple[str, str]], **options: Any) -> str | None:
    """The rendered chat, None where the template refuses it."""
    try:
        return render([{"role": r, "content": c} for r, c in turns], **options)
    except Exception:  # noqa: BLE001 - templates raise what they like
        return None


def _by_template(render: Renderer, system: str, prompt: str, thinking: bool, answers: list[str]) -> tuple[str, list[str], bool]:
    """The prompt, what each answer adds to it by length, and whether some full text does not begin with the prompt."""
    turns = [(r, c) for r, c in (("system", system), ("user", prompt)) if r == "user" or c.strip()]
    shown = _attempt(render, turns, add_generation_prompt=True, enable_thinking=thinking)
    if shown is None:   # the plain layout stands in
        shown = "\n\n".join(c for _, c in turns) + "\n"
    full = [_attempt(render, [*turns, ("assistant", a)], enable_thinking=thinking) for a in answers]
    added = [a if f is None else f[len(shown):] for a, f in zip(answers, full)]
    return shown, added, any(f is not None and not f.startswith(shown) for f in full)


def template_formatter(renderer: Renderer, enable_thinking: bool = True, auto_detect_thinking: bool = True,
                       on_mismatch: str = "slice") -> RowFormatter:
    """Format rows with the target model's template.

    An answer is what the full rendering adds to the prompt rendering, by length. A template whose
    prompt is no prefix of the full text would give a wrong answer: with `on_mismatch='quarantine'`
    such rows get a reason in `_error`.
    """
    from pairloom.operators.quality import row_has_reasoning

    if not getattr(renderer, "has_template", True):
        return from_columns("tokenizer", plain, has_chat_template=False)
    if on_mismatch not in ("slice", "quarantine"):
        raise ValueError("on_mismatch is 'slice' or 'quarantine'")

    shape = pa.struct([("prompt", pa.string()), ("answers", pa.list_(pa.string())), ("cut_off", pa.bool_())])

    @F.arrow_udf("prompt string, answers array<string>, cut_off boolean")
    def rendered(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            for part in pieces(columns):
                rows = [_by_template(renderer, s, p, bool(t), a) for s, p, t, a in zip(*(c.to_pylist() for c in part), strict=True)]
                yield pa.array(rows, shape)

    def apply(df: DataFrame) -> DataFrame:
        r = row_texts(df.columns)
        think = reasoning_block(r)
        thinking = row_has_reasoning(df.columns) if auto_detect_thinking else F.lit(bool(enable_thinking))
        answers = F.array(F.concat(think, r["chosen"]), F.concat(think, r["rejected"]))
        out = df.withColumn("_t", rendered(r["system"], r["prompt"], thinking, answers))
        out = out.withColumn("_r", F.struct(F.col("_t.prompt").alias("prompt"), F.col("_t.answers")[0].alias("chosen"),
                                            F.col("_t.answers")[1].alias("rejected"), F.col("_t.cut_off").alias("cut_off"))).drop("_t")
        out = out.withColumns({n: F.col(f"_r.{n}") for n in ("prompt", "chosen", "rejected")})
        if on_mismatch == "quarantine":
            out = out.withColumn("_error", F.when(F.col("_r.cut_off"), F.lit("template prompt is no prefix of the full text")))
        return out.drop("_r")

    return RowFormatter("tokenizer", apply, {"format_type": "tokenizer", "has_chat_template": True})


def batch_formatter(name: str, fn: Callable[[pd.DataFrame], pd.DataFrame]) -> RowFormatter:
    """A formatter of your own in Python: `fn` maps a batch of input columns, a few megabytes of rows, to prompt, chosen, rejected."""
    names = ["prompt", "chosen", "rejected"]
    shape = pa.schema([(n, pa.string()) for n in names])

    @F.arrow_udf("prompt string, chosen string, rejected string")
    def formatted(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            for part in pieces(columns):
                batch = pd.concat([c.to_pandas() for c in part], axis=1, keys=["system", "prompt", "chosen", "rejected", "reasoning"])
                yield pa.RecordBatch.from_pandas(fn(batch)[names], shape, preserve_index=False).to_struct_array()

    def apply(df: DataFrame) -> DataFrame:
        r = row_texts(df.columns)
        out = df.withColumn("_f", formatted(*r.values()))
        return out.withColumns({n: F.col(f"_f.{n}") for n in ("prompt", "chosen", "rejected")}).drop("_f")

    return RowFormatter(name, apply, {"format_type": name})

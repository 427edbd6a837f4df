"""Chat templates as column expressions.

A row formatter maps the preference columns (system, prompt, chosen, rejected, reasoning) to the
three formatted ones. A conversation renderer turns a `messages` array into one string.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from string import Formatter as _Braces
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import has_text, text_or_empty

# The marker strings of each template family.
CHATML_OPEN, CHATML_CLOSE = "<|im_start|>", "<|im_end|>\n"
LLAMA3_BEGIN, LLAMA3_CLOSE = "<|begin_of_text|>", "<|eot_id|>"
LLAMA3_HEADER = "<|start_header_id|>{role}<|end_header_id|>\n\n"
INST_OPEN, INST_CLOSE = "[INST] ", " [/INST]"
THINK_OPEN, THINK_CLOSE = "<think>\n", "\n</think>\n\n"

_INPUTS = ("system", "prompt", "chosen", "rejected", "reasoning")
_OUTPUTS = ("prompt", "chosen", "rejected")

Columns = Mapping[str, Column]


def row_texts(columns: list[str]) -> dict[str, Column]:
    """The formatter inputs of a table; a missing column reads as the empty string."""
    return {n: text_or_empty(F.col(f"`{n}`")) if n in columns else F.lit("") for n in _INPUTS}


def _chatml_turn(role: str, text: Column) -> Column:
    return F.concat(F.lit(f"{CHATML_OPEN}{role}\n"), text, F.lit(CHATML_CLOSE))


def _optional(condition: Column, text: Column) -> Column:
    return F.when(condition, text).otherwise(F.lit(""))


def _chatml_prompt(r: Columns, tail: str = "") -> Column:
    return F.concat(
        _optional(has_text(r["system"]), _chatml_turn("system", r["system"])),
        _chatml_turn("user", r["prompt"]),
        F.lit(f"{CHATML_OPEN}assistant\n{tail}"),
    )


def chatml(r: Columns) -> dict[str, Column]:
    return {
        "prompt": _chatml_prompt(r),
        "chosen": F.concat(r["chosen"], F.lit(CHATML_CLOSE)),
        "rejected": F.concat(r["rejected"], F.lit(CHATML_CLOSE)),
    }


def _llama3_turn(role: str, text: Column) -> Column:
    return F.concat(F.lit(LLAMA3_HEADER.format(role=role)), text, F.lit(LLAMA3_CLOSE))


def llama3(r: Columns) -> dict[str, Column]:
    return {
        "prompt": F.concat(
            F.lit(LLAMA3_BEGIN),
            _optional(has_text(r["system"]), _llama3_turn("system", r["system"])),
            _llama3_turn("user", r["prompt"]),
            F.lit(LLAMA3_HEADER.format(role="assistant")),
        ),
        "chosen": F.concat(r["chosen"], F.lit(LLAMA3_CLOSE)),
        "rejected": F.concat(r["rejected"], F.lit(LLAMA3_CLOSE)),
    }


def mistral(r: Columns) -> dict[str, Column]:
    lead = _optional(has_text(r["system"]), F.concat(r["system"], F.lit("\n\n")))
    return {
        "prompt": F.concat(F.lit(INST_OPEN), lead, r["prompt"], F.lit(INST_CLOSE + " ")),
        "chosen": r["chosen"],
        "rejected": r["rejected"],
    }


def reasoning_block(r: Columns) -> Column:
    """The reasoning wrapped in think tags, or nothing when there is none."""
    return _optional(has_text(r["reasoning"]), F.concat(F.lit(THINK_OPEN), r["reasoning"], F.lit(THINK_CLOSE)))


def qwen3(r: Columns, enable_thinking: bool = True) -> dict[str, Column]:
    think = reasoning_block(r)
    return {
        "prompt": _chatml_prompt(r, "" if enable_thinking else THINK_OPEN + THINK_CLOSE),
        "chosen": F.concat(think, r["chosen"], F.lit(CHATML_CLOSE)),
        "rejected": F.concat(think, r["rejected"], F.lit(CHATML_CLOSE)),
    }


def raw(r: Columns) -> dict[str, Column]:
    return {n: r[n] for n in _OUTPUTS}


def plain(r: Columns) -> dict[str, Column]:
    """What a model without a chat template gets: system, blank line, prompt, newline."""
    lead = _optional(has_text(r["system"]), F.concat(r["system"], F.lit("\n\n")))
    think = reasoning_block(r)
    return {
        "prompt": F.concat(lead, r["prompt"], F.lit("\n")),
        "chosen": F.concat(think, r["chosen"]),
        "rejected": F.concat(think, r["rejected"]),
    }


def braces(template: str, values: Columns) -> Column:
    """A `{name}` template as one concat; `{{` and `}}` are literal braces."""
    parts: list[Column] = []
    for literal, name, spec, conversion in _Braces().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is None:
            continue
        if name not in values:
            raise ValueError(f"template names {name!r}; it may use {sorted(values)}")
        if spec or conversion:
            raise ValueError(f"template field {name!r} takes no format spec or conversion")
        parts.append(values[name])
    return F.concat(*parts) if parts else F.lit("")


def custom(r: Columns, templates: Mapping[str, str]) -> dict[str, Column]:
    """User templates: the prompt one may use system and prompt, the others only their own field."""
    return {
        "prompt": braces(templates.get("prompt_template", "{prompt}"),
                         {"system": r["system"], "prompt": r["prompt"]}),
        "chosen": braces(templates.get("chosen_template", "{chosen}"), {"chosen": r["chosen"]}),
        "rejected": braces(templates.get("rejected_template", "{rejected}"), {"rejected": r["rejected"]}),
    }


@dataclass(frozen=True)
class RowFormatter:
    """A named formatter: `apply` overwrites prompt, chosen and rejected and keeps all else."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    info: dict[str, Any] = field(default_factory=dict)

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.apply(df)


def from_columns(name: str, build: Callable[[Columns], Mapping[str, Column]], **info: Any) -> RowFormatter:
    """A formatter made of column expressions; the way to add one of your own."""
    return RowFormatter(name, lambda df: df.withColumns(dict(build(row_texts(df.columns)))),
                        {"format_type": name, **info})


_DESCRIPTIONS = {
    "chatml": "system, user and assistant turns between im_start and im_end markers",
    "llama3": "turns under header markers, closed by eot_id",
    "mistral": "instruction between INST markers, system text in front of the prompt",
    "raw": "the columns as they are, without a chat template",
}


def formatter(format_type: str, *, custom_templates: Mapping[str, str] | None = None,
              renderer: Any = None, enable_thinking: bool | None = None,
              auto_detect_thinking: bool = True, on_mismatch: str = "slice") -> RowFormatter:
    """The formatter of a format name; names are case-insensitive and `none` means `raw`."""
    kind = format_type.lower()
    kind = "raw" if kind == "none" else kind
    thinking = True if enable_thinking is None else enable_thinking
    if kind in ("chatml", "llama3", "mistral", "raw"):
        build = {"chatml": chatml, "llama3": llama3, "mistral": mistral, "raw": raw}[kind]
        return from_columns(kind, build, description=_DESCRIPTIONS[kind])
    if kind == "qwen3":
        return from_columns(kind, lambda r: qwen3(r, thinking), enable_thinking=thinking,
                            description=f"chatml turns with think tags (thinking {'on' if thinking else 'off'})")
    if kind == "custom":
        if not custom_templates:
            raise ValueError("format 'custom' needs custom_templates")
        return from_columns(kind, lambda r: custom(r, custom_templates), **custom_templates)
    if kind == "tokenizer":
        if renderer is None:
            raise ValueError("format 'tokenizer' needs a renderer")
        from pairloom.functions.rendering import template_formatter

        return template_formatter(renderer, thinking, auto_detect_thinking, on_mismatch)
    raise ValueError(f"unknown format {format_type!r}: use chatml, llama3, mistral, qwen3, tokenizer, custom or raw")


def _each(messages: Column, turn: Callable[[Column, Column], Column]) -> Column:
    """Render every message with `turn(role, content)` and string the results together."""
    def one(m: Column) -> Column:
        return turn(F.coalesce(m["role"], F.lit("")), F.coalesce(m["content"], F.lit("")))
    return F.array_join(F.transform(messages, one), "")


def render_chatml(messages: Column, add_generation_prompt: bool = False) -> Column:
    body = _each(messages, lambda role, text: F.concat(
        F.lit(CHATML_OPEN), role, F.lit("\n"), text, F.lit(CHATML_CLOSE)))
    return F.concat(body, F.lit(f"{CHATML_OPEN}assistant\n")) if add_generation_prompt else body


def render_llama3(messages: Column, add_generation_prompt: bool = False,
                  bos_token: str = LLAMA3_BEGIN) -> Column:
    head, tail = LLAMA3_HEADER.split("{role}")
    body = F.concat(F.lit(bos_token), _each(messages, lambda role, text: F.concat(
        F.lit(head), role, F.lit(tail), text, F.lit(LLAMA3_CLOSE))))
    return F.concat(body, F.lit(LLAMA3_HEADER.format(role="assistant"))) if add_generation_prompt else body


def render_mistral(messages: Column, bos_token: str = "<s>", eos_token: str = "</s>") -> Column:
    """A leading system turn goes in front of everything; other roles than user and assistant vanish."""
    first = F.get(messages, F.lit(0))
    lead = F.when(first["role"] == "system", F.concat(F.coalesce(first["content"], F.lit("")), F.lit("\n\n")))
    body = _each(messages, lambda role, text: F.when(
        role == "user", F.concat(F.lit(INST_OPEN), text, F.lit(INST_CLOSE))
    ).when(role == "assistant", F.concat(F.lit(" "), text, F.lit(eos_token))).otherwise(F.lit("")))
    return F.concat(F.lit(bos_token), F.coalesce(lead, F.lit("")), body)


_RENDERERS = {"chatml": render_chatml, "llama3": render_llama3, "mistral": render_mistral, "qwen3": render_chatml}


def conversation_renderer(format_type: str) -> Callable[..., Column] | None:
    """The whole-conversation renderer of a format; None for raw, custom and tokenizer."""
    return _RENDERERS.get(format_type.lower())


def describe_formats() -> dict[str, dict[str, Any]]:
    """Descriptor of every format that needs no arguments."""
    return {n: formatter(n).info for n in ("chatml", "llama3", "mistral", "qwen3", "raw")}

"""Column names: mapping, synonyms, required sets, the system prompt."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import is_blank

# The names each standard column is known by, most specific first.
SYNONYMS = {
    "prompt": ("prompt", "instruction", "question"),
    "chosen": ("chosen", "output", "response", "answer"),
    "rejected": ("rejected",),
    "system": ("system", "system_prompt"),
    "reasoning": ("reasoning", "thinking", "thought", "think"),
}

# Modes that train on (prompt, chosen) alone; every other mode compares two answers.
UNPAIRED_MODES = ("sft", "kto")
PAIRED_MODES = ("orpo", "dpo", "simpo", "cpo", "ipo")


class SchemaError(ValueError):
    """The table lacks a required column or a mapping is contradictory."""


def suggest_mapping(columns: Iterable[str]) -> dict[str, str]:
    """Mapping from a table's own names to the standard ones, by synonym and ignoring case."""
    by_lower = {c.lower(): c for c in columns}
    found = {}
    for target, names in SYNONYMS.items():
        source = next((by_lower[n] for n in names if n in by_lower), None)
        if source is not None and source != target:
            found[source] = target
    return found


def rename(df: DataFrame, mapping: Mapping[str, str] | None) -> DataFrame:
    """Rename columns one entry after the other; absent names are skipped, collisions refused."""
    names = list(df.columns)
    for old, new in (mapping or {}).items():
        if old == new or old not in names:
            continue
        if new in names:
            raise SchemaError(f"cannot rename {old!r} to {new!r}: the table already has {new!r}")
        names[names.index(old)] = new
    return df.toDF(*names) if names != df.columns else df


def required_columns(mode: str) -> set[str]:
    return {"prompt", "chosen"} if mode in UNPAIRED_MODES else {"prompt", "chosen", "rejected"}


def check_columns(df: DataFrame, mode: str = "orpo", required: Iterable[str] | None = None) -> DataFrame:
    """Raise before any job runs when a column the mode needs is missing."""
    needed = set(required) if required is not None else required_columns(mode)
    missing = sorted(needed - set(df.columns))
    if missing:
        raise SchemaError(f"missing columns {missing}; the table has {df.columns}. Map its columns first.")
    return df


def set_system(df: DataFrame, prompt: str | None, mode: str = "fill_empty") -> DataFrame:
    """Give rows a system prompt: only those without one, or all of them (`replace_all`)."""
    if not prompt:
        return df
    if mode == "replace_all" or "system" not in df.columns:
        return df.withColumn("system", F.lit(prompt))
    current = F.col("system").cast("string")
    return df.withColumn("system", F.when(is_blank(current), F.lit(prompt)).otherwise(current))


def drop_consumed(df: DataFrame) -> DataFrame:
    """Drop the columns that conversion has used up."""
    return df.drop("messages", "tools")

"""Row-multiplying and set operators: concatenation of sources and the unpaired preference form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import has_text
from pairloom.operators.order import ORD

SOURCE_BITS = 55            # an ordinal leaves this many bits for the position inside one source
MAX_SOURCES = 2**8


def place_source(df: DataFrame, position: int, ord: str = ORD) -> DataFrame:
    """Make a source's ordinals sort after those of all sources with a lower position.

    They must be from 0 to 2**55 - 1; another one stops the job, since it would collide with a neighbour's.
    """
    if not 0 <= position < MAX_SOURCES:
        raise ValueError(f"at most {MAX_SOURCES} sources can be concatenated")
    fits = F.col(ord).between(0, 2**SOURCE_BITS - 1) | F.col(ord).isNull()
    wrong = F.raise_error(F.concat(F.lit("ordinal out of range: "), F.col(ord).cast("string"))).cast("long")
    return df.withColumns({ord: F.when(fits, F.col(ord) + F.lit(position << SOURCE_BITS)).otherwise(wrong), "_src": F.lit(position)})


def concat_sources(sources: Sequence[DataFrame], ord: str = ORD) -> DataFrame:
    """All rows of all sources, the first source first; a column one side lacks is null there."""
    placed = [place_source(df, i, ord) for i, df in enumerate(sources)]
    out = placed[0]
    for extra in placed[1:]:
        out = out.unionByName(extra, allowMissingColumns=True)
    return out


def kto_explode(df: DataFrame, rejected_source: str = "rejected", keep: Sequence[str] = ()) -> DataFrame:
    """Unpaired examples (prompt, response, label): every chosen answer, and every rejected one with text.

    One scan, one explode. `rejected_source` names the column tested for text; formatted answers
    never are blank once a template closes them, so test the raw column to leave out empty ones.
    """
    positive = F.struct(F.col("chosen").alias("response"), F.lit(True).alias("label"))
    examples = F.array(positive)
    if "rejected" in df.columns:
        negative = F.struct(F.col("rejected").alias("response"), F.lit(False).alias("label"))
        test = F.col(rejected_source).cast("string")
        examples = F.when(has_text(test), F.array(positive, negative)).otherwise(examples)
    return (df.select(*keep, "prompt", F.explode(examples).alias("_e"))
            .select(*keep, "prompt", "_e.response", "_e.label"))


def label_counts(df: DataFrame) -> DataFrame:
    """Rows per label."""
    return df.groupBy("label").agg(F.count("*").alias("rows"))

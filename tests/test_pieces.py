"""Formatters in Python hold a few megabytes of rows at a time, however many rows or bytes come in a batch."""

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from pairloom.functions import rendering
from pairloom.functions.templates import formatter


def test_pieces():
    columns = (pa.array(["x" * 1000] * 50 + [None, ""] * 25), pa.array(["é"] * 100))
    parts = list(rendering.pieces(columns, 5000))
    assert len(parts) > 5 and [pa.concat_arrays(c).to_pylist() for c in zip(*parts)] == [c.to_pylist() for c in columns]
    assert len(list(rendering.pieces(columns))) == 1 and not list(rendering.pieces((pa.array([], pa.string()),)))


def test_large_batches_reach_functions_in_pieces(spark):
    def sizes(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"prompt": batch["prompt"], "chosen": [str(len(batch))] * len(batch), "rejected": batch["chosen"].where(batch["system"] != "")})

    df = spark.range(0, 3000, 1, 1).select("id", F.col("id").cast("string").alias("prompt"), F.repeat(F.lit("word "), 1000).alias("chosen"))
    out = rendering.batch_formatter("sizes", sizes)(df)
    got = out.select("id", "prompt", F.col("chosen").cast("int").alias("n"), "rejected").collect()
    assert all(str(r["id"]) == r["prompt"] and r["rejected"] is None for r in got) and len(got) == 3000
    assert max(r["n"] for r in got) <= 500
    shown = formatter("tokenizer", renderer=lambda messages, **_: "".join(m["content"] for m in messages))(df)
    assert shown.where((F.col("prompt") == F.col("id").cast("string")) & (F.length("chosen") == 5000)).count() == 3000

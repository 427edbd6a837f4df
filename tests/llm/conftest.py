import pytest
from pyspark.sql import DataFrame


@pytest.fixture
def table(spark):
    """Rows as a table over several partitions."""
    def make(rows, schema) -> DataFrame:
        return spark.createDataFrame(rows, schema).repartition(3)
    return make


def word(i: int) -> str:
    """A made-up word for a number."""
    return "".join("bcdfghjklm"[int(d)] + "aeiou"[int(d) % 5] for d in str(i))


def text(seed: int, words: int, rows: int = 8) -> str:
    """Different words for each seed."""
    return " ".join(word(seed * 10_000 + i) + ("." if i % rows == rows - 1 else "") for i in range(words))

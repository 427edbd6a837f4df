"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pairloom.operators.order import ORD

WRITERS = ("parquet", "json")


def write_table(df: DataFrame, path: str, file_format: str = "parquet", keep_ord: bool = True) -> str:
    """Write one table as Parquet or JSON Lines; the path must be new."""
    if file_format not in WRITERS:
        raise ValueError(f"write as one of {WRITERS}")
    out = df if keep_ord else df.drop(ORD, "_src")
    out.write.mode("errorifexists").format(file_format).save(path)
    return path


def write_splits(train: DataFrame, evaluation: DataFrame | None, path: str, file_format: str = "parquet",
                 keep_ord: bool = False) -> dict[str, str]:
    """Write a prepared pair below `path` as `train` and, when there is one, `eval`."""
    root = path.rstrip("/")
    out = {"train": write_table(train, f"{root}/train", file_format, keep_ord)}
    if evaluation is not None:
        out["eval"] = write_table(evaluation, f"{root}/eval", file_format, keep_ord)
    return out

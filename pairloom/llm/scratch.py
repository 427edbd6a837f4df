"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession

from pairloom.session import cut_lineage, scratch_path, shared_dir

__all__ = ["Scratch", "cut_lineage", "put_file", "release", "shared_dir"]


class Scratch:
    """Tables written below one new folder; `drop` removes those that no later step reads.

    Parquet keeps wide intermediate results small and lets later steps read single columns. Lost executors cost
    nothing but a second read. What a returned DataFrame still reads is never dropped; Spark removes checkpoints
    when nothing refers to them any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root = spark, scratch_path(spark, label)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark remove the files of shuffles and checkpoints that nothing refers to any more; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    time.sleep(1.2)  # once a second the JVM hears which of its tables Python has let go
    spark._jvm.System.gc()


def put_file(spark: SparkSession, label: str, content: bytes, step: int = 4 << 20) -> str:
    """Write one bounded file to the shared folder; `SparkContext.addFile` hands it to every executor, new ones too."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, label))
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    try:
        for i in range(0, len(content), step):
            out.write(bytearray(content[i:i + step]))
    finally:
        out.close()
    return path.toString()

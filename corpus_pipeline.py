"""From raw documents to packed training sequences.

Every stage works on all documents that the one before kept; each result is written as Parquet and read again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import bottomk, chunking, langid, leaks, packing
from pairloom.llm.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
BATCH = "1000"  # rows that a Python worker gets at once: whole texts, so a few megabytes
PRIVATE = "_pipeline_"  # before the names of columns that live within a stage


def in_small_batches(stage: Stage) -> Stage:
    """The stage with small Arrow batches, which also bound what an executor holds outside its heap."""
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)
        return stage(spark, docs, sf_dir)

    return run_stage


@in_small_batches
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a letter: null, empty and letterless texts go, also where no document has a label to learn from.

    Repeated rows and ties in labels change nothing: rows are judged one by one. An empty table stays empty.
    """
    names = f"{PRIVATE}lang", f"{PRIVATE}score"
    judged = langid.predict(docs, langid.train(docs), into=names)
    told = F.col(names[0]) != langid.NONE
    return judged.where(told | F.col("text").rlike(r"\p{L}")).select(*docs.columns)  # a language may have that name, or none was learned


@in_small_batches
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates; null and empty texts are near to none and stay."""
    return bottomk.drop_near_duplicates(docs)


@in_small_batches
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents without passages that an earlier document has; `n_chars` follows the text. Null texts stay null."""
    cut = chunking.remove_repeats(docs, into=f"{PRIVATE}spans")
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return cut.withColumn("n_chars", F.when(F.size(f"{PRIVATE}spans") > 0, length).otherwise(F.col("n_chars"))).select(*docs.columns)


@in_small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; all of them if the benchmark is empty. Null and empty texts hold none."""
    space = leaks.fit(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = leaks.search(docs, space, into=f"{PRIVATE}leaks")
    return found.where(F.size(f"{PRIVATE}leaks") == 0).select(*docs.columns)


@in_small_batches
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens; null and empty texts are pieces of one token."""
    pieces = packing.cut_documents(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(pieces)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
    ("decontaminate", decontaminate), ("pack", pack)]
ORACLE_SQL = None  # shingle sketches, chunks, latent vectors and tokens are beyond SQL; the tests hold stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs

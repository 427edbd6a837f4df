"""The test tables in the shapes the operators expect, as DataFrames and as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.messages import nest_turns
from pairloom.session import scratch_path
from pairloom.sources.files import FileTable
from pairloom.sources.read import open_table

ID = "doc_id"
FILE_BYTES = 64 << 20   # text in one file of a table that is written out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as preference rows, ordered by doc_id.

    The first line asks, the whole text answers, and what follows the first line is the worse
    answer. Some languages have no system text or no worse answer; some sources think aloud.
    """
    text = F.col("text")
    first = F.substring_index(text, "\n", 1)
    rest = F.substring(text, F.length(first) + 2, F.length(text))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(F.col("lang") == "de", F.lit(None)).when(F.col("lang") == "fr", F.lit(" \t"))
        .otherwise(F.col("source")).alias("system"),
        first.alias("prompt"),
        F.when(F.col("source") == "src1", F.concat(F.lit("<think>"), first, F.lit("</think>"), rest)).otherwise(text).alias("chosen"),
        F.when(F.col("lang") != "es", rest).alias("rejected"),
        F.when(F.col("lang") == "fr", F.col("source")).alias("reasoning"))


PREF = r"""pref AS (
  SELECT doc_id,
         CASE lang WHEN 'de' THEN NULL WHEN 'fr' THEN ' ' || chr(9) ELSE source END AS system,
         split_part(text, chr(10), 1) AS prompt,
         CASE WHEN source = 'src1' THEN '<think>' || split_part(text, chr(10), 1) || '</think>' || rest ELSE text END AS chosen,
         CASE WHEN lang <> 'es' THEN rest END AS rejected,
         CASE WHEN lang = 'fr' THEN source END AS reasoning
  FROM (SELECT *, substr(text, length(split_part(text, chr(10), 1)) + 2) AS rest FROM documents))"""


def file_count(df: DataFrame, least: int = 4) -> int:
    """How many files a table is written to: at least `least`, and more as its texts grow, so that no task's share does."""
    texts = [F.coalesce(F.octet_length(name), F.lit(0)).cast("long") for name, kind in df.dtypes if kind == "string"]
    total = df.agg(F.sum(reduce(lambda a, b: a + b, texts, F.lit(16)))).first()[0] or 0
    return max(least, -(-total // FILE_BYTES))


def sharded(df: DataFrame, key: str, label: str) -> FileTable:
    """A table written in key order over several files, and opened as a table of files."""
    path = scratch_path(df.sparkSession, label)
    df.repartitionByRange(file_count(df), key).sortWithinPartitions(key).write.parquet(path)
    return open_table(df.sparkSession, path)


def blank(expr: str) -> str:
    """SQL for the blank test."""
    return f"({expr} IS NULL OR NOT regexp_matches({expr}, '[^\\s\\x0B\\x1C-\\x1F\\x{{85}}\\p{{Z}}]'))"


def conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one row with its messages."""
    return nest_turns(table(spark, sf_dir, "conversations"))


PAIRS = r"""pairs AS (
  SELECT conv_id,
         coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'system'), '') AS system,
         coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'user'), '') AS prompt,
         coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (WHERE role = 'assistant'), '') AS chosen
  FROM conversations GROUP BY conv_id)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as run records: one run per event, the event type is its status, its props the configuration."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("job_id"), F.col("event_type").alias("status"),
                    F.col("ts").alias("created_at"), "user_id", "value", F.col("props").alias("config"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as metric records: a user is a run, events arrive in id order, `k` of the props is the step."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("_ord"),
                    F.get_json_object("props", "$.k").cast("long").alias("step"), F.col("value").alias("loss"),
                    F.col("event_type").alias("status"))


POINTS = """points AS (
  SELECT user_id AS job_id, event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS step,
         value AS loss, event_type AS status FROM events)"""


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as checkpoints: the customer is the run, the order key the step."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("job_id"),
        F.concat(F.lit("checkpoint-"), F.col("o_orderkey").cast("string")).alias("checkpoint"),
        F.round(F.col("o_totalprice")).cast("long").alias("bytes"))


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as run statuses, by market segment; automobile customers have none."""
    c = table(spark, sf_dir, "customer")
    status = (F.when(F.col("c_mktsegment") == "BUILDING", "training").when(F.col("c_mktsegment") == "MACHINERY", "failed")
              .otherwise("completed"))
    return c.where(F.col("c_mktsegment") != "AUTOMOBILE").select(F.col("c_custkey").alias("job_id"), status.alias("status"))


CHECKPOINTS = """ck AS (
  SELECT o_custkey AS job_id, o_orderkey AS step, 'checkpoint-' || o_orderkey AS checkpoint,
         CAST(round(o_totalprice) AS BIGINT) AS bytes FROM orders),
statuses AS (
  SELECT c_custkey AS job_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'training' WHEN 'MACHINERY' THEN 'failed'
         ELSE 'completed' END AS status FROM customer WHERE c_mktsegment <> 'AUTOMOBILE'),
ranked AS (
  SELECT ck.*, coalesce(s.status, 'unknown') AS status, coalesce(s.status, 'unknown') = 'training' AS active,
         row_number() OVER (PARTITION BY job_id ORDER BY step DESC) AS rn,
         count(*) OVER (PARTITION BY job_id) AS n
  FROM ck LEFT JOIN statuses s USING (job_id))"""

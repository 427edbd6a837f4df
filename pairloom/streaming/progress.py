"""Progress events of training runs as a stream, and the preparation operators that suit streams.

Events arrive as JSON lines in files that writers close before they land (file rotation); the
stream's checkpoint remembers which files were read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pairloom.functions.text import has_text
from pairloom.operators.dedup import EXACT_JSON, dedup_key
from pairloom.operators.runs import latest_state

# Event types and the fields an event may carry.
EVENT_TYPES = ("metrics", "eval", "status", "completed", "error")
EVENT_SCHEMA = ("type string, status string, message string, loss double, eval_loss double, learning_rate double, "
                "current_step bigint, total_steps bigint, progress double, gpu_memory double, output_dir string, "
                "error string")
MARKS = 1 << 16   # runs whose highest point a task remembers while it reads
METRIC_COLUMNS = ("job_id", "step", "loss", "eval_loss", "learning_rate", "gpu_memory_used")


def parse_events(lines: DataFrame, keep: Sequence[str] = (), schema: str = EVENT_SCHEMA) -> DataFrame:
    """Events from a `value` column of JSON lines; blank and malformed lines are skipped.

    Works on batch and streaming tables. A line counts as malformed when it is not a JSON object.
    """
    doc = F.try_parse_json(F.col("value"))
    is_object = F.schema_of_variant(doc).startswith("OBJECT")
    return (lines.where(has_text(F.col("value")) & F.coalesce(is_object, F.lit(False)))
            .select(*keep, F.from_json("value", schema).alias("_e")).select(*keep, "_e.*"))


def tail_events(spark: SparkSession, path: str, files_per_batch: int = 64, schema: str = EVENT_SCHEMA) -> DataFrame:
    """Follow a folder of event files.

    `job_id` comes from the events when the schema has it; otherwise each run writes into a folder
    of its own and the folder's name is the id.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    if "job_id" in T.StructType.fromDDL(schema).names:
        return parse_events(lines, schema=schema)
    job = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1)
    return parse_events(lines.withColumn("job_id", job), ["job_id"], schema)


def of_type(events: DataFrame, kind: str) -> DataFrame:
    if kind not in EVENT_TYPES:
        raise ValueError(f"unknown event type {kind!r}: use one of {EVENT_TYPES}")
    return events.where(F.col("type") == kind)


def as_updates(events: DataFrame, keep: Sequence[str] = ("job_id",)) -> DataFrame:
    """Each event as the update it means for its run; types nobody handles and empty evaluations vanish."""
    kind = F.col("type")

    def during(kinds: Sequence[str], value: Column) -> Column:
        return F.when(kind.isin(*kinds), value)

    status = (F.when(kind.isin("metrics", "eval"), F.lit("training")).when(kind == "completed", F.lit("completed"))
              .when(kind == "error", F.lit("failed")).otherwise(F.coalesce(F.col("status"), F.lit("training"))))
    metrics = ["metrics"]
    return (events.where(kind.isin(*EVENT_TYPES) & ((kind != "eval") | F.col("eval_loss").isNotNull()))
            .select(*keep, "type", status.alias("status"),
                    during(metrics, F.coalesce(F.col("progress"), F.lit(0.5))).alias("progress"),
                    during(metrics, F.col("current_step")).alias("current_step"),
                    during(metrics, F.col("total_steps")).alias("total_steps"),
                    during(metrics, F.col("loss")).alias("loss"),
                    during(["eval"], F.col("eval_loss")).alias("eval_loss"),
                    during(metrics, F.col("learning_rate")).alias("learning_rate"),
                    during(metrics, F.col("gpu_memory")).alias("gpu_memory"),
                    during(["status"], F.col("message")).alias("message"),
                    during(["error"], F.coalesce(F.col("error"), F.lit("Unknown error"))).alias("error"),
                    during(["completed"], F.coalesce(F.col("output_dir"), F.lit(""))).alias("output_dir")))


def as_metrics(events: DataFrame) -> DataFrame:
    """The metric records worth appending: steps with a loss."""
    return (of_type(events, "metrics").where(F.col("loss").isNotNull() & (F.col("current_step") > 0))
            .select("job_id", F.col("current_step").alias("step"), "loss", "eval_loss", "learning_rate",
                    F.col("gpu_memory").alias("gpu_memory_used")))


def append_metrics(metrics: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of metric records to a Parquet table, each record once; read what is there and stop."""
    return (metrics.writeStream.format("parquet").option("checkpointLocation", checkpoint)
            .outputMode("append").trigger(availableNow=True).start(path))


def route_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of events to one Parquet table partitioned by type, so each consumer reads its own."""
    return (events.where(F.col("type").isin(*EVENT_TYPES)).writeStream.format("parquet").partitionBy("type")
            .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path))


def write_state(updates: DataFrame, path: str, checkpoint: str, fields: Sequence[str], key: str = "job_id",
                seq: str = "seq", cleared: str | None = None) -> StreamingQuery:
    """Follow the latest state of every run: one Parquet folder per micro-batch with the runs that changed in it.

    Read the newest state of a run with `max_by` over `batch`. A repeated batch overwrites itself.
    """
    state = latest_state(updates, fields, key, seq, cleared=cleared)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    with disk_state(updates.sparkSession):
        return (state.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
                .outputMode("update").trigger(availableNow=True).start())


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB: on disk, with only changes written at the end of a batch."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _rising(run: np.ndarray, ord: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Indices of points whose step exceeds every earlier one of their run (a number).

    Of a set's parts, only these points can be among the set's own.
    """
    order = np.lexsort((-step, ord, run))
    # Runs one above the other, so that the highest value so far never reaches into the next run.
    value = np.unique(step, return_inverse=True)[1][order] + run[order] * (len(step) + 1)
    before = np.concatenate([[-1], np.maximum.accumulate(value)[:-1]]) if len(step) else value
    return order[value > before]


def keep_monotone(points: DataFrame, path: str, checkpoint: str, key: str = "job_id", step: str = "step",
                  ord: str = "_ord", chunk: int = 10_000) -> StreamingQuery:
    """Write the points whose step exceeds every earlier step of their run; points without a step are dropped.

    The last step of every run is keyed state, so a batch only reads and writes the state of its own runs. Points that an
    earlier one of their run in the same task beats, as far as read, go before the shuffle, so that a busy run's rows meet in one task only
    as far as they rise; there they are taken in pieces and only rising ones are held. Of points that share a run and an
    ordinal, the highest step passes; points without an ordinal come first. Each batch has a folder of its own: a
    repeated one overwrites itself.
    """
    # A point travels as text, so Python converts few columns for each run and no number next to nulls turns into a float.
    rows = points.where(F.col(step).isNotNull()).select(
        key, F.col(step).cast("long").alias("_step"), F.coalesce(F.col(ord).cast("long"), F.lit(-2**63)).alias("_place"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in points.columns]), EXACT_JSON).alias("_row"))

    def before_shuffle(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = None   # the highest point of each run so far, of a bounded number of runs: others go on and are judged behind the shuffle
        for part in parts:
            own = pa.table([part.column(key), part.column("_place"), part.column("_step")], ["run", "place", "step"])
            seen = own if marks is None else pa.concat_tables([marks, own])
            run = seen.column("run").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
            kept = _rising(run, seen.column("place").to_numpy(), seen.column("step").to_numpy())
            first = len(seen) - len(own)
            yield part.take(pa.array(np.sort(kept[kept >= first]) - first))
            last = kept[np.append(run[kept][1:] != run[kept][:-1], True)] if len(kept) else kept
            marks = seen.take(pa.array(last if len(last) <= MARKS else last[last >= first][:MARKS]))

    def rise(_: tuple, parts: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        def rising(some: list[pd.DataFrame]) -> pd.DataFrame:
            one = some[0] if len(some) == 1 else pd.concat(some)
            return one.iloc[_rising(np.zeros(len(one), np.int64), one["_place"].to_numpy(), one["_step"].to_numpy())]

        last = state.get[0] if state.exists else -2**63
        held: list[pd.DataFrame] = []
        for part in parts:
            held.append(part[part["_step"] > last] if state.exists else part)
            if sum(map(len, held)) > chunk:
                held = [rising(held)]
        kept = rising(held)
        if len(kept):
            state.update((int(kept["_step"].max()),))
            yield kept

    def save(batch: DataFrame, number: int) -> None:
        read = {k: v for k, v in EXACT_JSON.items() if k != "ignoreNullFields"}
        whole = batch.select(F.from_json("_row", points.schema, read).alias("_row")).select("_row.*")
        whole.write.mode("overwrite").parquet(f"{path}/points/batch={number}")

    kept = rows.mapInArrow(before_shuffle, rows.schema).groupBy(key).applyInPandasWithState(rise, rows.schema, "last long", "append", "NoTimeout")
    with disk_state(points.sparkSession):
        return (kept.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())


def drop_repeats(rows: DataFrame, strategy: str = "prompt_chosen", compat: bool = False) -> DataFrame:
    """Exact duplicate removal on a stream: the first row of a key to arrive passes.

    The state is one digest of sixteen bytes for each distinct key, since a repeat may come at any time. Start the query
    within `disk_state` (or with that setting in the session) and the state lies on disk: memory stays flat however many keys there are.
    """
    return rows.withColumn("_key", F.unhex(dedup_key(rows, strategy, compat))).dropDuplicates(["_key"]).drop("_key")

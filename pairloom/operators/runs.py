"""Training-run telemetry: job listings, metric series, latest state, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.functions.text import file_stem, json_field, micros
from pairloom.operators.order import WIDE, kth_smallest, narrow_to_nth, number_rows, running_before
from pairloom.session import cut_lineage

# The configuration fields a job listing shows, and the state fields an update may clear.
CONFIG_SUMMARY = ("base_model", "output_name", "training_mode")
CLEARABLE = ("worker_pid", "progress_file")


def runs_by_status(runs: DataFrame) -> DataFrame:
    """Runs per status."""
    return runs.groupBy("status").agg(F.count("*").alias("runs"))


def store_totals(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: number of runs and of metric records."""
    counted = runs.select(F.lit(1).alias("r"), F.lit(0).alias("m")).unionAll(metrics.select(F.lit(0), F.lit(1)))
    return counted.agg(F.coalesce(F.sum("r"), F.lit(0)).alias("total_runs"),
                       F.coalesce(F.sum("m"), F.lit(0)).alias("total_metrics"))


def list_runs(runs: DataFrame, status: str | None = None, limit: int = 100, offset: int = 0,
              created: str = "created_at", id: str = "job_id") -> DataFrame:
    """A page of runs, newest first, ties by id; runs without a readable time come last.

    A page deep in the table is cut out by its creation times first, so no task sorts what lies
    before it.
    """
    rows = runs.where(F.col("status") == status) if status else runs
    age = F.coalesce(-micros(F.col(created)), F.lit(2**62))
    if offset + limit > WIDE:
        first, last = (kth_smallest(rows, age, k) for k in (offset + 1, offset + limit))
        if first is None:
            return rows.where(F.lit(False))
        skipped = rows.where(age < first).count()
        rows = rows.where((age >= first) & (age <= last if last is not None else F.lit(True)))
        offset -= skipped
        if offset + limit > WIDE:   # many runs created at the same moment
            placed = number_rows(rows, age, F.col(id))
            return placed.where(F.col("_pos").between(offset, offset + limit - 1)).orderBy("_pos").drop("_pos")
    return rows.orderBy(age, F.col(id)).offset(offset).limit(limit)


def summarise_config(runs: DataFrame, config: str = "config") -> DataFrame:
    """Replace a JSON configuration by the few fields a listing shows; missing ones are empty."""
    fields = {f: json_field(F.col(config), f, "") for f in CONFIG_SUMMARY}
    return runs.withColumns(fields).drop(config)


def run_metrics(metrics: DataFrame, job_id, key: str = "job_id", step: str = "step") -> DataFrame:
    """The metric series of one run by step."""
    return metrics.where(F.col(key) == job_id).orderBy(step)


def find_run(runs: DataFrame, job_id, key: str = "job_id") -> DataFrame:
    return runs.where(F.col(key) == job_id)


def latest_state(updates: DataFrame, fields: Sequence[str], key: str = "job_id", seq: str = "seq",
                 updated: str | None = None, cleared: str | None = None) -> DataFrame:
    """The current state per run from partial updates, on a batch table or a stream.

    A null in an update keeps the earlier value. Fields named in the `cleared` array of an update
    are set to null by it. `updated` names the column whose latest value becomes `updated_at`.
    """
    def speaks(name: str) -> Column:
        value = F.col(name).isNotNull()
        if cleared and name in CLEARABLE:
            value = value | F.coalesce(F.array_contains(F.col(cleared), name), F.lit(False))
        return value

    def latest(at: dict[str, Column]) -> list[Column]:
        held = [F.max_by(F.struct(F.col(name).alias("v")), at[name])["v"].alias(name) for name in fields]
        return held + ([F.max_by(F.col(updated), at["_updated"]).alias("updated_at")] if updated else [])

    times = {name: F.when(speaks(name), F.col(seq)) for name in fields} | ({"_updated": F.col(seq)} if updated else {})
    if updates.isStreaming:
        return updates.groupBy(key).agg(*latest(times))
    # In a batch, plain numbers are aggregated by hash over all updates; only updates that hold some field's latest value
    # are looked at once more.
    last = updates.groupBy(key).agg(*[F.max(c).alias(f"_at_{name}") for name, c in times.items()])
    marked = updates.join(last.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")))
    now = {name: F.when(c == F.col(f"_at_{name}"), c) for name, c in times.items()}
    telling = reduce(lambda a, b: a | b, [c.isNotNull() for c in now.values()])
    found = marked.where(telling).groupBy(key).agg(*latest(now))
    silent = reduce(lambda a, b: a & b, [F.col(f"_at_{name}").isNull() for name in times])
    return found.unionByName(last.where(silent).select(key), allowMissingColumns=True)


def monotone_steps(points: DataFrame, key: str = "job_id", step: str = "step", ord: str = "_ord",
                   block: int = 1_000_000) -> DataFrame:
    """Points whose step is above every earlier point of the same run; points without a step are dropped.

    A point is kept exactly when it beats the running maximum of all earlier points, so no state
    has to be passed row by row.
    """
    known = points.where(F.col(step).isNotNull())
    seen = running_before(known, F.col(step), [key], ord, "_seen", F.max, block)
    return seen.where(F.col("_seen").isNull() | (F.col(step) > F.col("_seen"))).drop("_seen")


def run_summary(metrics: DataFrame, key: str = "job_id", step: str = "step", ord: str | None = None,
                values: Sequence[str] = ("loss",), block: int = 100_000) -> DataFrame:
    """Per run: number of records, first, middle and last record by step, and the loss improvement in percent.

    The middle record is at position n // 2, for runs of more than two; of records that share its
    step, the one with the nth ordinal, or without `ord` the smallest. Where a run has more than
    `block` records it is found by counting ever smaller cells, so that run is never ordered whole.
    """
    record = F.struct(F.col(step).cast("long").alias("step"), *[F.col(v) for v in values])
    # Records without a step or an ordinal count like all others and come first.
    least = F.lit(-2**63)
    rows = metrics.select(F.col(key), record.alias("_rec"), F.coalesce(F.col(step).cast("long"), least).alias("_step"),
                          *([F.coalesce(F.col(ord), least).alias("_o")] if ord else []))
    cells = {"_block": "_step", **({"_oblock": "_o"} if ord else {})}
    rows = rows.withColumns({name: F.expr(f"{of} div {block}L") for name, of in cells.items()})
    place = F.struct("_step", "_o") if ord else F.struct("_step", "_rec")
    ends = cut_lineage(rows.groupBy(key).agg(F.count("*").alias("records"), F.min_by("_rec", place).alias("first"),
                                             F.max_by("_rec", place).alias("last")))
    if ends.where(F.col("records") > block).isEmpty():
        middle = _middle_by_rank(rows, key, ord is not None)
    else:
        found, at = ends.where("records > 2").select(key, F.expr("records div 2").alias("_nth")), [key]
        for cell in ("_block", "_step", "_oblock", "_o") if ord else ("_block", "_step"):
            found = narrow_to_nth(rows, found, at, cell)
            at = [*at, cell]
        middle = rows.join(found, at, "left_semi").groupBy(key).agg(F.min("_rec").alias("middle"))
    out = ends.join(middle, key, "left")
    lead = values[0]
    flat = [F.col(f"{part}.{v}").alias(f"{part}_{v}") for part in ("first", "middle", "last") for v in ("step", *values)]
    a, b = F.col(f"first.{lead}"), F.col(f"last.{lead}")
    gain = F.when((F.col("records") >= 2) & (a != 0) & (b != 0), (a - b) / a * 100)
    return out.select(key, "records", *flat, gain.alias("improvement_pct"))


def _middle_by_rank(rows: DataFrame, key: str, ordered: bool) -> DataFrame:
    """The middle record of every run, for runs small enough to be ordered by one task each."""
    run = Window.partitionBy(key)
    rank = F.row_number().over(run.orderBy("_step", *(["_o"] if ordered else [])))
    value = F.col("_rec") if ordered else F.min("_rec").over(Window.partitionBy(key, "_step"))
    return (rows.withColumns({"_rank": rank, "_all": F.count("*").over(run), "middle": value})
            .where("_all > 2 AND _rank = _all div 2 + 1").select(key, "middle"))


def config_catalogue(files: DataFrame, tag: str | None = None) -> DataFrame:
    """The metadata of saved configurations, newest first, from (filename, value) rows of JSON text; invalid ones are skipped."""
    meta = "struct<name:string,description:string,created_at:string,modified_at:string,tags:array<string>>"
    valid = files.where(F.try_parse_json("value").isNotNull()).select(
        "filename", F.from_json(F.coalesce(F.get_json_object("value", "$._metadata"), F.lit("{}")), meta).alias("m"))
    rows = valid.select("filename", "m.*")
    if tag:
        rows = rows.where(F.array_contains("tags", tag))
    return rows.orderBy(F.coalesce(F.col("modified_at"), F.lit("")).desc(), "filename")


def list_configs(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """The catalogue of a folder with one JSON file per configuration."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    return config_catalogue(files.select(file_stem(F.col("_metadata.file_path")).alias("filename"), "value"), tag)

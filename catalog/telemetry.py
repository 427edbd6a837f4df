"""Run telemetry, retention planning and the same as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import CHECKPOINTS, POINTS, checkpoints, points, runs, statuses, table
from pairloom.functions.text import redact_json, training_progress
from pairloom.operators import retention
from pairloom.operators import runs as telemetry
from pairloom.session import scratch_path
from pairloom.streaming import progress
from pairloom.streaming.tail import open_folder, tail_growing_events

def at(text):
    return F.lit(text).cast("timestamp_ntz")


NOW = "2024-01-20 12:00:00"
SQL_NOW = "TIMESTAMP '2024-01-20 12:00:00'"
ROWS = 500_000   # events in one file of a stream, as far as lots are of equal size
EVENT_COLUMNS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

# ---- listings ------------------------------------------------------------------------------------------


@query("runs_by_status", "SELECT event_type AS status, count(*) AS runs FROM events GROUP BY 1")
def runs_by_status(spark, d):
    return telemetry.runs_by_status(runs(spark, d))


@query("store_totals", "SELECT (SELECT count(*) FROM orders) AS total_runs, (SELECT count(*) FROM events) AS total_metrics")
def store_totals(spark, d):
    return telemetry.store_totals(table(spark, d, "orders"), table(spark, d, "events"))


@query("list_runs", """
SELECT event_id AS job_id, event_type AS status, value FROM events WHERE event_type = 'error'
ORDER BY ts DESC, event_id LIMIT 50 OFFSET 20""")
def list_runs(spark, d):
    return telemetry.list_runs(runs(spark, d), "error", 50, 20).select("job_id", "status", "value")


@query("list_runs_deep", """
SELECT event_id AS job_id, CASE WHEN event_id % 2 = 0 THEN ts END AS created_at, value FROM events
ORDER BY created_at DESC NULLS LAST, event_id LIMIT 3000 OFFSET 20""")
def list_runs_deep(spark, d):
    """A deep page over runs of which every second has no readable time: those come last, and none is lost."""
    when = F.when(F.col("job_id") % 2 == 0, F.col("created_at").cast("string")).otherwise(F.lit("not yet"))
    page = telemetry.list_runs(runs(spark, d).withColumn("created_at", when), limit=3000, offset=20)
    return page.select("job_id", F.col("created_at").try_cast("timestamp_ntz").alias("created_at"), "value")


@query("config_summary", """
SELECT event_id AS job_id, event_type AS base_model, '' AS output_name, 'm' || json_extract_string(props, '$.k') AS training_mode
FROM events""")
def config_summary(spark, d):
    k = F.concat(F.lit("m"), F.get_json_object("config", "$.k"))
    config = F.to_json(F.struct(F.col("status").alias("base_model"), k.alias("training_mode")))
    return telemetry.summarise_config(runs(spark, d).select("job_id", config.alias("config"))).select(
        "job_id", *telemetry.CONFIG_SUMMARY)


@query("redact", """
SELECT event_id AS job_id, '{"k":' || json_extract_string(props, '$.k') || ',"model":"' || event_type || '"}' AS config FROM events""")
def redact(spark, d):
    secret = F.struct(F.get_json_object("config", "$.k").cast("int").alias("k"), F.col("status").alias("model"),
                      F.lit("s3cret").alias("hf_token"), F.lit("s3cret").alias("wandb_key"))
    return runs(spark, d).select("job_id", redact_json(F.to_json(secret)).alias("config"))


@query("json_field", "SELECT event_id AS job_id, json_extract_string(props, '$.k') AS k FROM events")
def json_field(spark, d):
    from pairloom.functions.text import json_field as field

    return runs(spark, d).select("job_id", field(F.col("config"), "k").alias("k"))


@query("run_metrics", f"WITH {POINTS} SELECT job_id, event_id, step, loss FROM points WHERE job_id = 8")
def run_metrics(spark, d):
    return telemetry.run_metrics(points(spark, d), 8).select("job_id", F.col("_ord").alias("event_id"), "step", "loss")


@query("find_run", "SELECT event_id AS job_id, event_type AS status, value FROM events WHERE event_id = 77")
def find_run(spark, d):
    return telemetry.find_run(runs(spark, d), 77).select("job_id", "status", "value")


@query("run_progress", f"""
WITH {POINTS} SELECT event_id, least(0.3::DOUBLE + 0.6::DOUBLE * (step::DOUBLE / 100), 0.9::DOUBLE) AS progress FROM points""")
def run_progress(spark, d):
    return points(spark, d).select(F.col("_ord").alias("event_id"), training_progress(F.col("step"), F.lit(100)).alias("progress"))


@query("config_catalogue", """
SELECT 'cfg-' || event_id AS filename, 'run ' || event_id AS name, strftime(ts, '%Y-%m-%d') AS modified_at
FROM events WHERE event_type = 'view'""")
def config_catalogue(spark, d):
    """Every event as a saved configuration, tagged with its type; purchases are saved as broken files."""
    meta = F.struct(F.concat(F.lit("run "), F.col("job_id").cast("string")).alias("name"),
                    F.date_format("created_at", "yyyy-MM-dd").alias("modified_at"), F.array("status").alias("tags"))
    doc = F.when(F.col("status") == "purchase", F.lit("{broken")).otherwise(F.to_json(F.struct("value", meta.alias("_metadata"))))
    files = runs(spark, d).select(F.concat(F.lit("cfg-"), F.col("job_id").cast("string")).alias("filename"), doc.alias("value"))
    return telemetry.config_catalogue(files, "view").select("filename", "name", "modified_at")


# ---- series --------------------------------------------------------------------------------------------

@query("latest_state", f"""
WITH {POINTS}
SELECT job_id, arg_max(status, event_id) AS status, arg_max(step, event_id) FILTER (WHERE step < 50) AS step,
       arg_max(loss, event_id) FILTER (WHERE status = 'view') AS loss, max(event_id) AS updated_at
FROM points GROUP BY job_id""")
def latest_state(spark, d):
    updates = points(spark, d).withColumns({
        "step": F.when(F.col("step") < 50, F.col("step")), "loss": F.when(F.col("status") == "view", F.col("loss")),
        "stamp": F.col("_ord")})
    return telemetry.latest_state(updates, ["status", "step", "loss"], seq="_ord", updated="stamp")


@query("latest_state_cleared", f"""
WITH {POINTS}
SELECT job_id, arg_max(status, event_id) AS status,
       CASE WHEN arg_max(status, event_id) FILTER (WHERE status IN ('click', 'error')) = 'click'
            THEN arg_max(step, event_id) FILTER (WHERE status = 'click') END AS worker_pid
FROM points GROUP BY job_id""")
def latest_state_cleared(spark, d):
    """Clicks set the worker, errors clear it."""
    updates = points(spark, d).withColumns({
        "worker_pid": F.when(F.col("status") == "click", F.col("step")),
        "cleared": F.when(F.col("status") == "error", F.array(F.lit("worker_pid")))})
    return telemetry.latest_state(updates, ["status", "worker_pid"], seq="_ord", cleared="cleared")


_MONOTONE = f"""
WITH {POINTS}, seen AS (
  SELECT *, max(step) OVER (PARTITION BY job_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
  FROM points WHERE step IS NOT NULL)
SELECT job_id, event_id, step, loss FROM seen WHERE top IS NULL OR step > top"""


@query("monotone_steps", _MONOTONE)
def monotone_steps(spark, d):
    return telemetry.monotone_steps(points(spark, d)).select("job_id", F.col("_ord").alias("event_id"), "step", "loss")


@query("run_summary", """
WITH p AS (SELECT user_id AS job_id, event_id AS step, value AS loss,
                  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n
           FROM events),
s AS (SELECT job_id, any_value(n) AS records,
             max(step) FILTER (WHERE i = 0) AS first_step, max(loss) FILTER (WHERE i = 0) AS first_loss,
             max(step) FILTER (WHERE i = n // 2 AND n > 2) AS middle_step, max(loss) FILTER (WHERE i = n // 2 AND n > 2) AS middle_loss,
             max(step) FILTER (WHERE i = n - 1) AS last_step, max(loss) FILTER (WHERE i = n - 1) AS last_loss
      FROM p GROUP BY job_id)
SELECT *, CASE WHEN records >= 2 AND first_loss <> 0 AND last_loss <> 0 THEN (first_loss - last_loss) / first_loss * 100 END AS improvement_pct
FROM s""")
def run_summary(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("step"), F.col("value").alias("loss"))
    return telemetry.run_summary(e)


# ---- retention -----------------------------------------------------------------------------------------

@query("status_lookup", f"WITH {CHECKPOINTS} SELECT job_id, checkpoint, status FROM ranked")
def status_lookup(spark, d):
    return retention.with_status(checkpoints(spark, d), statuses(spark, d)).select("job_id", "checkpoint", "status")


@query("keep_newest_k", f"""
WITH {CHECKPOINTS}, kept AS (
  SELECT job_id, string_agg(checkpoint, ', ' ORDER BY step) AS names FROM ranked WHERE rn <= 2 GROUP BY job_id)
SELECT job_id, checkpoint, bytes, 'older than ' || names AS reason
FROM ranked JOIN kept USING (job_id) WHERE NOT active AND status <> 'failed' AND rn > 2
UNION ALL
SELECT job_id, NULL, sum(bytes)::BIGINT, 'failed job, nothing of it is needed' FROM ranked WHERE status = 'failed' GROUP BY job_id""")
def keep_newest_k(spark, d):
    return retention.plan_cleanup(checkpoints(spark, d), statuses(spark, d), keep=2, purge_failed=True)[0]


@query("cleanup_skipped", f"""
WITH {CHECKPOINTS}
SELECT DISTINCT job_id, CASE WHEN active THEN 'unfinished: ' || status ELSE 'has ' || n || ' of 2 to keep' END AS reason
FROM ranked WHERE active OR (status <> 'failed' AND n <= 2)""")
def cleanup_skipped(spark, d):
    return retention.plan_cleanup(checkpoints(spark, d), statuses(spark, d), keep=2, purge_failed=True)[1]


@query("disk_usage", f"""
WITH {CHECKPOINTS}
SELECT job_id, any_value(n) AS checkpoints, sum(bytes)::BIGINT AS total_bytes, any_value(status) AS status, any_value(active) AS active,
       CASE WHEN any_value(active) THEN 0 ELSE coalesce(sum(bytes) FILTER (WHERE rn > 1), 0)::BIGINT END AS reclaimable_bytes
FROM ranked GROUP BY job_id""")
def disk_usage(spark, d):
    return retention.disk_usage(checkpoints(spark, d), statuses(spark, d))


@query("disk_totals", f"""
WITH {CHECKPOINTS}, t AS (
  SELECT sum(bytes)::BIGINT AS total_bytes, coalesce(sum(bytes) FILTER (WHERE rn > 1 AND NOT active), 0)::BIGINT AS reclaimable_bytes FROM ranked)
SELECT *, CASE WHEN total_bytes < 1073741824 THEN printf('%.1f MB', total_bytes / 1048576)
               WHEN total_bytes < 1099511627776 THEN printf('%.1f GB', total_bytes / 1073741824)
               ELSE printf('%.1f TB', total_bytes / 1099511627776) END AS total_bytes_human,
       CASE WHEN reclaimable_bytes < 1073741824 THEN printf('%.1f MB', reclaimable_bytes / 1048576)
            WHEN reclaimable_bytes < 1099511627776 THEN printf('%.1f GB', reclaimable_bytes / 1073741824)
            ELSE printf('%.1f TB', reclaimable_bytes / 1099511627776) END AS reclaimable_bytes_human
FROM t""")
def disk_totals(spark, d):
    return retention.size_totals(retention.disk_usage(checkpoints(spark, d), statuses(spark, d)), "total_bytes", "reclaimable_bytes")


@query("size_rollup", """
SELECT o_orderpriority AS priority, count(*) AS files, sum(CAST(round(o_totalprice) AS BIGINT))::BIGINT AS bytes FROM orders GROUP BY 1""")
def size_rollup(spark, d):
    files = table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"),
                                             F.round(F.col("o_totalprice")).cast("long").alias("bytes"))
    return retention.largest_first(retention.size_rollup(files, "priority"))


def _repos(spark, d):
    """Customers as cached repositories, last used with their latest order."""
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("repo_id")).agg(
        F.max("o_orderdate").alias("last_accessed"), F.sum(F.round(F.col("o_totalprice")).cast("long")).alias("bytes"))


_SQL_REPOS = """repos AS (SELECT o_custkey AS repo_id, max(o_orderdate) AS last_accessed,
  sum(CAST(round(o_totalprice) AS BIGINT))::BIGINT AS bytes FROM orders GROUP BY 1),
marked AS (SELECT *, epoch_us(TIMESTAMP '2001-06-01') - epoch_us(last_accessed) > 90 * 86400000000 AS stale FROM repos)"""


@query("stale_cache", f"WITH {_SQL_REPOS} SELECT repo_id, bytes, stale FROM marked")
def stale_cache(spark, d):
    now = at("2001-06-01 00:00:00")
    return retention.mark_stale(_repos(spark, d), now).select("repo_id", "bytes", "stale")


@query("stale_totals", f"""
WITH {_SQL_REPOS} SELECT count(*) AS repos, sum(bytes)::BIGINT AS total_bytes, coalesce(sum(bytes) FILTER (WHERE stale), 0)::BIGINT AS stale_bytes FROM marked""")
def stale_totals(spark, d):
    return retention.stale_totals(_repos(spark, d), at("2001-06-01 00:00:00"))


def _uploads(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("dataset_id"), F.col("ts").alias("uploaded_at"),
                                            (F.get_json_object("props", "$.k").cast("long") * 100_000).alias("bytes"))


_SQL_UPLOADS = f"""up AS (SELECT event_id AS dataset_id, CAST(json_extract_string(props, '$.k') AS BIGINT) * 100000 AS bytes,
  epoch_us({SQL_NOW}) - epoch_us(ts) AS age FROM events)"""


@query("ttl_expired", f"""
WITH {_SQL_UPLOADS}
SELECT dataset_id, bytes, CAST(printf('%.1f', age / 1000000 / 3600) AS DOUBLE) AS age_hours FROM up WHERE age > 86400000000""")
def ttl_expired(spark, d):
    return retention.expired_uploads(_uploads(spark, d), at(NOW)).select("dataset_id", "bytes", "age_hours")


@query("ttl_freed", f"""
WITH {_SQL_UPLOADS}, f AS (SELECT count(*) AS count, coalesce(sum(bytes), 0)::BIGINT AS freed_bytes FROM up WHERE age > 86400000000)
SELECT *, CAST(printf('%.2f', freed_bytes / 1048576) AS DOUBLE) AS freed_mb FROM f""")
def ttl_freed(spark, d):
    return retention.freed(retention.expired_uploads(_uploads(spark, d), at(NOW)))


@query("ttl_remaining", f"""
WITH {_SQL_UPLOADS}
SELECT dataset_id, greatest(0, (86400000000 - age) // 1000000) AS seconds, epoch_us({SQL_NOW}) - age + 86400000000 AS expires FROM up""")
def ttl_left(spark, d):
    listed = retention.list_uploads(_uploads(spark, d), at(NOW))
    zone = F.unix_micros(at(NOW).cast("timestamp")) - F.lit(1705752000000000)   # the session's distance from UTC
    return listed.select("dataset_id", F.col("ttl_remaining_seconds").alias("seconds"), (F.unix_micros("expires_at") - zone).alias("expires"))


@query("expired_artifacts", f"""
SELECT event_id AS job_id, status FROM (SELECT *, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'stopped' ELSE 'completed' END AS status
FROM events) WHERE status <> 'completed' AND epoch_us({SQL_NOW}) - epoch_us(ts) >= 72 * 3600000000""")
def expired_artifacts(spark, d):
    status = F.when(F.col("status") == "error", "failed").when(F.col("status") == "view", "stopped").otherwise("completed")
    return retention.expired_artifacts(runs(spark, d).withColumn("status", status), at(NOW)).select("job_id", "status")


def _model_files(spark, d):
    """Order lines as model files: the supplier is the model, the line number picks the kind of file."""
    n, flag = F.col("l_linenumber"), F.lower("l_returnflag")
    path = (F.when(n == 1, "config.json").when(n == 2, F.concat(F.lit("gguf/model.q4_"), flag, F.lit(".gguf")))
            .when(n == 3, "tokenizer.json").when(n == 4, "adapter_model.safetensors")
            .when(n == 5, F.concat(F.lit("model-"), F.col("l_partkey").cast("string"), F.lit(".safetensors")))
            .when(n == 6, "README.md").otherwise(F.concat(F.lit("logs/"), flag, F.lit(".txt"))))
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("model"), path.alias("path"), F.col("l_quantity").cast("long").alias("bytes"))


_SQL_FILES = """files AS (
  SELECT l_suppkey AS model, l_quantity::BIGINT AS bytes, l_linenumber AS n, lower(l_returnflag) AS flag,
         CASE l_linenumber WHEN 1 THEN 'config' WHEN 2 THEN 'gguf' WHEN 3 THEN 'tokenizer' WHEN 4 THEN 'adapter'
                           WHEN 5 THEN 'merged' WHEN 6 THEN 'readme' ELSE 'other' END AS category FROM lineitem)"""


@query("artifact_inventory", f"""
WITH {_SQL_FILES}
SELECT category, CASE WHEN n = 2 THEN 'Q4_' || upper(flag) END AS quant_type, n IN (1, 3) AS protected, count(*) AS files, sum(bytes)::BIGINT AS bytes
FROM files GROUP BY ALL""")
def artifact_inventory(spark, d):
    return retention.size_rollup(retention.artifact_inventory(_model_files(spark, d)), "category", "quant_type", "protected")


@query("model_summary", f"""
WITH {_SQL_FILES}
SELECT model, sum(bytes)::BIGINT AS total_bytes, false AS is_lora, bool_or(n = 5) AS has_merged, bool_or(n = 2) AS has_gguf FROM files GROUP BY model""")
def model_summary(spark, d):
    return retention.model_summary(_model_files(spark, d))


@query("queue_positions", """
SELECT o_orderkey AS job_id, row_number() OVER (ORDER BY 6 - CAST(left(o_orderpriority, 1) AS INTEGER) DESC, o_orderdate, o_orderkey) - 1 AS position
FROM orders""")
def queue_positions(spark, d):
    backlog = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("job_id"), (6 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"),
        F.col("o_orderdate").alias("queued_at"))
    return retention.queue_positions(backlog).select("job_id", "position")


@query("unique_names", """
SELECT event_id, event_type || CASE row_number() OVER w WHEN 1 THEN '' ELSE '_' || row_number() OVER w END || '.png' AS unique_name
FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)""")
def unique_names(spark, d):
    files = table(spark, d, "events").select("event_id", F.concat("event_type", F.lit(".png")).alias("name"))
    return retention.unique_names(files, ord="event_id").select("event_id", "unique_name")


# Numbered names of `view.png` by rising number: each was there first if the copies so far have not reached its number.
_NAMED = """RECURSIVE named AS (
  SELECT event_id, CASE event_type WHEN 'click' THEN 'view_' || json_extract_string(props, '$.k') || '.png' ELSE event_type || '.png' END AS name FROM events),
ranked AS (SELECT event_id, name, row_number() OVER (PARTITION BY name ORDER BY event_id) - 1 AS copies FROM named),
firsts AS (
  SELECT name, CAST(regexp_extract(name, '^view_([0-9]+)[.]png$', 1) AS BIGINT) AS number, min(event_id) AS first
  FROM named WHERE regexp_matches(name, '^view_([2-9]|[1-9][0-9]+)[.]png$') GROUP BY name),
kids AS (
  SELECT name, number, row_number() OVER (ORDER BY number) AS i,
         greatest((SELECT count(*) FROM named n WHERE n.name = 'view.png' AND n.event_id < f.first) - 1, 0) AS asked
  FROM firsts f WHERE EXISTS (SELECT 1 FROM named WHERE name = 'view.png')),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS claimed, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS BIGINT) AS number, false AS own
  UNION ALL
  SELECT k.i, w.claimed + CASE WHEN w.claimed < k.number - 1 - k.asked THEN 1 ELSE 0 END, k.name, k.number, w.claimed < k.number - 1 - k.asked
  FROM walk w JOIN kids k ON k.i = w.i + 1),
claims AS (SELECT number - (row_number() OVER (ORDER BY number) - 1) - 2 AS free_ahead FROM walk WHERE own),
asks AS (
  SELECT event_id, r.name, copies + CASE WHEN w.own IS NOT NULL AND NOT w.own THEN 1 ELSE 0 END AS c FROM ranked r LEFT JOIN walk w ON w.name = r.name)"""


@query("unique_names_mixed", f"""
WITH {_NAMED}
SELECT event_id, CASE WHEN c = 0 THEN name ELSE replace(name, '.png', '_' || (c + 1 + CASE WHEN name = 'view.png' THEN
         (SELECT count(*) FROM claims WHERE free_ahead < c) ELSE 0 END) || '.png') END AS unique_name FROM asks""")
def unique_names_mixed(spark, d):
    """Names of which some look like numbered copies of others."""
    k = F.get_json_object("props", "$.k")
    name = F.when(F.col("event_type") == "click", F.concat(F.lit("view_"), k, F.lit(".png"))).otherwise(F.concat("event_type", F.lit(".png")))
    named = retention.unique_names(table(spark, d, "events").select("event_id", name.alias("name")), ord="event_id")
    return named.select("event_id", "unique_name")


# ---- streams -------------------------------------------------------------------------------------------

def _stream(spark, d):
    """Events arriving in four lots of rising ids, one for each micro-batch: state is carried from one to the next.

    Streams take the oldest files first, so the lots are written one after the other, each as the same number of files:
    more as the table grows, and files without rows where a lot has too few rows for them.
    """
    path, events = scratch_path(spark, "events"), table(spark, d, "events")
    last, rows = events.agg(F.max("event_id"), F.count("*")).first()
    files, last = max(1, -(-rows // (4 * ROWS))), last or 0
    for i in range(4):
        low, high = (last + 1) * i // 4, (last + 1) * (i + 1) // 4
        lot = events.where(F.col("event_id").between(low, high - 1))
        lot = lot.coalesce(1) if files == 1 else lot.repartition(files).sortWithinPartitions("event_id")
        lot.write.mode("append").parquet(path)
        for _ in range(files * (i + 1) - _files(spark, path)):
            events.where(F.lit(False)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(EVENT_COLUMNS).option("maxFilesPerTrigger", files).parquet(path)


def _files(spark, path):
    return spark.read.format("binaryFile").load(path).select("path").count()


def _stream_points(spark, d):
    return _stream(spark, d).select(
        F.col("user_id").cast("string").alias("job_id"), F.col("event_id").alias("_ord"),
        F.get_json_object("props", "$.k").cast("long").alias("step"), F.col("value").alias("loss"), F.col("event_type").alias("status"))


def _done(stream_query):
    stream_query.awaitTermination()
    if stream_query.exception():
        raise stream_query.exception()


@query("stream_monotone_steps", _MONOTONE)
def stream_monotone_steps(spark, d):
    out = scratch_path(spark, "monotone")
    _done(progress.keep_monotone(_stream_points(spark, d), out, f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/points").select(F.col("job_id").cast("long"), F.col("_ord").alias("event_id"), "step", "loss")


@query("stream_latest_state", f"""
WITH {POINTS}
SELECT job_id, arg_max(status, event_id) AS status, arg_max(step, event_id) AS step FROM points GROUP BY job_id""")
def stream_latest_state(spark, d):
    out = scratch_path(spark, "state")
    _done(progress.write_state(_stream_points(spark, d), f"{out}/batches", f"{out}/checkpoint", ["status", "step"], seq="_ord"))
    batches = spark.read.parquet(f"{out}/batches")
    newest = F.max_by(F.struct("status", "step"), "batch")
    return batches.groupBy(F.col("job_id").cast("long").alias("job_id")).agg(newest.alias("s")).select("job_id", "s.*")


LOG_COLUMNS = f"job_id string, {progress.EVENT_SCHEMA}"


def _event_log(spark, d):
    """Events as a folder of JSON lines, with a blank and a broken line in between."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = (F.when(F.col("event_type") == "click", "metrics").when(F.col("event_type") == "view", "eval")
            .when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "status").otherwise("unheard"))
    doc = F.struct(F.col("user_id").cast("string").alias("job_id"), kind.alias("type"), F.when(kind == "metrics", k).alias("current_step"), F.lit(100).alias("total_steps"),
                   F.when(kind == "metrics", F.col("value")).alias("loss"), F.when(kind == "eval", F.col("value")).alias("eval_loss"),
                   F.when(kind == "error", F.lit("boom")).alias("error"))
    lines = F.array(F.to_json(doc), F.lit(""), F.lit('{"type": "metrics", "loss":'))
    path = scratch_path(spark, "log")
    table(spark, d, "events").select(F.explode(lines).alias("value")).repartition(4).write.text(path)
    return path


@query("stream_metrics_append", f"""
WITH {POINTS} SELECT job_id, step, loss FROM points WHERE status = 'click' AND step > 0""")
def stream_metrics_append(spark, d):
    out, log = scratch_path(spark, "metrics"), _event_log(spark, d)
    events = progress.tail_events(spark, log, files_per_batch=2, schema=LOG_COLUMNS)
    _done(progress.append_metrics(progress.as_metrics(events), f"{out}/table", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/table").select(F.col("job_id").cast("long"), "step", "loss")


@query("stream_route", """
SELECT CASE event_type WHEN 'click' THEN 'metrics' WHEN 'view' THEN 'eval' WHEN 'error' THEN 'error' ELSE 'status' END AS type,
       count(*) AS events FROM events WHERE event_type <> 'purchase' GROUP BY 1""")
def stream_route(spark, d):
    out, log = scratch_path(spark, "routed"), _event_log(spark, d)
    events = progress.tail_events(spark, log, files_per_batch=2, schema=LOG_COLUMNS)
    _done(progress.route_events(events, f"{out}/table", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/table").groupBy("type").agg(F.count("*").alias("events"))


def _grow(lines, root, parts=8):
    """Write (log, at, value) lines into one file for each log, in the order of `at`; a file written again grows, as far as its lines begin alike."""
    def write(batches):
        import pyarrow as pa
        system, folder = open_folder(root)
        name, out, rows = None, None, 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["log"] != name:
                    if out:
                        out.close()
                    name = r["log"]
                    system.create_dir(f"{folder}/{name}")
                    out = system.open_output_stream(f"{folder}/{name}/progress.jsonl")
                out.write(r["value"].encode() + b"\n")
                rows += 1
        if out:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([rows])], ["rows"])

    ordered = lines.repartition(parts, "log").sortWithinPartitions("log", "at")
    return ordered.select("log", "value").mapInArrow(write, "rows long").agg(F.sum("rows")).first()[0]


@query("stream_tail", """
SELECT CAST(event_id % 8 AS VARCHAR) AS job_id, event_id AS step, value AS loss FROM events WHERE value IS NOT NULL AND event_id > 0""")
def stream_tail(spark, d):
    """Eight logs that grow: read as far as half of the events, then again behind that place."""
    root, out = scratch_path(spark, "growing"), scratch_path(spark, "tailed")
    events = table(spark, d, "events")
    doc = F.struct(F.lit("metrics").alias("type"), F.col("event_id").alias("current_step"), F.col("value").alias("loss"))
    lines = events.select((F.col("event_id") % 8).cast("string").alias("log"), F.col("event_id").alias("at"), F.to_json(doc).alias("value"))
    half = (events.agg(F.max("event_id")).first()[0] or 0) // 2
    for upto in (half, None):
        _grow(lines if upto is None else lines.where(F.col("at") <= upto), root)
        metrics = progress.as_metrics(tail_growing_events(spark, root))
        _done(progress.append_metrics(metrics, f"{out}/table", f"{out}/checkpoint"))
    return spark.read.parquet(f"{out}/table").select("job_id", "step", "loss")


@query("event_updates", """
SELECT CASE event_type WHEN 'error' THEN 'failed' ELSE 'training' END AS status,
       CASE event_type WHEN 'click' THEN 0.5::DOUBLE END AS progress, CASE event_type WHEN 'error' THEN 'boom' END AS error,
       count(*) AS events FROM events WHERE event_type <> 'purchase' GROUP BY ALL""")
def event_updates(spark, d):
    events = progress.parse_events(spark.read.text(_event_log(spark, d)))
    return progress.as_updates(events, keep=[]).groupBy("status", "progress", "error").agg(F.count("*").alias("events"))

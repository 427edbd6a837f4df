import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions.templates import formatter
from pairloom.operators.messages import convert_messages
from pairloom.operators.runs import latest_state, monotone_steps
from pairloom.streaming import progress as P


def done(query):
    query.awaitTermination()
    assert query.exception() is None


POINTS = "job_id string, _ord long, step long, loss double"


@pytest.fixture
def points(spark, tmp_path):
    """Three files of points in arrival order, read one per batch."""
    steps = [5, 3, 6, None, 6, 9, 1, 12, 12, 13, 2, 20]
    data = [("a" if i % 4 else "b", i, s, float(i)) for i, s in enumerate(steps)]
    for part in range(3):
        spark.createDataFrame(data[part * 4:part * 4 + 4], POINTS).coalesce(1).write.parquet(str(tmp_path / f"in/{part}.parquet"))
    stream = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    return stream, spark.read.schema(POINTS).parquet(f"{tmp_path}/in/*.parquet"), str(tmp_path)


def test_monotone_steps_stream_equals_batch(spark, points, rows):
    stream, batch, tmp = points
    done(P.keep_monotone(stream, f"{tmp}/out", f"{tmp}/ck", chunk=2))
    got = spark.read.parquet(f"{tmp}/out/points")
    assert rows(got, "job_id", "_ord", "step") == rows(monotone_steps(batch), "job_id", "_ord", "step")
    assert got.select("batch").distinct().count() == 3


def test_a_restarted_stream_goes_on_where_it_stopped(spark, points, rows):
    stream, batch, tmp = points
    done(P.keep_monotone(stream, f"{tmp}/out", f"{tmp}/ck"))
    late = [("a", 12, 19, 0.0), ("a", 13, 21, 0.0)]
    spark.createDataFrame(late, POINTS).coalesce(1).write.parquet(f"{tmp}/in/3.parquet")
    again = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp}/in/*.parquet")
    done(P.keep_monotone(again, f"{tmp}/out", f"{tmp}/ck"))
    whole = spark.read.schema(POINTS).parquet(f"{tmp}/in/*.parquet")
    assert rows(spark.read.parquet(f"{tmp}/out/points"), "_ord") == rows(monotone_steps(whole), "_ord")


def test_state_stream_equals_batch(spark, points, rows):
    stream, batch, tmp = points
    done(P.write_state(stream, f"{tmp}/state", f"{tmp}/ck", ["step", "loss"], seq="_ord"))
    newest = (spark.read.parquet(f"{tmp}/state").groupBy("job_id").agg(F.max_by(F.struct("step", "loss"), "batch").alias("s"))
              .select("job_id", "s.*"))
    assert rows(newest) == rows(latest_state(batch, ["step", "loss"], seq="_ord"))


EVENTS = [
    {"type": "metrics", "loss": 2.5, "learning_rate": 0.1, "current_step": 1, "total_steps": 10, "progress": 0.36},
    {"type": "metrics", "current_step": 2}, {"type": "eval", "eval_loss": 1.5}, {"type": "eval"}, {"type": "status", "message": "hi"},
    {"type": "status", "status": "stopping"}, {"type": "completed"}, {"type": "error"}, {"type": "error", "error": "oom"}, {"type": "other"}, {}]


@pytest.fixture
def log(tmp_path):
    for job in ("j1", "j2"):
        (tmp_path / "log" / job).mkdir(parents=True)
        lines = [json.dumps(e) for e in EVENTS] + ["", "  ", '{"type": "metrics", "loss', "[1]", "5"]
        (tmp_path / "log" / job / "0.jsonl").write_text("\n".join(lines) + "\n")
    return str(tmp_path)


def test_parsing_skips_blank_and_broken_lines(spark, log):
    events = P.parse_events(spark.read.text(f"{log}/log/*/"))
    assert events.count() == 2 * len(EVENTS)
    assert P.of_type(events, "eval").count() == 4
    with pytest.raises(ValueError):
        P.of_type(events, "nothing")


def test_updates(spark, log):
    events = P.parse_events(spark.read.text(f"{log}/log/j1/").withColumn("job_id", F.lit("j1")), ["job_id"])
    got = {tuple(r) for r in P.as_updates(events).select("type", "status", "progress", "loss", "eval_loss", "message", "error", "output_dir").collect()}
    assert got == {
        ("metrics", "training", 0.36, 2.5, None, None, None, None), ("metrics", "training", 0.5, None, None, None, None, None),
        ("eval", "training", None, None, 1.5, None, None, None), ("status", "training", None, None, None, "hi", None, None),
        ("status", "stopping", None, None, None, None, None, None), ("completed", "completed", None, None, None, None, None, ""),
        ("error", "failed", None, None, None, None, "Unknown error", None), ("error", "failed", None, None, None, None, "oom", None)}


def test_metrics_are_appended_once(spark, log, rows):
    def run():
        done(P.append_metrics(P.as_metrics(P.tail_events(spark, f"{log}/log/*/", 1)), f"{log}/metrics", f"{log}/ck"))
        return rows(spark.read.parquet(f"{log}/metrics"), *P.METRIC_COLUMNS)

    want = [("j1", 1, 2.5, None, 0.1, None), ("j2", 1, 2.5, None, 0.1, None)]
    assert run() == want
    assert run() == want
    with open(f"{log}/log/j1/1.jsonl", "w") as f:
        f.write(json.dumps({"type": "metrics", "loss": 2.0, "current_step": 5}) + "\n")
    assert run() == sorted([*want, ("j1", 5, 2.0, None, None, None)], key=repr)


def test_routing(spark, log):
    done(P.route_events(P.tail_events(spark, f"{log}/log/*/"), f"{log}/routed", f"{log}/ck"))
    counts = {r["type"]: r["count"] for r in spark.read.parquet(f"{log}/routed").groupBy("type").count().collect()}
    assert counts == {"metrics": 4, "eval": 4, "status": 4, "completed": 2, "error": 4}


def test_preparing_a_stream(spark, tmp_path, rows):
    schema = "id int, messages array<struct<role:string,content:string>>"
    data = [(i, [("user", f"q{i % 3}"), ("assistant", f"a{i % 3}")]) for i in range(9)]
    for part in range(3):
        spark.createDataFrame(data[part::3], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{part}.parquet"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    out = formatter("mistral")(P.drop_repeats(convert_messages(stream, on_error="drop")))
    done(out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out"))
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "prompt", "chosen") == [(f"[INST] q{i} [/INST] ", f"a{i}") for i in range(3)]


def test_numbers_beside_nulls_stay_exact(spark, tmp_path, rows):
    schema = "job_id long, _ord long, step long, big long, at timestamp, tags array<string>"
    import datetime
    at = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)
    data = [(2**60 + 1, 0, 5, 2**62 + 1, at, ["a"]), (None, 1, 7, None, None, None), (2**60 + 1, 2, 6, None, None, []),
            (2**60, None, 9, 2**53 + 1, at, None), (2**60, 4, 10, 1, None, None), (None, 5, 7, 3, at, None)]
    spark.createDataFrame(data, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    done(P.keep_monotone(stream, f"{tmp_path}/out", f"{tmp_path}/ck"))
    got = spark.read.parquet(f"{tmp_path}/out/points").drop("batch")
    assert rows(got) == sorted([data[0], data[1], data[2], data[3], data[4]], key=repr) and dict(got.dtypes)["big"] == "bigint"


def test_rising_points_of_parts_hold_those_of_the_whole():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        run, ord, step = rng.integers(0, 4, n), rng.permutation(n), rng.integers(-5, 12, n)
        want = [i for i in range(n) if all(step[i] > step[j] for j in range(n) if run[j] == run[i] and ord[j] < ord[i])]
        assert sorted(P._rising(run, ord, step)) == want
        cut = n // 2
        parts = np.concatenate([P._rising(run[:cut], ord[:cut], step[:cut]), cut + P._rising(run[cut:], ord[cut:], step[cut:])])
        again = parts[P._rising(run[parts], ord[parts], step[parts])]
        assert sorted(again) == want


def test_state_grows_with_runs_and_lies_on_disk(spark, points):
    stream, _, tmp = points
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    query = P.keep_monotone(stream, f"{tmp}/out", f"{tmp}/ck")
    done(query)
    state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert state[-1]["numRowsTotal"] == 2 and max(s["numRowsUpdated"] for s in state) <= 2
    assert "rocksdbCommitFlushLatency" in " ".join(state[-1]["customMetrics"])
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before


def test_repeats_are_dropped_with_state_on_disk(spark, tmp_path):
    for part in range(3):
        ids = spark.range(300 * part, 300 * part + 600)
        ids.select((F.col("id") % 1000).cast("string").alias("prompt"), F.lit("c").alias("chosen")).coalesce(1).write.parquet(str(tmp_path / f"in/{part}.parquet"))
    stream = spark.readStream.schema("prompt string, chosen string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*.parquet")
    with P.disk_state(spark):
        query = (P.drop_repeats(stream, "prompt").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck")
                 .trigger(availableNow=True).start(f"{tmp_path}/out"))
    done(query)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == out.select("prompt").distinct().count() == 1000
    state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert state[-1]["numRowsTotal"] == 1000 and "rocksdbBytesCopied" in state[-1]["customMetrics"]

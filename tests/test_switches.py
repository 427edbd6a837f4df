"""Inputs that once changed an answer: nulls, ties, repeated edits, broken text, large values, lost state."""

import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairloom.functions import rendering, text
from pairloom.operators import dedup, edits, order, reshape, retention, runs, vision
from pairloom.sources import read
from pairloom.streaming import progress


def test_large_values_and_truth_values(spark):
    values = [1e20, -1e20, float("inf"), 2.0**52, 0.35, -2.5, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(text.round_half_even(F.col("x"), 1)).collect()] == [1e20, -1e20, float("inf"), 2.0**52, 0.3, -2.5, None]
    flags = spark.createDataFrame([(True, 1, "true"), (False, 2, "x"), (None, None, None)], "b boolean, i int, s string")
    assert [tuple(r) for r in flags.select(*[text.text_or_empty(F.col(c)) for c in "bis"]).collect()] == [("True", "1", "true"), ("False", "2", "x"), ("", "", "")]


def test_unreadable_times_come_last(spark):
    df = spark.createDataFrame([("a", "x", "soon"), ("b", "x", "2024-01-02"), ("c", "x", None), ("d", "x", "2024-01-03")], "job_id string, status string, created_at string")
    assert [r["job_id"] for r in runs.list_runs(df).collect()] == ["d", "b", "a", "c"]


@pytest.mark.parametrize("block", [100, 2])
def test_records_without_a_step_count_in_summaries(spark, block):
    df = spark.createDataFrame([("j", s, float(i)) for i, s in enumerate([None, 5, None, 3, None, 7, None, None])], "job_id string, step long, loss double")
    got = runs.run_summary(df.withColumn("_ord", F.col("loss").cast("long")), ord="_ord", block=block).first()
    assert (got["records"], got["middle_step"], got["middle_loss"]) == (8, None, 7.0)


def test_exact_keys_see_every_column(spark):
    df = spark.sql("select 1L as _ord, 'a' as _id, named_struct('t', timestamp_micros(1)) as s union all "
                   "select 2L, 'b', named_struct('t', timestamp_micros(1)) union all "
                   "select 3L, 'a', named_struct('t', timestamp_micros(2)) union all select 4L, 'a', named_struct('t', timestamp_micros(1))")
    for limit in (10, 0):
        assert sorted(r["_ord"] for r in dedup.deduplicate(df, "exact", broadcast_keys=limit).collect()) == [1, 2, 3]


def test_the_last_edit_counts(spark):
    lines = spark.createDataFrame([(i, json.dumps({"prompt": f"p{i}"}), "/") for i in range(3)], "row_index long, line string, base string")
    changes = spark.createDataFrame([(1, "late", 2), (1, "early", 1), (0, "gone", 1), (2, "x", 1), (2, None, 2)], "row_index long, prompt string, edit int")
    deletes = spark.createDataFrame([(0,)], "row_index long")
    got = {r["row_index"]: (json.loads(r["line"])["prompt"], r["edited"]) for r in edits.apply_edits(lines, changes, deletes).collect()}
    assert got == {1: ("late", True), 2: ("p2", False)}
    assert edits.edit_report(lines, changes, deletes).first().asDict() == {"total_before": 3, "total_after": 2, "edited": 1, "deleted": 1}


def test_previews_have_no_hidden_limit(spark):
    lines = spark.createDataFrame([(i, json.dumps({"image": f"{i}.png"}), "/") for i in range(300)], "row_index long, line string, base string")
    page = vision.manifest_page(lines, limit=250)
    assert page.rows.count() == 250 and page.total == 300


def test_runs_without_checkpoints_are_listed(spark):
    inventory = spark.createDataFrame([("a", "checkpoint-1", 5), ("b", "logs", 7)], "job_id string, checkpoint string, bytes long")
    statuses = spark.createDataFrame([("a", "completed"), ("b", "completed")], "job_id string, status string")
    got = {r["job_id"]: (r["checkpoints"], r["total_bytes"], r["reclaimable_bytes"]) for r in retention.disk_usage(inventory, statuses).collect()}
    assert got == {"a": (1, 5, 0), "b": (0, 0, 0)}


def test_broken_text(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": "1"}\n{"a": \n{"a": "3"}\n')
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3,4,5\n")
    for name in ("x.jsonl", "x.csv"):
        with pytest.raises((PySparkException, ValueError, Py4JJavaError)):   # by schema inference, or by the pass that lands the text
            read.read_file(spark, str(tmp_path / name)).collect()
        assert len(read.read_file(spark, str(tmp_path / name), on_error="drop").select("a").collect()) == (2 if name == "x.jsonl" else 1)
        kept = {r["a"]: r["_error"] for r in read.read_file(spark, str(tmp_path / name), on_error="quarantine").collect()}
        assert [v for v in kept.values() if v] == ['{"a": ' if name == "x.jsonl" else "3,4,5"]
    with pytest.raises(ValueError):
        read.read_file(spark, str(tmp_path / "x.csv"), on_error="ignore")


def test_ordinals_that_would_collide_stop_the_job(spark):
    sources = [spark.createDataFrame([(o,)], "_ord long") for o in (1, 2**55)]
    with pytest.raises(PySparkException, match="out of range"):
        reshape.concat_sources(sources).collect()
    assert reshape.concat_sources([sources[0], spark.createDataFrame([(None,)], "_ord long")]).count() == 2


def test_lost_state_stops_a_stream(spark, tmp_path):
    import shutil
    schema = "job_id string, _ord long, step long"
    run = lambda: progress.keep_monotone(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    for i, steps in enumerate([(1, 5), (4, 6)]):
        spark.createDataFrame([("j", 10 * i + k, s) for k, s in enumerate(steps)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
    assert sorted(r["step"] for r in spark.read.parquet(f"{tmp_path}/out/points").collect()) == [1, 5, 6]
    shutil.rmtree(f"{tmp_path}/checkpoint/state")   # where the runs' last steps are
    spark.createDataFrame([("j", 30, 2)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(PySparkException):
        run()


def test_latest_state_of_silent_runs_and_null_keys(spark):
    rows = [("a", 1, "x", None), ("a", 2, None, 5), ("b", 1, None, None), (None, 3, "z", 1)]
    df = spark.createDataFrame(rows, "job_id string, seq long, status string, step int")
    got = {r["job_id"]: (r["status"], r["step"]) for r in runs.latest_state(df, ["status", "step"]).collect()}
    assert got == {"a": ("x", 5), "b": (None, None), None: ("z", 1)}


def test_call_arguments_keep_their_order(spark):
    schema = "messages array<struct<role:string,content:string,tool_calls:array<struct<function:struct<name:string,arguments:string>>>>>"
    rows = [([("user", "q", None), ("Assistant", None, [(("f", '{"z": 1, "a": [2], "m": "é\\n"}'),), (("g", "no json"),), (("h", None),), (("i", "null"),)])],)]

    def render(messages, tools=None, **kw):
        return "".join(f"[{m['role']}]{m['content']}" + json.dumps([c["function"] for c in m.get("tool_calls", [])]) + "!" for m in messages)

    flat = spark.createDataFrame(rows, schema).select(rendering.flatten_tools(spark.createDataFrame(rows, schema), render).alias("f")).first()["f"]
    # The frame of a plain turn ends in an empty list of calls, which these turns do not have.
    assert "ToolRenderError" in flat["error"]

    def plain(messages, tools=None, **kw):
        return "".join(f"[{m['role']}]{m['content']}" + "".join(json.dumps(c["function"]) for c in m.get("tool_calls", [])) + "!" for m in messages)

    df = spark.createDataFrame(rows, schema)
    flat = df.select(rendering.flatten_tools(df, plain).alias("f")).first()["f"]
    calls = [{"name": "f", "arguments": {"z": 1, "a": [2], "m": "é\n"}}, {"name": "g", "arguments": "no json"}, {"name": "h", "arguments": {}}, {"name": "i", "arguments": {}}]
    assert flat["chosen"] == "".join(map(json.dumps, calls)) and flat["prompt"] == "q"


def test_frames_give_back_what_a_template_shows():
    def render(messages, tools=None, **kw):
        return "<s>" + "".join(f"<{m['role']}>{m['content']}</{m['role']}>" for m in messages)

    frames = rendering.TurnFrames(render)
    for role in ("user", "assistant", "system"):
        head, tail = frames.frame(role)
        turn = {"role": role, "content": "some text"}
        assert head + frames.content_like(turn, role) + tail == render(frames.scene(turn))
    with pytest.raises(rendering.ToolRenderError):
        frames.content_like({"role": "tool", "content": "x"}, "user")
    with pytest.raises(rendering.ToolRenderError):
        rendering.TurnFrames(lambda m, **kw: "constant").frame("user")
    with pytest.raises(rendering.ToolRenderError):
        rendering.TurnFrames(lambda m, **kw: "".join(x["content"] * 2 for x in m)).frame("user")

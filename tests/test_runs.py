import json
import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import order
from pairloom.operators import runs as R

RUNS = "job_id string, status string, created_at string, config string"


@pytest.fixture(scope="module")
def runs(spark):
    data = [(f"j{i:03}", ["completed", "failed", "training"][i % 3], f"2024-01-{1 + i % 28:02}T00:00:{i % 60:02}",
             json.dumps({"base_model": f"m{i}", "output_name": None})) for i in range(90)]
    return data, spark.createDataFrame(data, RUNS).repartition(4)


def newest(data, status=None):
    return [r[0] for r in sorted(sorted(data), key=lambda r: r[2], reverse=True) if status in (None, r[1])]


def test_listing(runs):
    data, df = runs
    assert [r["job_id"] for r in R.list_runs(df, limit=10, offset=5).collect()] == newest(data)[5:15]
    assert [r["job_id"] for r in R.list_runs(df, "failed", 5).collect()] == newest(data, "failed")[:5]


def test_deep_listing(runs, monkeypatch):
    monkeypatch.setattr(R, "WIDE", 8)
    monkeypatch.setattr(order, "SMALL", 8)
    data, df = runs
    for limit, offset in ((10, 40), (10, 85), (5, 200), (30, 0)):
        assert [r["job_id"] for r in R.list_runs(df, limit=limit, offset=offset).collect()] == newest(data)[offset:offset + limit]
    together = df.withColumn("created_at", F.lit("2024-01-01T00:00:00"))
    assert [r["job_id"] for r in R.list_runs(together, limit=5, offset=50).collect()] == [f"j{i:03}" for i in range(50, 55)]


def test_counts_lookup_and_summary(spark, runs):
    _, df = runs
    assert {tuple(r) for r in R.runs_by_status(df).collect()} == {("completed", 30), ("failed", 30), ("training", 30)}
    assert tuple(R.store_totals(df, spark.range(7)).first()) == (90, 7)
    row = R.summarise_config(R.find_run(df, "j007")).first()
    assert (row["base_model"], row["output_name"], row["training_mode"]) == ("m7", "", "")


def test_metric_series(spark):
    df = spark.createDataFrame([("a", 3), ("b", 1), ("a", 1), ("a", 2)], "job_id string, step int")
    assert [r["step"] for r in R.run_metrics(df, "a").collect()] == [1, 2, 3]


def replay(updates, fields):
    """Apply updates one after the other."""
    state = {}
    for job, _, cleared, *values in sorted(updates, key=lambda u: u[1]):
        row = state.setdefault(job, dict.fromkeys(fields))
        for f, v in zip(fields, values, strict=True):
            if v is not None or f in (cleared or []):
                row[f] = v
    return state


def test_latest_state(spark):
    rng = random.Random(8)
    fields = ["status", "loss", "worker_pid"]
    data = [(rng.choice("aaab"), i, rng.choice([None, ["worker_pid"], ["status"]]), rng.choice([None, "x", "y"]),
             rng.choice([None, 0.5, 1.5]), rng.choice([None, 1, 2])) for i in range(60)]
    df = spark.createDataFrame(data, "job_id string, seq long, cleared array<string>, status string, loss double, worker_pid long")
    # Only the two clearable fields can be set to null; a listed status is kept.
    known = [(j, s, [c for c in (cl or []) if c in R.CLEARABLE], *v) for j, s, cl, *v in data]
    got = {r["job_id"]: {f: r[f] for f in fields} for r in R.latest_state(df.repartition(3), fields, cleared="cleared").collect()}
    assert got == replay(known, fields)
    stamped = R.latest_state(df, ["loss"], updated="seq").collect()
    assert {r["job_id"]: r["updated_at"] for r in stamped} == {j: max(u[1] for u in data if u[0] == j) for j in "ab"}


@pytest.mark.parametrize("block", [1, 9, 10**6])
def test_monotone_steps(spark, block):
    rng = random.Random(9)
    data = [(rng.choice("hhhx"), i, rng.choice([None, *range(40)])) for i in range(150)]
    kept, last = [], {}
    for job, i, step in data:
        if step is not None and (job not in last or step > last[job]):
            kept.append(i)
            last[job] = step
    df = spark.createDataFrame(data, "job_id string, _ord long, step long").repartition(5)
    assert sorted(r["_ord"] for r in R.monotone_steps(df, block=block).collect()) == kept


@pytest.mark.parametrize("block", [1, 10, 10**6])
@pytest.mark.parametrize("ord", [None, "at"])
def test_run_summary(spark, block, ord):
    rng = random.Random(10)
    series = {"one": 1, "two": 2, "three": 3, "hot": 101, "even": 10, "same": 40}
    data = []
    for job, n in series.items():
        steps = [5] * n if job == "same" else rng.sample(range(1000), n)
        data += [(job, s, float(rng.choice([0, 1, 2, 5]))) for s in steps]
    data = [(*row, i) for i, row in enumerate(rng.sample(data, len(data)))]
    df = spark.createDataFrame(data, "job_id string, step long, loss double, at long").repartition(4)
    got = {r["job_id"]: r for r in R.run_summary(df, ord=ord, block=block).collect()}
    for job, n in series.items():
        points = sorted((s, i if ord else v, s, v) for j, s, v, i in data if j == job)
        points = [p[2:] for p in points]
        r, middle = got[job], points[n // 2] if n > 2 else (None, None)
        assert (r["records"], r["first_step"], r["first_loss"], r["last_step"], r["last_loss"]) == (n, *points[0], *points[-1])
        assert r["middle_step"] == middle[0]
        if ord or job != "same":
            assert r["middle_loss"] == middle[1]
        a, b = points[0][1], points[-1][1]
        assert r["improvement_pct"] == ((a - b) / a * 100 if n >= 2 and a and b else None)


def test_saved_configs(spark, tmp_path):
    for name, tags, at in (("old", ["x"], "2024-01-01"), ("new", ["x", "y"], "2024-02-01"), ("other", [], "2024-03-01")):
        doc = {"base_model": "m", "_metadata": {"name": name, "tags": tags, "modified_at": at}}
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "bare.json").write_text("{}")
    assert [r["filename"] for r in R.list_configs(spark, str(tmp_path)).collect()] == ["other", "new", "old", "bare"]
    assert [r["filename"] for r in R.list_configs(spark, str(tmp_path), "x").collect()] == ["new", "old"]
    assert R.list_configs(spark, str(tmp_path), "y").select(F.col("tags")).first()[0] == ["x", "y"]

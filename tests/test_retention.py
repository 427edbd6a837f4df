import os
import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import retention as R

INVENTORY = "job_id string, checkpoint string, bytes long"
STATUS = "job_id string, status string"


@pytest.fixture(scope="module")
def jobs(spark):
    inventory = [("finished", f"checkpoint-{n}", 1000) for n in (100, 200, 300)] + [
        ("lonely", "checkpoint-50", 500), ("broke", "checkpoint-10", 700),
        ("busy", "checkpoint-1", 1000), ("busy", "checkpoint-2", 1000),
        ("orphan", "checkpoint-9", 10), ("orphan", "checkpoint-10", 20), ("orphan", "notes", 5)]
    statuses = [("finished", "completed"), ("lonely", "completed"), ("broke", "failed"), ("busy", "training")]
    return spark.createDataFrame(inventory, INVENTORY), spark.createDataFrame(statuses, STATUS)


def test_plan_keeps_the_newest_and_spares_active_runs(jobs, rows):
    deletions, skipped = R.plan_cleanup(*jobs, keep=1)
    assert rows(deletions) == [
        ("finished", "checkpoint-100", 1000, "older than checkpoint-300"),
        ("finished", "checkpoint-200", 1000, "older than checkpoint-300"),
        ("orphan", "checkpoint-9", 10, "older than checkpoint-10")]
    assert rows(skipped) == [("broke", "has 1 of 1 to keep"), ("busy", "unfinished: training"),
                             ("lonely", "has 1 of 1 to keep")]


def test_keep_two(jobs, rows):
    deletions, _ = R.plan_cleanup(*jobs, keep=2)
    assert rows(deletions, "checkpoint", "reason") == [("checkpoint-100", "older than checkpoint-200, checkpoint-300")]
    with pytest.raises(ValueError):
        R.plan_cleanup(*jobs, keep=0)


def test_failed_runs_go_as_a_whole_on_request(jobs, rows):
    deletions, skipped = R.plan_cleanup(*jobs, keep=1, purge_failed=True)
    assert ("broke", None, 700, "failed job, nothing of it is needed") in rows(deletions)
    assert "broke" not in [r[0] for r in rows(skipped)]


def test_disk_usage(jobs, rows):
    usage = {r["job_id"]: (r["total_bytes"], r["reclaimable_bytes"], r["status"], r["active"]) for r in R.disk_usage(*jobs).collect()}
    assert usage == {"finished": (3000, 2000, "completed", False), "lonely": (500, 0, "completed", False),
                     "broke": (700, 0, "failed", False), "busy": (2000, 0, "training", True),
                     "orphan": (30, 10, "unknown", False)}
    total = R.size_totals(R.disk_usage(*jobs), "total_bytes", "reclaimable_bytes").first()
    assert tuple(total) == (6230, 2010, "6.1 KB", "2.0 KB")
    assert [r[0] for r in R.largest_first(R.size_rollup(jobs[0], "job_id"), "bytes", "job_id").collect()][:2] == ["finished", "busy"]


def test_stale_cache(spark):
    repos = spark.createDataFrame([("a", 10, "2024-01-01"), ("b", 20, "2024-05-20"), ("c", 40, None), ("d", 80, "2024-03-03 00:00:00")],
                                  "repo_id string, bytes long, last_accessed string")
    now = F.lit("2024-06-01 00:00:00")
    assert {r["repo_id"]: r["stale"] for r in R.mark_stale(repos, now).collect()} == {"a": True, "b": False, "c": False, "d": False}
    assert tuple(R.stale_totals(repos, now).first()) == (4, 150, 10)


def test_expiry(spark):
    now = F.lit("2024-06-02 00:00:00")
    uploads = spark.createDataFrame([("u1", "2024-06-01 00:00:00", 5), ("u2", "2024-05-31 23:59:59", 7), ("u3", "2024-05-01", 11)],
                                    "dataset_id string, uploaded_at string, bytes long")
    gone = R.expired_uploads(uploads, now)
    assert {r["dataset_id"]: r["age_hours"] for r in gone.collect()} == {"u2": 24.0, "u3": 768.0}
    assert tuple(R.freed(gone).first()) == (2, 18, 0.0)
    runs = spark.createDataFrame([("a", "failed", "2024-05-30 00:00:00"), ("b", "stopped", "2024-05-30 00:00:01"), ("c", "failed", None),
                                  ("d", "completed", "2020-01-01")], "job_id string, status string, created_at string")
    assert {r["job_id"] for r in R.expired_artifacts(runs, now).collect()} == {"a", "c"}


def test_artifact_categories(spark):
    want = {
        "gguf/m.q4_k_m.gguf": ("gguf", "Q4_K_M", False), "gguf/plain.gguf": ("gguf", None, False), "gguf/manifest.json": ("gguf", None, False),
        "m.q8.gguf": ("other", None, False), "tokenizer.json": ("tokenizer", None, True), "vocab.json": ("tokenizer", None, False),
        "sub/config.json": ("config", None, True), "generation_config.json": ("config", None, False), "README.md": ("readme", None, False),
        "adapter_config.json": ("adapter", None, True), "Adapter_model.safetensors": ("adapter", None, False),
        "model-00001.safetensors": ("merged", None, False), "model.safetensors.index.json": ("merged", None, False),
        "processor_config.json": ("processor", None, False), "loss.png": ("other", None, False)}
    files = spark.createDataFrame([("x", p, 3) for p in want], "model string, path string, bytes long")
    got = {r["path"]: (r["category"], r["quant_type"], r["protected"]) for r in R.artifact_inventory(files).collect()}
    assert got == want
    assert tuple(R.model_summary(files).first()) == ("x", 45, True, True, True)


def test_queue(spark):
    backlog = spark.createDataFrame([("a", 0, 5.0), ("b", 1, 9.0), ("c", 0, 1.0), ("d", -1, 0.0)], "job_id string, priority int, queued_at double")
    assert {r["job_id"]: r["position"] for r in R.queue_positions(backlog).collect()} == {"b": 0, "c": 1, "a": 2, "d": 3}


def one_by_one(names):
    """Every name in turn, numbered past all names given out before."""
    used, out = set(), []
    for name in names:
        stem, ending = os.path.splitext(name)
        candidate, n = name, 1
        while candidate in used:
            n += 1
            candidate = f"{stem}_{n}{ending}"
        used.add(candidate)
        out.append(candidate)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_unique_names_match_a_sequential_pass(spark, seed):
    rng = random.Random(seed)
    pools = [["a.png"] * 30 + ["b.png", "c", "c"],
             ["a.png", "a.png", "a_2.png", "a_3.png", "a_2_2.png", "a_5.png", "b"],
             ["a"] * 9 + ["a_2", "a_3", "a_4", "a_2_2", "a_2_3", "a_2_2_2", "a_02", "a_1", "a_10"],
             [f"x_{i}.jpg" for i in range(2, 12)] + ["x.jpg"] * 6,
             ["x.tar.gz", "x.tar_2.gz", "x_2.tar.gz", ".png", "_2.png", "a b_2.png", "a b.png"],
             ["n.png", "n_2.png", "n_2.png", "n_2_2.png", "n_3.png", "n_3_2.png"]]
    names = [rng.choice(pools[seed]) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(names)), "_ord long, name string").repartition(4)
    got = [r["unique_name"] for r in R.unique_names(df, block=7).orderBy("_ord").collect()]
    assert got == one_by_one(names)


@pytest.mark.parametrize("seed", range(3))
def test_large_families_are_settled_over_many_blocks(spark, seed, monkeypatch):
    """One base with very many numbered names in any order, some numbered again; blocks are far smaller than the family."""
    rng = random.Random(seed)
    names = ["x.png"] * 500 + [f"x_{rng.randint(2, 700)}.png" for _ in range(600)] + [f"x_{rng.randint(2, 40)}_{rng.randint(2, 9)}.png" for _ in range(150)] + ["y"] * 20
    rng.shuffle(names)
    df = spark.createDataFrame(list(enumerate(names)), "_ord long, name string").repartition(4)
    got = [r["unique_name"] for r in R.unique_names(df, block=40).orderBy("_ord").collect()]
    assert got == one_by_one(names) and len(set(got)) == len(got)

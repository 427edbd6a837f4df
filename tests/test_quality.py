import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import quality as Q
from tests.conftest import EDGE_TEXTS

SCHEMA = "_ord long, system string, prompt string, chosen string, rejected string, reasoning string"
FIELDS = ("system", "prompt", "chosen", "rejected", "reasoning")


def sample(n):
    rng = random.Random(n)
    return [(i, *[rng.choice([*EDGE_TEXTS, "x" * rng.randrange(1, 30)]) for _ in FIELDS]) for i in range(n)]


def values(data, name):
    return [r[1 + FIELDS.index(name)] for r in data]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 10, 57])
def test_field_stats(spark, n):
    data = sample(n)
    got = {r["field"]: r for r in Q.field_stats(spark.createDataFrame(data, SCHEMA).repartition(3), rounded=True).collect()}
    assert set(got) == set(Q.STAT_FIELDS)
    tokens = 0
    for name in Q.STAT_FIELDS:
        lengths = sorted(0 if v is None or not v.strip() else len(v) for v in values(data, name))
        empty = sum(v is None or not v.strip() for v in values(data, name))
        average = sum(lengths) / max(n - empty, 1)
        r = got[name]
        assert (r["avg_length"], r["min_length"], r["max_length"], r["median_length"], r["empty_count"], r["est_avg_tokens"]) == (
            round(average, 1), lengths[0], lengths[-1], lengths[n // 2], empty, round(average / 4, 0))
        tokens += round(average / 4, 0) * (n - empty) if name in ("prompt", "chosen") else 0
    assert Q.total_tokens(spark.createDataFrame(data, SCHEMA)).first()[0] == tokens


def test_stats_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert Q.field_stats(empty).count() == 0 and Q.total_tokens(empty).first()[0] == 0.0
    only = spark.createDataFrame([("p",)], "prompt string")
    assert [r["field"] for r in Q.field_stats(only).collect()] == ["prompt"]
    assert Q.field_stats(spark.createDataFrame([(1,)], "n int"), rounded=True).count() == 0
    row = Q.overview(only, "sft").first()
    assert (row["total_rows"], row["columns"], row["training_mode"]) == (1, ["prompt"], "sft")
    balance = Q.length_balance(empty).first()
    assert tuple(balance) == (0.0, 0.0, 0.0, 0.0)


def test_length_balance(spark):
    data = [(i, None, "p", c, r, None) for i, (c, r) in enumerate([("aaaa", "b"), ("a", "bb"), ("aa", "bb"), ("aaa", "b")])]
    got = Q.length_balance(spark.createDataFrame(data, SCHEMA), rounded=True).first()
    assert tuple(got) == (2.5, 1.5, 1.67, 50.0)
    gaps = [(0, None, "p", " ", "", None), (1, None, "p", None, "bbb", None), (2, None, "p", "aaaa", None, None), (3, None, "p", "aa", "b", None)]
    got = Q.length_balance(spark.createDataFrame(gaps, SCHEMA)).first()
    assert tuple(got) == (7 / 3, 2.0, 7 / 3 / 2, 1 / 3 * 100)


def printed(v):
    return str(v)


@pytest.mark.parametrize("mode", ["orpo", "dpo", "sft"])
def test_validation(spark, mode):
    data = sample(60)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = Q.validation_counts(df, 5, None, 3, mode=mode).first().asDict()
    fields = {"prompts": "prompt", "chosen": "chosen"} | ({"rejected": "rejected"} if mode == "orpo" else {})
    want = {"total_samples": 60, "empty_rejected": 0, "long_rejected": 0, "long_chosen": 0}
    for label, name in fields.items():
        want[f"empty_{label}"] = sum(not printed(v).strip() for v in values(data, name))
    want["long_prompts"] = sum(len(printed(v)) > 5 for v in values(data, "prompt"))
    if mode == "orpo":
        want["long_rejected"] = sum(len(printed(v)) > 3 for v in values(data, "rejected"))
    assert got == want
    issues = [r["issue"] for r in Q.validation_issues(df, mode).orderBy("_ord", "check").collect()]
    words = {"prompt": "prompt", "chosen": "chosen response", "rejected": "rejected response"}
    assert issues == [f"Row {r[0]}: Empty {words[f]}" for r in data for f in fields.values() if not printed(r[1 + FIELDS.index(f)]).strip()]


def test_missing_column_counts_as_empty(spark):
    df = spark.createDataFrame([(0, "p")], "_ord long, prompt string")
    got = Q.validation_counts(df).first()
    assert got["empty_chosen"] == 1 and got["empty_rejected"] == 1 and got["empty_prompts"] == 0
    assert Q.validation_counts(df, check_rejected=False).first()["empty_rejected"] == 0


def test_reasoning(spark):
    rows = [(0, None, "<think>", "</think>", None, None), (1, None, "<think>a</think>", "c", "r", None), (2, None, "p", "c", "r", " "),
            (3, None, "p", "c", "r", "because"), (4, "</think><think>", "p", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r[0] for r in df.orderBy("_ord").select(Q.row_has_reasoning(df.columns)).collect()] == [False, True, False, True, True]


def test_long_rows(spark):
    texts = spark.createDataFrame([("x" * 8,), ("x" * 9,), (None,)], "messages string")
    assert Q.filter_long(texts, 2).count() == 1
    assert tuple(Q.filter_report(texts, 2).first()) == (3, 1, 2)
    lists = spark.createDataFrame([([1] * 8,), ([1] * 9,)], "messages array<int>")
    assert Q.filter_long(lists, 2).count() == 1


@pytest.mark.parametrize("eval_steps,want", [(0.2, 3), (0.01, 1), (7, 7), (7.9, 7), (0, None), (None, None)])
def test_step_plan(spark, eval_steps, want):
    df = spark.range(35)
    assert tuple(Q.step_plan(df, 2, 2, 2, 3, eval_steps).first()) == (5, 15, want)


def test_aggregations_do_not_depend_on_partitioning(spark):
    df = spark.createDataFrame(sample(90), SCHEMA)
    for fn in (Q.field_stats, Q.length_balance, Q.validation_counts):
        assert sorted(map(tuple, fn(df.repartition(1)).collect())) == sorted(map(tuple, fn(df.repartition(7)).collect()))
    assert df.select(F.col("_ord")).distinct().count() == 90

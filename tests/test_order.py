import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import order
from pairloom.operators.split import sample_rows, shuffle_rows, split, split_if_large


@pytest.fixture
def small(monkeypatch):
    """Let the distributed paths work on small tables."""
    for module in (order,):
        monkeypatch.setattr(module, "SMALL", 10)
        monkeypatch.setattr(module, "WIDE", 10)
        monkeypatch.setattr(module, "FANOUT", 8)


def table(spark, values, name="_ord"):
    return spark.createDataFrame([(v,) for v in values], f"{name} long").repartition(5)


def test_kth_smallest(spark, small):
    rng = random.Random(1)
    cases = [[rng.randrange(-50, 50) for _ in range(300)], [7] * 200 + list(range(20)), [0, 2**62, -2**40, 5],
             [rng.randrange(2**62) for _ in range(200)]]
    for values in cases:
        df = table(spark, values)
        for k in {1, 2, len(values) // 2, len(values)}:
            assert order.kth_smallest(df, "_ord", k) == sorted(values)[k - 1]
        assert order.kth_smallest(df, "_ord", len(values) + 1) is None
    assert order.kth_smallest(table(spark, []), "_ord", 1) is None
    with pytest.raises(ValueError):
        order.kth_smallest(df, "_ord", 0)


def test_kth_smallest_of_the_widest_range(spark, small):
    values = [-2**63] * 40 + [2**63 - 1] * 30 + list(range(-20, 20))
    df = table(spark, values)
    for k in (1, 40, 41, 60, 80, 81, 110):
        assert order.kth_smallest(df, "_ord", k) == sorted(values)[k - 1]


def test_head_where_many_rows_have_no_ordinal(spark, small):
    df = spark.createDataFrame([(i if i % 2 else None, i) for i in range(200)], "_ord long, name long")
    for n in (50, 100, 130):
        got = order.head(df, n).collect()
        assert len({r["name"] for r in got}) == n and sum(r["_ord"] is None for r in got) == min(n, 100)
    train, held = split(df, 0.3, shuffle=False)
    assert train.count() == 140 and held.where("_ord is null").count() == 0 and held.count() == 60


def test_head_and_pages(spark, small):
    values = random.Random(2).sample(range(10**6), 200)
    df, ranked = table(spark, values), sorted(values)
    for n in (0, None, 1, 9, 50, 200, 500):
        assert sorted(r[0] for r in order.head(df, n).collect()) == ranked[:n or None]
    for size, offset in ((5, 0), (5, 3), (20, 50), (20, 190), (50, 400), (0, 30), (30, -4)):
        got = [r[0] for r in order.page_rows(df, size, offset).collect()]
        assert got == ranked[max(0, offset):][:size]
    page = order.page(df, 5, 198)
    assert page.total == 200 and page.rows.count() == 2


def test_number_rows(spark):
    values = random.Random(3).sample(range(10**6), 300)
    df = table(spark, values)
    got = {r["_ord"]: r["_pos"] for r in order.number_rows(df, F.col("_ord").desc()).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values, reverse=True))}
    assert order.number_rows(table(spark, []), "_ord").count() == 0


@pytest.mark.parametrize("fold", [F.max, F.sum])
@pytest.mark.parametrize("block", [1, 7, 10**6])
def test_running_before(spark, fold, block):
    rng = random.Random(4)
    data = [(rng.choice(["hot", "hot", "a", "b", None]), i, rng.choice([None, rng.randrange(-9, 9)])) for i in range(120)]
    df = spark.createDataFrame(data, "k string, o long, v long").repartition(3)
    got = {r["o"]: r["x"] for r in order.running_before(df, F.col("v"), ["k"], "o", "x", fold, block).collect()}
    seen = {}
    for k, o, v in data:
        before = [x for x in seen.get(k, []) if x is not None]
        assert got[o] == (sum(before) if fold is F.sum else max(before, default=None))
        seen.setdefault(k, []).append(v)


@pytest.mark.parametrize("rows,size", [(100, 0.01), (101, 0.01), (1000, 0.013), (7, 0.5), (250, 0.1)])
def test_split_is_exact_disjoint_and_whole(spark, small, rows, size):
    df = table(spark, [i * 37 for i in range(rows)])
    train, held = (sorted(r[0] for r in d.collect()) for d in split(df, size, seed=5))
    want = -(-rows * size // 1)
    assert len(held) == int(want) and not set(train) & set(held)
    assert sorted(train + held) == [i * 37 for i in range(rows)]
    again = sorted(r[0] for r in split(df.repartition(2), size, seed=5)[1].collect())
    assert again == held
    if rows > 50 and len(held) > 5:
        other = sorted(r[0] for r in split(df, size, seed=6)[1].collect())
        assert other != held


def test_split_without_shuffle_takes_the_last_rows(spark, small):
    train, held = split(table(spark, range(50)), 0.1, shuffle=False)
    assert sorted(r[0] for r in held.collect()) == [45, 46, 47, 48, 49] and train.count() == 45


def test_split_off_and_impossible(spark):
    df = table(spark, range(5))
    assert split(df, 0)[1] is None and split(df, None)[0] is df
    for size in (1.5, -0.1):
        with pytest.raises(ValueError):
            split(df, size)
    with pytest.raises(ValueError):
        split(table(spark, [1]), 0.5)


def test_tied_hashes_are_cut_by_ordinal(spark, small, monkeypatch):
    from pairloom.operators import split as module

    monkeypatch.setattr(module, "seeded_hash", lambda seed, *c: F.col("_ord") % 2)
    train, held = split(table(spark, range(20)), 0.25)
    assert sorted(r[0] for r in held.collect()) == [0, 2, 4, 6, 8] and train.count() == 15


def test_split_only_when_large(spark):
    assert split_if_large(table(spark, range(100)), more_than=100)[1] is None
    train, held = split_if_large(table(spark, range(101)), None, more_than=100)
    assert held.count() == 2 and train.count() == 99
    assert split_if_large(table(spark, range(1)))[1] is None and split_if_large(table(spark, range(2)))[1].count() == 1


@pytest.mark.parametrize("n", [900, 1001, 1200, 3000])
def test_heads_and_pages_are_exact_with_ties_and_missing_ordinals(spark, n):
    df = spark.createDataFrame([(None if i % 2 else i // 4,) for i in range(2400)], "_ord long")
    want = sorted((r[0] for r in df.collect()), key=lambda v: -1 if v is None else v)[:n]
    assert sorted((r[0] for r in order.head(df, n).collect()), key=lambda v: -1 if v is None else v) == want
    paged = [r[0] for r in order.page_rows(df, n, 30).collect()]
    assert paged == sorted((r[0] for r in df.collect()), key=lambda v: -1 if v is None else v)[30:30 + n]


def test_sample_and_shuffle(spark, small):
    df = table(spark, range(80))
    assert sample_rows(df, 30, seed=1).distinct().count() == 30
    assert sample_rows(df, 200).count() == 80 and sample_rows(df, None) is df
    mixed = [r[0] for r in shuffle_rows(df, 9).collect()]
    assert mixed == [r[0] for r in shuffle_rows(df.repartition(3), 9).collect()] != sorted(mixed)


@pytest.mark.parametrize("parts", ["1", "3", "7"])
def test_a_shuffle_is_a_sort_by_hash_that_reads_its_rows_once(spark, parts):
    from pairloom.operators.split import seeded_hash

    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = table(spark, range(500)).mapInArrow(count, "_ord long")
        mixed = shuffle_rows(df, 11)
        got = [r[0] for r in mixed.collect()]
        assert read.value == 500
        assert got == [r[0] for r in table(spark, range(500)).orderBy(seeded_hash(11, "_ord")).collect()]
        assert "rangepartitioning" not in mixed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)

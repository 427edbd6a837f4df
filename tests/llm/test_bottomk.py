import itertools
import re

import numpy as np

from pairloom.llm import bottomk
from pairloom.llm.components import components

from .conftest import text

SCHEMA = "doc_id long, text string, n int, hi string, sketch string, component string"


def shingles(t):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if w]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def brute(rows, percent):
    sets, parent = {i: shingles(t) for i, t in rows if i is not None}, {}

    def top(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            p, q = sorted((top(a), top(b)))
            parent[q] = p
    return {i: top(i) for i in sets}


def variants(base, n, seed):
    """Copies with some words replaced, so that similarities spread around the threshold."""
    rng, words = np.random.default_rng(seed), base.split()
    for _ in range(n):
        own = list(words)
        for i in rng.choice(len(own), rng.integers(0, 5), replace=False):
            own[i] = f"q{rng.integers(10 ** 9)}"
        yield " ".join(own)


def test_groups_are_those_of_all_pairs(table):
    texts = [text(1, 120)] * 5 + list(variants(text(2, 150), 60, 0)) + list(variants(text(3, 60), 30, 1)) + [text(100 + i, 40) for i in range(20)]
    passage = text(9, 60)  # in many documents that are otherwise different
    texts += [f"{text(200 + i, 50)} {passage}" for i in range(50)] + [None, "", " \n", "a b c", "A  B\tc", "a b", "one two three four five"] * 2
    rows = list(enumerate(texts))
    got = bottomk.near_duplicates(table([(i, t, 1, "h", "s", "c") for i, t in rows], SCHEMA), percent=85).collect()
    want = brute(rows, 85)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(shingles(t)) for i, t in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(rows)


def test_nulls_repeats_and_empty_tables(table):
    rows = [(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (7, "a b c"), (8, None)]
    make = lambda rows: table([(i, t, 1, "h", "s", "c") for i, t in rows], SCHEMA)
    got = sorted((tuple(r) for r in bottomk.near_duplicates(make(rows)).collect()), key=repr)
    assert got == sorted([(None, 1, None, True)] * 2 + [(5, 1, 5, True)] * 2 + [(7, 1, 5, False), (8, 0, 8, True)], key=repr)
    kept = bottomk.drop_near_duplicates(make(rows))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["5", "5", "8", "None", "None"]
    assert bottomk.near_duplicates(make([])).collect() == []


def test_components(table):
    links = [(1, 2), (2, 3), (5, 4), (4, 5), (6, 6), (None, 1), (9, 8), (8, 7), (3, 9)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(map(tuple, components(table(links, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 8: 1, 7: 1, 4: 4, 5: 4} | {100 + i: 100 for i in range(41)}
    assert components(table([], "a long, b long")).collect() == []


def test_overlaps_and_estimates():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 500, n).astype(np.uint64)) for n in (0, 1, 30, 300, 300)]
    assert bottomk.overlaps(sets, sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    full = bottomk.union_estimate(*([x.astype(np.int32) for x in s] for s in (sets, sets[::-1])), 500)
    assert np.allclose(full, [len(np.intersect1d(a, b)) / max(len(np.union1d(a, b)), 1) for a, b in zip(sets, sets[::-1])])


def test_steps_of_small_tables_take_few_tasks(spark, table):
    """However many tasks shuffles have, a step reads and writes few edges in few tasks; all tasks leave files behind."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before, tracker = [spark.conf.get(n) for n in names], spark.sparkContext.statusTracker()
    links = table([(i, i + 1) for i in range(60)], "a long, b long")
    try:
        for name, value in zip(names, ("40", "false")):
            spark.conf.set(name, value)
        spark.sparkContext.setJobGroup("few-tasks", "")
        groups = components(links)
        stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
        took = sorted(i.numTasks for i in map(tracker.getStageInfo, stages) if i and i.numCompletedTasks)
        assert {r["component"] for r in groups.collect()} == {0}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    assert len([n for n in took if n >= 80]) <= 1, took  # both directions of the edges as the first distinct left them


def test_components_are_the_same_without_broadcasts(table, monkeypatch):
    links = [(1, 2), (2, 3), (5, 4), (4, 5), (6, 6), (None, 1), (3, 9), (9, 8)] + [(100 + i, 101 + i) for i in range(20)] + [(200, 201 + i) for i in range(20)]
    few = sorted(map(tuple, components(table(links, "a long, b long")).collect()))
    monkeypatch.setattr("pairloom.llm.components.FEW", 0)
    monkeypatch.setattr("pairloom.llm.components.PART", 4)
    assert sorted(map(tuple, components(table(links, "a long, b long")).collect())) == few

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from pairloom.llm import ngram
from pairloom.llm.langid import fold

from .conftest import text

SCHEMA = "doc_id long, text string, score int, role string, id int"


def tokens(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if w] + [None]


def corpus():
    rng = np.random.default_rng(0)
    words = text(1, 40).split()
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 60)), p=np.arange(1, 41) / 820)) for _ in range(60)]
    return [(i, t, 1, "r", 2) for i, t in enumerate(texts + [None, "", " \n", "Unseen WORDS only", texts[0].upper()])]


@pytest.mark.parametrize("size, keys", [(1 << 20, 1 << 19), (50, 16)])
def test_scores_are_those_of_plain_counts(table, monkeypatch, size, keys):
    monkeypatch.setattr(ngram, "TOKENS", size)
    monkeypatch.setattr(ngram, "KEYS", keys)
    learned = []
    learn = ngram.learn
    monkeypatch.setattr(ngram, "learn", lambda cells: learned.append((cells, learn(cells))) or learned[-1][1])
    rows = corpus()
    docs = table(rows, SCHEMA)
    got = {r["doc_id"]: r for r in ngram.interpolated(docs, trained=fold("doc_id", 7) != 2, held_out=fold("doc_id", 7) == 4).collect()}
    folds = {r["doc_id"]: r["f"] for r in docs.select("doc_id", fold("doc_id", 7).alias("f")).collect()}
    one, two, context, kept, heldout = Counter(), Counter(), Counter(), [Counter(), Counter(), Counter()], Counter()
    for i, t, *_ in rows:
        own = tokens(t)
        pairs = list(zip(["<s>"] + own[:-1], own))
        if folds[i] != 2:
            one.update(own), two.update(pairs), context.update(v for v, _ in pairs)
            if folds[i] == 4:
                heldout.update(pairs)
            else:
                for c, x in zip(kept, (own, pairs, [v for v, _ in pairs])):
                    c.update(x)
    total, types = sum(one.values()), len(one)
    cells, weights = learned[0]
    assert cells["n"].sum() == sum(heldout.values())
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all()
    # The cells are the held-out tokens with their probabilities from the other counts, rounded to an eighth of a doubling.
    for (v, w), n in heldout.items():
        level = int(math.log2(kept[2][v])) + 1 if kept[2][v] else 0
        q = [round(8 * math.log2(p * (types + 1))) + ngram.TOP if p else 0 for p in (kept[1][v, w] / max(kept[2][v], 1), kept[0][w] / kept[0].total())]
        key = cells["key"].to_numpy()
        near = cells[(key >> 24 == level) & (np.abs(((key >> 12) & 4095) - q[0]) <= 1) & (np.abs((key & 4095) - q[1]) <= 1)]
        assert near["n"].sum() >= n
    for i, t, *_ in rows:
        own, r = tokens(t), got[i]
        base = sum(math.log10((one[w] + 1) / (total + types + 1)) for w in own)
        score = 0.0
        for v, w in zip(["<s>"] + own[:-1], own):
            l2, l1, l0 = weights[int(math.log2(context[v])) + 1 if context[v] else 0]
            score += math.log10(l2 * two[v, w] / max(context[v], 1) + l1 * one[w] / total + l0 / (types + 1))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(one[w] > 0 for w in own), total)
        assert abs(r["base_score"] - base) < 1e-9 and abs(r["score"] - score) < 1e-9


def test_weights_maximise_the_likelihood():
    rng = np.random.default_rng(1)
    q = rng.integers(ngram.TOP - 40, ngram.TOP + 60, (200, 2))
    cells = pd.DataFrame({"key": (5 << 24) + (q[:, 0] << 12) + q[:, 1], "n": rng.integers(1, 50, 200)})
    best = ngram.learn(cells, 500)[5]
    p = np.column_stack([2.0 ** ((q - ngram.TOP) / ngram.STEPS), np.ones(200)])
    value = lambda w: (cells["n"] * np.log(p @ w)).sum()
    for _ in range(200):
        other = best + rng.normal(0, 0.02, 3)
        other = np.clip(other, 1e-9, None) / np.clip(other, 1e-9, None).sum()
        assert value(best) >= value(other) - 1e-6


def test_edges(table):
    rows = [(None, "a b", 1, "r", 2), (1, "a b", 1, "r", 2), (1, "a b", 1, "r", 2), (2, None, 1, "r", 2)]
    got = ngram.interpolated(table(rows, SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == [("1", 3), ("1", 3), ("2", 1), ("None", 3)]
    assert {r["train_tokens"] for r in got} == {10} and all(r["score"] < 0 for r in got)
    from pyspark.sql import functions as F
    none = ngram.interpolated(table(rows, SCHEMA), trained=F.lit(None).cast("boolean")).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in none} == {(0, 0)} and all(r["base_score"] == 0 for r in none)
    assert ngram.interpolated(table([], SCHEMA)).collect() == []

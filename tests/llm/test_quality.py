import numpy as np
import pyarrow as pa

from pairloom.llm import quality
from pairloom.llm.langid import fold
from pairloom.llm.words import slices

from .conftest import text

DOCS = "doc_id long, text string, score string, key int"


def corpus(n=120):
    rng, rows, labels = np.random.default_rng(0), [], []
    for i in range(n):
        good = i % 3 > 0
        t = text(i, 40) if good else ("&&& " + text(i, 1) + "$$$ ") * 20 if i % 2 else (text(i, 1).upper() + "!! ") * int(rng.integers(10, 40))
        rows.append((i, t, "s", 1))
        labels.append((i, int(good)))
    return rows, labels


def test_votes_are_the_nearest_labels(table):
    rows, labels = corpus()
    docs = table(rows, DOCS)
    model = quality.train(docs, table(labels, "doc_id long, label int").where(fold("doc_id", 3) != 1), sample=30)
    assert model.labels.sum() == 30 and len(model.labels) <= 60 and model.basis.shape[0] == quality.TERMS
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    right = np.mean([(got[i] >= 0.5) == bool(v) for i, v in labels])
    assert len(got) == len(rows) and right > 0.95
    n, df = quality.document_frequencies(docs, "text")
    terms = quality.Terms()
    (part,) = slices(pa.array([r[1] for r in rows]))
    counts = terms.of(part)
    assert n == len(rows) and (df == (counts > 0).sum(axis=0)).all()
    for i, c in enumerate(counts[:10]):  # the same by plain cosines
        v = quality.weigh(c[None].copy(), model.idf)[0] @ model.basis
        cosines = model.vectors @ (v / np.linalg.norm(v))
        best = np.argsort(-cosines)[:quality.NEIGHBOURS]
        w = np.clip(cosines[best], 1e-3, 1).astype(float) ** quality.POWER
        assert abs((w * model.labels[best]).sum() / w.sum() - got[i]) < 1e-3


def test_edges(table):
    rows = [(1, None, "s", 1), (None, "", "s", 1), (3, "x", "s", 1), (3, "x", "s", 1), (4, "y" * 200_000, "s", 1)]
    docs = table(rows, DOCS)
    nobody = quality.train(docs, table([(1, None), (99, 1)], "doc_id long, label int"))
    assert [r["score"] for r in quality.score(docs, nobody).collect()] == [0.5] * 5
    one = quality.train(docs, table([(1, 1), (1, 1), (3, 1), (4, 0), (None, 1), (3, 7)], "doc_id long, label int"))
    got = quality.score(docs, one).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(table([], DOCS), one).collect() == []
    assert quality.train(table([], DOCS), table([], "doc_id long, label int")).labels.size == 0

import itertools
import re
import time

import numpy as np
import pytest

from pairloom.llm import leaks

from .conftest import text, word

DOCS = "doc_id long, text string, leaks int, item string"


def plain(a, b):
    """Longest common subsequence by the usual table."""
    best = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, best[j + 1] = best[j + 1], last + 1 if x == y else max(best[j + 1], best[j])
    return best[-1]


def test_subsequences():
    rng = np.random.default_rng(0)
    for n, m in itertools.product((0, 1, 7, 70), (0, 1, 9, 150)):
        a, b = rng.integers(0, 9, n), rng.integers(0, 9, m)
        assert leaks.common(a, b.tolist()) == plain(a.tolist(), b.tolist())


def test_subspace_products():
    rng = np.random.default_rng(0)
    words = [rng.integers(0, 2 ** 63, 20).astype(np.uint64) for _ in range(5)]
    weights = rng.random(leaks.TERMS).astype(np.float32)
    x = rng.random((leaks.TERMS, 3)).astype(np.float32)
    a = np.zeros((5, leaks.TERMS))
    for i, w in enumerate(words):
        np.add.at(a[i], leaks.terms_of(w), 1)
        a[i] = np.sqrt(a[i]) * weights
        a[i] /= np.linalg.norm(a[i])
    assert np.allclose(leaks.back_and_forth(words, weights, x), a.T @ (a @ x), atol=1e-4)


def corpus():
    rng = np.random.default_rng(3)
    common = text(1, 60).split()
    prose = lambda seed, n: " ".join(w if rng.random() < 0.6 else common[int(rng.integers(60))] for w in text(seed, n).split())
    items = [(i, prose(1000 + i, int(rng.integers(13, 66))) + ".") for i in range(40)]
    docs = [(i, prose(2000 + i, int(rng.integers(5, 400))), 1, "x") for i in range(80)]
    want = set()
    for i, t in items:
        before, after = prose(3000 + i, int(rng.integers(0, 90))), prose(4000 + i, int(rng.integers(0, 90)))
        words = t.split()
        if i % 3 == 1:  # some words replaced
            for j in rng.choice(len(words), len(words) // 8, replace=False):
                words[j] = word(int(rng.integers(10 ** 9)))
        if i % 3 == 2:  # words inserted, other case
            words = " also ".join(" ".join(words[j:j + 9]) for j in range(0, len(words), 9)).upper().split()
        docs.append((100 + i, f"{before}\n{' '.join(words)} {after}", 1, "x"))
        want.add((100 + i, i))
        docs.append((200 + i, f"{before} {' '.join(words[:len(words) // 4])} {after}", 1, "x"))  # a quarter is no leak
    return docs, items, want


def test_leaks_are_found_and_clean_texts_are_not(table):
    docs, items, want = corpus()
    frame = table(docs, DOCS)
    space = leaks.fit(frame, table(items, "item_id long, text string"))
    found = leaks.search(frame, space)
    assert found.columns == ["doc_id", "text", "item", "leaks"]
    got = {(r["doc_id"], leak["item"]) for r in found.collect() for leak in r["leaks"]}
    # What comparing every item with every text would say, without candidates.
    words = dict(zip([d[0] for d in docs], leaks.text_words([d[1] for d in docs])))
    every = {(i, item.key) for i, w in words.items() for item in space.items if leaks.confirm(space, item, w)}
    assert got <= every | want and want <= got and len(every - got) <= 0.1 * len(every)
    assert not {d for d, _ in got if d < 100 or d >= 200}


def test_edges(table):
    item = text(5, 30) + "."
    rows = [(1, None, 1, "x"), (None, item, 1, "x"), (2, "", 1, "x"), (3, item, 1, "x"), (3, item, 1, "x"), (4, text(6, 30_000), 1, "x")]
    docs = table(rows, DOCS)
    bench = table([(7, item, "q"), (7, item, "q"), (8, None, "q"), (None, text(9, 20), "q"), (9, "", "q")], "item_id long, text string, answer string")
    space = leaks.fit(docs, bench)
    assert [i.key for i in space.items] == [7]
    got = sorted((str(r["doc_id"]), [leak["item"] for leak in r["leaks"]]) for r in leaks.search(docs, space).collect())
    assert got == [("1", []), ("2", []), ("3", [7]), ("3", [7]), ("4", []), ("None", [7])]
    assert leaks.search(table([], DOCS), space).collect() == []
    nothing = leaks.fit(docs, bench.where("false"))
    assert all(r["leaks"] == [] for r in leaks.search(docs, nothing).collect())
    assert leaks.fit(table([], DOCS), bench).items


def test_too_many_items(table, monkeypatch):
    monkeypatch.setattr(leaks, "MOST_ITEMS", 2)
    with pytest.raises(ValueError):
        leaks.read_items(table([(i, "a b") for i in range(3)], "item_id int, text string"), "item_id", "text", None)


@pytest.mark.parametrize("count", [100, 800])
def test_leaks_are_found_however_many_the_items_are(table, count):
    rng = np.random.default_rng(count)
    prose = lambda n: " ".join(word(int(10 ** 6 * i ** 2)) for i in rng.random(n))
    items = [(i, prose(int(rng.integers(15, 60))) + ".") for i in range(count)]
    docs = [(i, prose(200), 1, "x") for i in range(100)]
    for n, (i, t) in enumerate(items[::count // 50]):
        words = t.split()
        for j in rng.choice(len(words), len(words) // 4 * (n % 2), replace=False):  # a quarter of every other one is replaced
            words[j] = word(int(rng.integers(10 ** 8, 10 ** 9)))
        docs.append((1000 + i, f"{prose(int(rng.integers(0, 90)))} {' '.join(words)} {prose(int(rng.integers(0, 90)))}", 1, "x"))
    frame = table(docs, DOCS)
    space = leaks.fit(frame, table(items, "item_id long, text string"))
    got = {(r["doc_id"], leak["item"]) for r in leaks.search(frame, space).collect() for leak in r["leaks"]}
    words = dict(zip([d[0] for d in docs], leaks.text_words([d[1] for d in docs])))
    every = {(i, item.key) for i, w in words.items() for item in space.items if leaks.confirm(space, item, w)}
    assert {(1000 + i, i) for i, _ in items[::count // 50]} <= every
    assert len(every - got) <= 0.1 * len(every) and got <= every
    assert all((1000 + i, i) in got for i, _ in items[::count // 25])  # exact copies, all


def test_lists_give_the_products_of_whole_rows(monkeypatch):
    monkeypatch.setattr(leaks, "COMMON", 0.0)
    monkeypatch.setattr(leaks, "LISTED", 50)
    rng = np.random.default_rng(0)
    own = [rng.integers(0, 2 ** 63, 40).astype(np.uint64) for _ in range(9)]
    weights = rng.random(leaks.TERMS).astype(np.float32)
    padded = np.append(leaks.terms_of(np.concatenate(own)), np.full(-360 % leaks.BLOCK, leaks.TERMS))
    (lists,) = leaks.term_lists(own, np.arange(2, 9), weights, 1.0, np.zeros((0, 3)))
    got = leaks.listed_dots(lists, padded)
    for place, i in enumerate(range(2, 9)):
        ids, tf = np.unique(leaks.terms_of(own[i]), return_counts=True)
        row = np.zeros(leaks.TERMS + 1)
        row[ids] = tf * weights[ids].astype(float) ** 2
        row /= leaks.full_norm(own[i], weights) * leaks.least_cosines([own[i]], 1.0, 1.0)[0]
        assert np.allclose(got[:, place], row[padded].reshape(-1, leaks.BLOCK).sum(axis=1), rtol=1e-4)


@pytest.mark.parametrize("bound", ["SAMPLE", "EVEN"])
def test_the_space_is_fitted_on_every_text(table, monkeypatch, bound):
    """It captures what all documents hold, though one of them is all that a sample would take or that they weigh as."""
    monkeypatch.setattr(leaks, bound, 1, raising=False)
    rng = np.random.default_rng(0)
    topics = [[word(10 ** 6 * t + j) for j in range(40)] for t in range(20)]
    docs = [(i, " ".join(topics[i % 20][j] for j in rng.integers(0, 40, 64)), 1, "x") for i in range(400)]
    monkeypatch.setattr(leaks, "WEIGHT", 0.0)  # no item helps
    space = leaks.fit(table(docs, DOCS), table([(1, text(7, 30) + ".")], "item_id long, text string"))
    basis = space.basis[:-1] / np.maximum(space.weights[:-1, None], 1e-9)
    rows = np.zeros((len(docs), leaks.TERMS))
    for i, w in enumerate(leaks.text_words([d[1] for d in docs])):
        np.add.at(rows[i], leaks.terms_of(w), 1)
    rows = np.sqrt(rows) * space.weights[:-1]
    caught = np.linalg.norm(rows @ basis, axis=1) / np.linalg.norm(rows, axis=1)
    assert caught.mean() > 0.85


def test_products_of_all_passages_come_from_the_table_of_terms(table, monkeypatch):
    """Texts are cut into words once; the rounds multiply by the passages of the table, in any order of terms."""
    monkeypatch.setattr(leaks, "MANY", 3)
    monkeypatch.setattr(leaks, "OFTEN", 5000)
    rng = np.random.default_rng(0)
    texts = [" ".join(word(int(i)) for i in rng.integers(0, 90, n)) for n in (0, 1, 64, 65, 300, 7, 130)] + [None]
    terms = leaks.term_table(table([(t,) for t in texts], "text string"))
    words = [w.astype(int) for w in map(leaks.terms_of, leaks.text_words([t or "" for t in texts]))]
    assert sorted(bytes(r["terms"]) for r in terms.collect()) == sorted(w.astype("<u2").tobytes() for w in words)
    df = np.zeros(leaks.TERMS, int)
    for w in words:
        df[np.unique(w)] += 1
    assert (leaks.document_frequencies(terms) == df).all()
    weights, x = rng.random(leaks.TERMS).astype(np.float32), rng.random((leaks.TERMS, 3)).astype(np.float32)
    want = np.zeros_like(x)
    for w in words:
        for i in range(0, len(w), leaks.PASSAGE):
            a = np.sqrt(np.bincount(w[i:i + leaks.PASSAGE], minlength=leaks.TERMS)) * weights
            a /= np.linalg.norm(a)
            want += np.outer(a, a @ x)
    order = rng.permutation(leaks.TERMS)
    got = leaks.products(terms, np.argsort(order).astype(np.uint16), weights[order], x[order])
    assert np.allclose(got, want[order], atol=1e-4)


def test_windows_near_by_lists_are_those_of_all_products():
    rng = np.random.default_rng(1)
    own = [rng.integers(0, 2 ** 63, 40).astype(np.uint64) for _ in range(5)]
    weights = np.append(rng.random(leaks.TERMS), 0).astype(np.float32)
    (group,) = leaks.term_lists(own, np.arange(5), weights[:-1], 0.2, np.zeros((0, 3)))
    padded = np.concatenate([rng.permutation(leaks.terms_of(own[i % 5]))[:32] for i in range(20)])
    text = np.repeat(np.arange(8), [1, 9, 2, 3, 5, 4, 15, 1])
    norms = (weights[padded] ** 2).reshape(-1, leaks.BLOCK).sum(axis=1)
    found = set(zip(*(x.tolist() for x in leaks.near_windows(leaks.listed_dots(group, padded), norms, text))))
    every = np.array([(b, i, j) for b in range(len(text)) for i in range(5) for j in leaks.WINDOWS])
    near = leaks.listed_near(group, padded, norms, text, *every.T)
    assert found == set(map(tuple, every[near].tolist())) and 0 < len(found) < len(every)


def test_a_round_leaves_no_shuffle_behind(spark, table):
    """Every round shuffles a tall array for each task; the files go before the next one."""
    def shuffles():
        names = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return set(re.findall(r"shuffle_(\d+)_", names))

    terms = leaks.term_table(table([("a b c",), ("d e f",)], "text string")).localCheckpoint()
    before = shuffles()
    leaks.products(terms, np.arange(leaks.TERMS).astype(np.uint16), np.ones(leaks.TERMS, np.float32), np.ones((leaks.TERMS, 2), np.float32))
    for _ in range(20):
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before

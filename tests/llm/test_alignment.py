import hashlib
import random
import shutil
from collections import Counter
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle

from pairloom.llm import alignment
from pairloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, chunk int, groups string"
ODD = [None, "", " ", "  ", "foo ", "foo \n", " foo", "a\n b", "\n \n x", "\t", "x▁y", "<|endoftext|> hi <s> <0x41>", "日本語 テキスト 😀😀 é",
       "a" * 500, "don't we'll  it's   5x", "   a", "ﬁ ﷺ", "\x00 a", "a\r\n  b  ", "　x 　 y", "1234567890 " * 5, "end.\n", "x 😀"]


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair(alignment.vocabulary("byte_bpe_50k.json"), alignment.vocabulary("piece_bpe_32k.model"))


def brute(pair, texts):
    """Whole texts, token by token, with plain loops; groups from the common ends."""
    rows, counts = [], Counter()
    for text in texts:
        full = " " + (text or "")
        a, b = pair.a.encode(full, add_special_tokens=False).ids, pair.b.encode(text or "")
        bytes_a, bytes_b = [pair.bytes_a[i] for i in a], [pair.bytes_b[i] for i in b]
        if not text or b"".join(bytes_a) != full.encode() or b"".join(bytes_b) != full.encode():
            rows.append(None)
            continue
        ends_a, ends_b = list(accumulate(map(len, bytes_a))), list(accumulate(map(len, bytes_b)))
        links, j = [], 0
        for i, end in enumerate(ends_a):
            while ends_b[j] <= end - len(bytes_a[i]):
                j += 1
            k = j
            while k < len(b) and ends_b[k] - len(bytes_b[k]) < end:
                links.append((a[i], b[k]))
                k += 1
        groups, x, y = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            x, y = i, j
        rows.append((len(a), len(b), groups, links))
        counts.update(set(links))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (
        len_a, len_b, len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), ";".join(groups))
        for r in rows for len_a, len_b, groups, links in [r or (0, 0, [], [])]]


def texts():
    rng = random.Random(1)
    return ODD + ["".join(rng.choice(" \n\ta1é'.s日 😀") for _ in range(rng.randint(1, 30))) for _ in range(150)] + ["the cat sat. " * 40] * 3


def test_equals_brute_force(table, pair, monkeypatch):
    given = texts()
    docs = table([(i if i else None, t, 1, "x") for i, t in enumerate(given)], SCHEMA)
    got = sorted(map(tuple, alignment.align(docs).collect()), key=lambda r: r[0] or 0)
    assert got == [(i or None, *r) for i, r in enumerate(brute(pair, given))]


def test_small_chunks_count_alike(table, pair):
    given = texts()[:60]
    docs = table([(i, t, 1, "x") for i, t in enumerate(given)], SCHEMA)
    before = alignment.CHUNK, alignment.KNOWN
    known = alignment.Stretches(pair)
    whole = alignment.Chunk(known, False)
    try:
        alignment.CHUNK = alignment.KNOWN = 1  # travels with the job: every slice is a chunk, nothing is remembered
        got = sorted(map(tuple, alignment.align(docs).collect()))
    finally:
        alignment.CHUNK, alignment.KNOWN = before
    assert got == [(i, *r) for i, r in enumerate(brute(pair, given))]
    assert whole.n == 0


def test_pointer_jumping_finds_common_ends():
    rng = random.Random(2)
    for _ in range(200):
        total = rng.randint(1, 40)
        ends = [sorted({*rng.sample(range(1, total + 1), rng.randint(0, total)), total}) for _ in range(2)]
        sizes = [np.diff([0, *e]) for e in ends]
        found = alignment.terminals(np.array(ends[0]), sizes[0], np.array(ends[1]), sizes[1])
        common = sorted(set(ends[0]) & set(ends[1]))
        want = [next(c for c in common if c >= e) for e in ends[0] + ends[1]]
        assert [ends[0][i] for i in found] == want


def test_empty_and_repeated(table):
    assert alignment.align(table([], SCHEMA)).count() == 0
    got = alignment.align(table([(1, "the cat", 1, "x")] * 4, SCHEMA)).collect()
    assert len(got) == 4 and len({tuple(r) for r in got}) == 1 and got[0]["count_sum"] == 4 * got[0]["n_links"]


def test_chunk_row_is_smaller_than_its_text(pair):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeiouklmnrst") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    given = [" ".join(rng.choices(words, k=400)) for _ in range(100)]
    size = sum(map(len, given))
    chunk = alignment.Chunk(alignment.Stretches(pair), True)
    chunk.add(pa.array(range(len(given)), pa.int64()), given, size)
    assert chunk.row(0, pa.int64()).nbytes < size


def test_empty_texts_fill_a_chunk_and_long_stretches_the_memory(pair):
    known = alignment.Stretches(pair)
    chunk = alignment.Chunk(known, True)
    chunk.add(pa.array(range(1000), pa.int64()), [""] * 1000, 0)
    assert chunk.size >= 1000
    chunk.add(pa.array([1], pa.int64()), ["日本語" * 1000], 9000)
    assert known.size > 9000
    known.forget()
    assert known.size == 0


def test_pairs_that_come_often(table, pair):
    given = ["a b " * 130, "a b " * 200 + "c", "", None, "c a"]
    got = sorted(map(tuple, alignment.align(table([(i, t, 1, "x") for i, t in enumerate(given)], SCHEMA)).collect()))
    assert got == [(i, *r) for i, r in enumerate(brute(pair, given))]


def test_numbers_are_packed_and_summed():
    for top in (0, 1, 255, 256, 65535, 65536, 2**32 - 1, 2**32):
        x = np.array([0, top, 1, top // 2])
        assert alignment.unpacked(alignment.packed(x), 4).tolist() == x.tolist()
    assert len(alignment.packed(np.arange(256))) == 256
    assert alignment.unpacked(alignment.packed(np.zeros(0, np.int64)), 0).tolist() == []
    keys, times = alignment.summed(np.array([5, 0, 5, 3, 0]), np.array([1, 2, 3, 4, 5]))
    assert keys.tolist() == [0, 3, 5] and times.tolist() == [7, 4, 4]
    assert [x.tolist() for x in alignment.summed(keys[:0], times[:0])] == [[], []]


def test_workers_get_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    long = spark.range(0, 40, 1, 1).selectExpr("repeat('x', 1000000) AS text")
    count = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    with alignment.small_batches(spark):
        most = max(r[0] for r in long.mapInArrow(count, "n long").collect())
    assert most <= 8 and spark.conf.get(name, None) == before


def test_tasks_share_a_tokenizer(pair, tmp_path):
    run = cloudpickle.dumps(lambda path: alignment.byte_tokenizer(path))  # each load has modules of its own, as each task has
    path = shutil.copy(alignment.vocabulary("byte_bpe_50k.json"), tmp_path / "v.json")
    first = cloudpickle.loads(run)(str(path))
    assert cloudpickle.loads(run)(str(path)) is first
    path.write_text(path.read_text() + "\n")
    assert cloudpickle.loads(run)(str(path)) is not first


def test_query(spark, pair):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want = [(i, *r[:6], hashlib.sha256(r[6].encode()).hexdigest() if r[6] else "") for (i, _), r in zip(docs, brute(pair, [t for _, t in docs]))]
    got = QUERIES["op13_token_alignment"](spark, SF)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == want

import numpy as np
import pyarrow as pa

from pairloom.llm import chunking
from pairloom.llm.words import Powers, slices

from .conftest import text

SCHEMA = "doc_id long, text string, spans int, k string, v string, hits int, row int"


def rows_of(texts):
    return [(i, t, 1, "k", "v", 2, 3) for i, t in texts]


def chunks(t):
    (part,) = slices(pa.array([t]), 1 << 30)
    _, start, length, hi, lo = chunking.chunks_of(part, Powers())
    raw = t.encode()
    return [raw[a:a + n] for a, n in zip(start, length)], list(zip(hi.tolist(), lo.tolist()))


def test_chunks_cover_the_text_and_digests_tell_them_apart():
    seen = {}
    for t in ("x", "é" * 3000, "a" * 5000, text(1, 900), "\n\n  a", "日本語 " * 500, "wörter über " * 90):
        parts, digests = chunks(t)
        assert b"".join(parts) == t.encode()
        assert all(p.decode() for p in parts)
        for p, d in zip(parts, digests):
            assert seen.setdefault(d, p) == p
    assert len(set(seen.values())) == len(seen)


def test_insertions_move_few_boundaries():
    base = text(3, 2000)
    words = base.split(" ")
    changed = " ".join(words[:700] + ["inserted", "words"] + words[700:])
    one, two = set(chunks(base)[0]), set(chunks(changed)[0])
    assert len(one - two) <= 4 and len(two - one) <= 4


def test_a_text_has_the_same_chunks_in_any_slice():
    texts = [text(i, 60 + i) for i in range(20)]
    for size in (1, 500, 1 << 20):
        for part in slices(pa.array(texts), size):
            owner, _, _, hi, lo = chunking.chunks_of(part, Powers())
            for i in range(part.count):
                assert list(zip(hi[owner == i].tolist(), lo[owner == i].tolist())) == chunks(texts[part.first + i])[1]


def test_passages_without_blanks_are_found_whatever_stands_before():
    rng = np.random.default_rng(5)
    made = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9000, n)))
    for length, least in ((100, 0.6), (200, 0.75), (400, 0.85)):
        shares = []
        for _ in range(60):
            passage = made(length)
            known = set(chunks(made(300) + passage + made(90))[0])
            run, best = 0, 0
            for c in chunks(made(211) + passage + made(120))[0]:
                run = run + len(c) if c in known else 0
                best = max(best, run)
            shares.append(best / len(passage.encode()))
        assert np.mean(shares) >= least and np.mean([s * length * 3 >= 100 for s in shares]) >= 0.95


def brute(rows, least):
    """The same rule on plain lists of chunks."""
    keeper, count, cut = {}, {}, {}
    parts = {(i, t): chunks(t)[0] for i, t in rows if i is not None and t is not None}
    for (i, _), own in parts.items():
        for c in own:
            keeper[c], count[c] = min(keeper.get(c, i), i), count.get(c, 0) + 1
    for (i, t), own in parts.items():
        seen, out, run = set(), b"", b""
        for c in own + [None]:
            again = c is not None and count[c] > 1 and (keeper[c] != i or c in seen)
            seen.add(c)
            if again:
                run += c
                continue
            out, run = out + (run if len(run) < least else b""), b""
            out += c or b""
        cut[i, t] = out.decode()
    return cut


def test_repeats_go_and_first_occurrences_stay(table):
    passage, line = text(50, 55), "the same line that very many documents hold in them\n"
    texts = [(i, f"{text(100 + i, 40)}\n{passage}\n{text(300 + i, 30)}") for i in range(12)]
    texts += [(20 + i, text(500 + i, 50)) for i in range(10)] + [(40, text(500, 50)), (41, line * 30), (42, text(7, 20) + "\n" + line * 30)]
    texts += [(50, None), (51, ""), (None, passage), (60, "ü" * 900), (61, "ü" * 900), (62, "short one"), (63, "short one")]
    got = chunking.remove_repeats(table(rows_of(texts), SCHEMA))
    assert got.columns == ["doc_id", "text", "k", "v", "hits", "row", "spans"]
    got = {r["doc_id"]: r for r in got.collect()}
    want = brute(texts, 100)
    assert {i: got[i]["text"] for i, t in want} == {i: v for (i, t), v in want.items()}
    assert got[None]["text"] == passage and got[50]["text"] is None and got[51]["text"] == ""
    assert sum(passage in r["text"] for i, r in got.items() if r["text"] and i is not None) == 1
    for i in range(1, 12):  # most of the passage goes from all other documents, and nothing else
        assert text(100 + i, 40)[:150] in got[i]["text"] and text(300 + i, 30)[-100:] in got[i]["text"]
        gone = sum(s["length"] for s in got[i]["spans"])
        assert gone > 0.5 * len(passage) and len(got[i]["text"].encode()) + gone == len(dict(texts)[i].encode())
    assert all(not got[20 + i]["spans"] for i in range(10)) and got[40]["text"] == ""
    assert [s["keeper"] for s in got[40]["spans"]] == [20]


def test_repeated_rows_and_empty_tables(table):
    one = text(1, 80)
    got = chunking.remove_repeats(table(rows_of([(1, one), (1, one), (1, text(2, 80)), (2, one)]), SCHEMA)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(1, one), (1, one), (1, text(2, 80)), (2, "")])
    assert chunking.remove_repeats(table([], SCHEMA)).collect() == []


def test_filter_lets_every_repeat_through(table):
    rng = np.random.default_rng(0)
    pairs = rng.integers(-2 ** 62, 2 ** 62, (500, 2)).tolist()
    bits = chunking.digest_filter(table([tuple(p) for p in pairs], "hi long, lo long"), 500).value
    for a, b in zip(*chunking.slots(np.array(pairs)[:, 0], np.array(pairs)[:, 1], len(bits) * 8)):
        assert bits[a >> 3] >> (a & 7) & 1 and bits[b >> 3] >> (b & 7) & 1

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import packing

SCHEMA = "doc_id long, text string, rank string"


def ids_of(text):
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.vocabulary()).encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_hold_the_tokenizer_s_ids(table):
    texts = [None, "", "Hello, World! it's don't", "naïve ÉCOLE é  x y", "a" * 300, "x1 22 ŝ ǅ İ <|endoftext|>", "the cat. " * 40, "\n", "ß! ?", "日本 語",
             "<|endoftext|>", "<|ENDOFTEXT|>", "A<|endoftext|>B<|startoftext|>", "a<|ENDOFTEXT|><|endoftext|>", "a<|endoftext|><|ENDOFTEXT|>",
             "end <|endof", "text|> of <|StartOfText|> x", "É<|endoftext|>É"]
    docs = table([(i if i else None, t, "r") for i, t in enumerate(texts)], SCHEMA)
    got = {}
    for r in packing.cut_documents(docs, length=16).collect():
        got[r["doc_id"], r["piece"]] = (r["start"], r["length"], np.frombuffer(bytes(r["ids"]), "<u4").tolist())
    want = {}
    for i, t in enumerate(texts):
        ids = ids_of(t)
        for p, a in enumerate(range(0, len(ids), 16)):
            want[i if i else None, p] = (a, len(ids[a:a + 16]), ids[a:a + 16])
    assert got == want


def test_only_tokenizers_of_lower_cased_chunks(table):
    import public_tokenizers
    with pytest.raises(ValueError):
        packing.cut_documents(table([], SCHEMA), public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.cut_documents(table([], SCHEMA), packing.vocabulary()).collect() == []


def brute(lengths, size):
    """Best-fit decreasing, one piece after the other."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps[gaps.index(min(fits))] -= n
        else:
            gaps.append(size - n)
    return len(gaps)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_sweeps_equal_best_fit_decreasing(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.best_fit(counts, 20)
    used = {}
    for p in plan.itertuples():
        for k in range(p.n):
            used.setdefault(p.sequence + k, []).append((p.offset, p.length))
    for parts in used.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 20
    assert sum(p.n for p in plan.itertuples()) == len(lengths)
    assert len(used) == brute(lengths, 20)


def test_pack_places_every_row_once(table):
    rows = [(i % 7 if i % 5 else None, 1 + (i * i) % 50, "x") for i in range(200)] + [(3, 50, "x")] * 30
    packed = packing.pack(table(rows, "doc_id long, length int, text string"), 50).collect()
    assert sorted((r["doc_id"] or -1, r["length"]) for r in packed) == sorted((a or -1, b) for a, b, _ in rows)
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= 50 and [o for o, _ in sorted(p)] == np.cumsum([0] + [n for _, n in sorted(p)])[:-1].tolist() for p in places.values())
    assert len(places) == brute([b for _, b, _ in rows], 50)


def test_empty_and_wrong_lengths(table):
    assert packing.pack(table([], "length long, x int")).collect() == []
    assert packing.cut_documents(table([], SCHEMA)).collect() == []
    for bad in (0, None, 9):
        with pytest.raises(ValueError):
            packing.pack(table([(bad,), (1,)], "length long"), 8)
    with pytest.raises(ValueError):
        packing.pack(table([(1, 1)], "length long, Rank int"), 8)


def test_sequences_join_pieces_in_order(table):
    docs = table([(i, f"word number {i} " * (i + 1), None) for i in range(12)], SCHEMA)
    packed = packing.pack_documents(docs, length=64)
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r["sequence_id"]][4 * r["offset"]:4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert all(zlib.crc32(x) and len(x) <= 256 for x in whole.values())

import zlib

import numpy as np
import pyarrow as pa

from pairloom.llm import langid
from pairloom.llm.words import slices

LINES = {"aa": "the house and the garden were behind that wall", "bb": "das haus und der garten standen hinter jener mauer",
         "cc": "la maison et le jardin étaient derrière ce mur"}
SCHEMA = "doc_id long, text string, lang string, score int, Lang_Pred string"


def corpus(n=60):
    rng, rows = np.random.default_rng(0), []
    for i in range(n):
        lang = sorted(LINES)[i % 3]
        rows.append((i, " ".join(rng.permutation(LINES[lang].split() * 3)), lang, 5, "x"))
    return rows


def plain(text, dim):
    """The bundle, letter by letter."""
    table, vectors = langid.letter_table(), langid.trigram_vectors(dim)
    codes = []
    for c in text:
        code = int(table[min(ord(c), 0xFFFF)]) if ord(c) < 0x10000 else (27 + ord(c) % 13 if c.isalpha() else 0)
        if code or not codes or codes[-1]:
            codes.append(code)
    total = np.zeros(dim)
    for a, b, c in zip(codes, codes[1:], codes[2:]):
        total += vectors[(a * 40 + b) * 40 + c]
    return total


def test_trigrams_bind_rotated_letters():
    vectors = langid.trigram_vectors(64)
    letters = np.array([vectors[(c * 40 + c) * 40 + c] for c in range(40)])  # not letters yet: products of three rotations
    assert set(np.unique(vectors)) == {-1, 1} and abs(letters.mean()) < 0.2
    assert abs((vectors[1234] @ vectors[4321].astype(int)) / 64) < 0.5


def test_counts_match_single_letters():
    texts = ["Straße  12, über!", "", "x", "ab", "日本 語", "𝒳yz 𝒴", "a-b\nc"]
    finder = langid.Trigrams()
    for part in slices(pa.array(texts)):
        grams, of, letters = finder.of(part)
        for i in range(part.count):
            own = grams[of == i]
            got = np.bincount(own, minlength=64000).astype(float) @ langid.trigram_vectors(32)
            assert np.allclose(got, plain(texts[part.first + i], 32)), texts[part.first + i]
            assert letters[i] == any(c.isalpha() for c in texts[part.first + i])


def test_held_out_texts_get_their_language(table):
    docs = table(corpus(), SCHEMA)
    held = langid.fold("doc_id", 4) == 2
    model = langid.train(docs.where(~held))
    want = np.array([sum(plain(t, langid.DIM) for i, t, lang, *_ in corpus() if lang == name and zlib.crc32(str(i).encode()) % 4 != 2) for name in sorted(LINES)])
    assert model.languages == sorted(LINES)
    assert np.allclose(model.vectors, want / np.linalg.norm(want, axis=1, keepdims=True))
    got = langid.predict(docs, model).withColumn("held", held).collect()
    for r in got:
        assert r["lang_pred"] == r["lang"] and r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        v = plain(r["text"], langid.DIM)
        assert abs(r["score"] - (model.vectors @ v).max() / np.linalg.norm(v)) < 1e-5


def test_texts_without_letters_and_empty_tables(table):
    model = langid.train(table(corpus(), SCHEMA))
    rows = [(1, None, "aa", 1, ""), (2, "", None, 1, ""), (3, "12 ?!", "bb", 1, ""), (None, LINES["bb"], None, 1, ""), (5, "a", "x", 1, ""), (5, LINES["cc"], "x", 1, "")]
    got = langid.predict(table(rows, SCHEMA), model).collect()
    assert got and set(got[0].asDict()) == {"doc_id", "text", "lang", "score", "lang_pred"}
    by = {(r["doc_id"], r["text"]): (r["lang_pred"], r["score"]) for r in got}
    assert by[1, None] == by[2, ""] == by[3, "12 ?!"] == ("und", 0.0)
    assert by[None, LINES["bb"]][0] == "bb" and by[5, LINES["cc"]][0] == "cc" and by[5, "a"] == ("aa", 0.0)
    nothing = langid.train(table([(1, "abc", None, 1, "")], SCHEMA))
    assert {r["lang_pred"] for r in langid.predict(table(rows, SCHEMA), nothing).collect()} == {"und"}
    assert langid.predict(table([], SCHEMA), model).collect() == []

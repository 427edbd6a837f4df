"""Language identification with hyperdimensional profiles.

Every letter has a random +1/-1 vector. A trigram is bound by multiplying its letters' vectors, the first rotated twice and
the second once; a text is the bundle (sum) of its trigrams, a language the bundle of its training texts. The prediction
is the language whose prototype has the largest cosine with the text's vector.

Bundling is a sum over trigrams, so training counts trigrams for each language with partial sums on Spark and bundles the
counts at the end; only prototypes (languages x DIM numbers) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import Slice, mix, slices, tidy

DIM = 1024
CODES = 40  # 0 stands between words, 1-26 are a-z, the rest share all other letters
PIECE = 2048  # trigram vectors in single precision at once
NONE = "und"
MOST_LANGUAGES = 512  # bound of what is broadcast; more raise


def letter_table() -> np.ndarray:
    """Codes of the code points of the first plane."""
    table = np.zeros(0x10000, np.uint16)
    for c in range(0x10000):
        if 0xD800 <= c < 0xE000 or not chr(c).isalpha():
            continue
        low = chr(c).lower()[0]
        table[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (CODES - 27)
    return table


class Vectors:
    """Bound vectors of trigrams, as rows of +1 and -1: those of their first two letters are kept, the third is bound on demand."""

    def __init__(self, dim: int):
        bits = mix(np.arange(CODES * dim, dtype=np.uint64) + np.uint64(0x5EED)) >> np.uint64(63)
        self.letters = (bits.astype(np.int8) * 2 - 1).reshape(CODES, dim)
        self.pairs = (np.roll(self.letters, 2, axis=1)[:, None, :] * np.roll(self.letters, 1, axis=1)[None, :, :]).reshape(CODES ** 2, dim)

    def of(self, grams: np.ndarray) -> np.ndarray:
        return self.pairs[grams // CODES] * self.letters[grams % CODES]


def trigram_vectors(dim: int) -> np.ndarray:
    """Bound vectors of all trigrams."""
    return Vectors(dim).of(np.arange(CODES ** 3))


class Trigrams:
    """Trigram numbers of the texts of a slice."""

    def __init__(self):
        self.table = letter_table()

    def of(self, part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All trigrams, the text of each, and whether each text has a letter."""
        points = np.frombuffer(part.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])[part.offsets]
        codes = self.table[np.minimum(points, 0xFFFF)]
        for i in np.flatnonzero(points > 0xFFFF):
            codes[i] = 27 + points[i] % (CODES - 27) if chr(points[i]).isalpha() else 0
        text = np.repeat(np.arange(part.count), np.diff(first))
        letters = np.bincount(text[codes > 0], minlength=part.count) > 0
        keep = np.ones(len(codes), bool)  # one gap between words, however long
        keep[1:] = (codes[1:] > 0) | (codes[:-1] > 0)
        codes, text = codes[keep].astype(np.int32), text[keep]
        grams = (codes[:-2] * CODES + codes[1:-1]) * CODES + codes[2:]
        whole = text[:-2] == text[2:]
        return grams[whole], text[:-2][whole], letters


@dataclass(frozen=True)
class Prototypes:
    languages: list[str]
    vectors: np.ndarray  # unit length, one row for each language


def train(docs: DataFrame, text: str = "text", lang: str = "lang", dim: int = DIM) -> Prototypes:
    """Prototypes from all rows of `docs` whose `lang` is not null; null and empty texts add nothing."""
    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, sums = Trigrams(), {}
        for batch in batches:
            names = np.array(batch.column(1).to_pylist(), dtype=object)
            for part in slices(batch.column(0)):
                grams, at, _ = finder.of(part)
                own = names[part.first:part.first + part.count]
                for name in set(own):
                    mine = np.flatnonzero(own == name)
                    found = np.bincount(grams[np.isin(at, mine)] if len(mine) < part.count else grams, minlength=CODES ** 3)
                    sums[name] = sums.get(name, 0) + found
                if len(sums) > MOST_LANGUAGES:
                    raise ValueError(f"more than {MOST_LANGUAGES} languages")
        for name, found in sums.items():
            ids = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.string()), pa.array(ids), pa.array(found[ids])], ["lang", "gram", "n"])

    @tidy
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = Vectors(dim), {}
        for batch in batches:
            names, gram, n = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for name in set(names):
                for i in range(0, len(names), 8192):
                    mine = names[i:i + 8192] == name
                    sums[name] = sums.get(name, 0) + n[i:i + 8192][mine].astype(float) @ vectors.of(gram[i:i + 8192][mine]).astype(float)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "vector"])

    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found: dict[str, np.ndarray] = {}
    for row in counts.coalesce(4).mapInArrow(bundle, "lang string, vector array<double>").collect():
        found[row["lang"]] = found.get(row["lang"], 0) + np.array(row["vector"])
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = sorted(found)
    vectors = np.array([found[n] / max(np.linalg.norm(found[n]), 1e-9) for n in names]).reshape(len(names), dim)
    return Prototypes(names, vectors)


def predict(docs: DataFrame, model: Prototypes, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` with `lang_pred` and `score`, the cosine with the nearest prototype (0 to 1); columns of these names (`into`) are replaced.

    `und` and score 0 if the text is null, has no letter, or nothing was learned; letters too few for a trigram score 0 and
    take the first language. Ties go to the first language by name. Rows are judged one by one, whole texts.
    """
    kept = [c for c in docs.columns if c.lower() not in [x.lower() for x in into]]
    at = kept.index(text)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.vectors))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, prototypes = shared.value
        finder, vectors = Trigrams(), Vectors(prototypes.shape[1])
        prototypes = prototypes.astype(np.float32)
        for batch in batches:
            names, scores = [NONE] * len(batch), np.zeros(len(batch))
            for part in slices(batch.column(at)) if languages else ():
                grams, of, letters = finder.of(part)
                begin = np.searchsorted(of, np.arange(part.count + 1))
                for i in np.flatnonzero(letters):
                    counts = np.bincount(grams[begin[i]:begin[i + 1]], minlength=CODES ** 3)
                    ids = np.flatnonzero(counts)
                    bundle = sum(counts[own].astype(np.float32) @ vectors.of(own).astype(np.float32) for own in np.split(ids, range(PIECE, len(ids), PIECE)))
                    cosines = prototypes @ bundle / max(float(np.linalg.norm(bundle)), 1e-9)
                    best = int(np.argmax(cosines))
                    names[part.first + i], scores[part.first + i] = languages[best], min(max(float(cosines[best]), 0.0), 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names, *into])

    schema = docs.select(*kept).schema.simpleString()[len("struct<"):-1]
    return docs.select(*kept).mapInArrow(run, f"{schema},{into[0]}:string,{into[1]}:double")


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`: a stable split into folds; null for a null key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(key.cast("string").cast("binary")) % parts

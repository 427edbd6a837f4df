"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are hashed byte trigrams, trigrams of character classes, and marks for repetition and length, weighted by TF-IDF with
document frequencies of the whole corpus. A truncated SVD of a bounded sample of labelled documents gives the latent
space; its vectors are broadcast. Every document is projected, compared with all of them by blocked cosine products, and
its nearest neighbours vote with weights that grow with similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.words import Powers, Slice, mix, slices, words_of

BYTES, CLASSES, MARKS = 8192, 4096, 64
TERMS = BYTES + CLASSES + MARKS
SAMPLE = 1500  # labelled documents of each label at most, the first by a hash of their key
RANK, NEIGHBOURS, POWER = 96, 15, 8


def class_table() -> np.ndarray:
    """Sixteen classes of bytes."""
    table = np.full(256, 15, np.uint16)
    table[97:123], table[65:91], table[48:58], table[128:] = 0, 1, 2, 3
    for i, group in enumerate((" \t", "\n\r", ".", ",", "!", "?", "&%$*@#+=~^", "|", "\"'()[]{}", "-_", "<>/\\", ":;")):
        table[[ord(c) for c in group]] = 4 + i
    return table


class Terms:
    """Term counts of the texts of a slice, one dense row each."""

    def __init__(self):
        self.classes, self.powers = class_table(), Powers()
        codes = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
        self.codes = [(codes >> np.uint64(8 * j)).astype(np.uint32) for j in range(3)]

    def of(self, part: Slice) -> np.ndarray:
        data, out = part.data, np.zeros((part.count, TERMS), np.float32)
        words = words_of(part, self.powers)
        if len(data) > 2:
            a, b, c = (t[x] for t, x in zip(self.codes, (data[:-2], data[1:-1], data[2:])))
            hashed = ((a * np.uint32(0x85EBCA6B) ^ b * np.uint32(0xC2B2AE35) ^ c * np.uint32(0x27D4EB2F)) >> np.uint32(7)) % np.uint32(BYTES)
            kind = self.classes[data].astype(np.uint32)
            kind = (kind[:-2] * 16 + kind[1:-1]) * 16 + kind[2:]
        for i in range(part.count):
            first, last = int(part.offsets[i]), int(part.offsets[i + 1]) - 2
            if last > first:
                out[i, :BYTES] = np.bincount(hashed[first:last], minlength=BYTES)
                out[i, BYTES:BYTES + CLASSES] = np.bincount(kind[first:last], minlength=CLASSES)
            own = words.hashes[words.begin[i]:words.begin[i + 1]]
            n = len(own)
            again = (own[1:] == own[:-1]).mean() if n > 1 else 0.0
            distinct = len(np.unique(own)) / n if n else 1.0
            expected = min(1.0, 3.0 / max(n, 1) ** 0.4) if n > 12 else 1.0
            marks = (min(int(again * 8), 7), 8 + min(int(distinct / expected * 4), 7), 16 + min(int(np.log2(n + 1)), 15))
            out[i, [BYTES + CLASSES + m for m in marks]] = 1
        return out


def rows_of(column: pa.Array, terms: Terms, many: int = 256) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts) for a few texts at a time."""
    for part in slices(column):
        for i in range(0, part.count, many):
            n = min(many, part.count - i)
            at = part.offsets[i:i + n + 1]
            yield part.first + i, terms.of(Slice(part.first + i, n, part.data[at[0]:at[-1]], at - at[0]))


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of unit length in each of the three families of terms, then together."""
    x = np.log1p(counts) * idf
    for a, b, share in ((0, BYTES, 0.5), (BYTES, BYTES + CLASSES, 0.8), (BYTES + CLASSES, TERMS, 0.35)):
        norm = np.linalg.norm(x[:, a:b], axis=1, keepdims=True)
        x[:, a:b] *= share / np.maximum(norm, 1e-9)
    return x


@dataclass(frozen=True)
class Voters:
    idf: np.ndarray
    basis: np.ndarray  # TERMS x RANK
    vectors: np.ndarray  # unit length
    labels: np.ndarray


def document_frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Number of documents, and of those with each term, over all rows."""
    def run(batches):
        terms, total, n = Terms(), np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for _, counts in rows_of(batch.column(0), terms):
                total += (counts > 0).sum(axis=0)
                n += len(counts)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(ids, TERMS)), pa.array(np.append(total[ids], n))], ["term", "n"])

    sums = docs.select(F.col(text).cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(TERMS + 1, np.int64)
    for row in sums:  # at most TERMS + 1 rows
        found[row["term"]] = row["n"]
    return int(found[TERMS]), found[:TERMS]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label", sample: int = SAMPLE) -> Voters:
    """Voters from the texts of `docs` that `labels` (key, label 0 or 1) covers: of each label at most `sample` keys.

    Those come first by a hash of the key; only their texts are read for it. Other or null labels and null keys are left
    out. Frequencies come from all rows of `docs`. Without any labelled text, scores are 0.5.
    """
    n, df = document_frequencies(docs, text)
    idf = np.log((n + 1) / (df + 0.5)).clip(0.05).astype(np.float32)
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(
        F.col(key).alias("k"), F.col(label).cast("int").alias("label"), F.xxhash64(F.col(key).cast("string")).alias("h")).distinct()
    firsts = [known.where(F.col("label") == v).orderBy("h", "k").limit(sample).select("k", "label") for v in (0, 1)]
    # At most two samples of keys: small enough to broadcast, whatever the tables hold.
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("text"))
    chosen = rows.join(F.broadcast(firsts[0].unionByName(firsts[1])), "k").select("label", "text")

    def run(batches):
        terms = Terms()
        for batch in batches:
            for first, counts in rows_of(batch.column(1), terms):
                ids = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(counts)), pa.array([i.astype("<u2").tobytes() for i in ids], pa.binary()),
                     pa.array([c[i].astype("<u4").tobytes() for i, c in zip(ids, counts)], pa.binary())], ["label", "ids", "counts"])

    found = chosen.mapInArrow(run, "label int, ids binary, counts binary").collect()
    found.sort(key=lambda r: (r["label"], bytes(r["ids"]), bytes(r["counts"])))
    if not found:
        return Voters(idf, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = np.zeros((len(found), TERMS), np.float32)
    for i, row in enumerate(found):
        x[i, np.frombuffer(row["ids"], "<u2")] = np.frombuffer(row["counts"], "<u4")
    for i in range(0, len(x), 256):
        x[i:i + 256] = weigh(x[i:i + 256], idf)
    rng = np.random.default_rng(0)
    y = x @ rng.standard_normal((TERMS, min(RANK + 16, len(found)))).astype(np.float32)
    for _ in range(3):
        y = x @ (x.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    _, _, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    basis = np.ascontiguousarray(vt[:RANK].T)
    return Voters(idf, basis, unit(x @ basis), np.array([r["label"] for r in found], np.float32))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def vote(model: Voters, counts: np.ndarray) -> np.ndarray:
    similar = unit(weigh(counts, model.idf) @ model.basis) @ model.vectors.T
    k = min(NEIGHBOURS, similar.shape[1])
    if not k:
        return np.full(len(counts), 0.5)
    best = np.argpartition(-similar, k - 1, axis=1)[:, :k]
    weights = np.clip(np.take_along_axis(similar, best, axis=1), 1e-3, 1).astype(float) ** POWER
    return ((weights * model.labels[best]).sum(axis=1) / weights.sum(axis=1)).clip(0, 1)


def score(docs: DataFrame, model: Voters, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) for every row, repeated rows and null keys included; null texts count as empty. Other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.basis, model.vectors, model.labels))

    def run(batches):
        terms, model = Terms(), Voters(*shared.value)
        for batch in batches:
            for first, counts in rows_of(batch.column(1), terms):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(counts)), pa.array(vote(model, counts).astype(float))], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)

"""Language-model scores by deleted interpolation of word bigrams.

P(w | v) = l2 * c(v, w) / c(v) + l1 * c(w) / N + l0 / (V + 1), with one weight triple for each bucket of log2 c(v). Expectation
maximisation learns the triples on held-out counts: a fold of the training texts is deleted from the counts, and its
tokens are predicted from the rest. The model then uses the counts of all training texts.

Texts become chunks of about half a million tokens, coded by the chunk's own sorted vocabulary. A chunk asks for the corpus counts
of its distinct words and pairs once, as sorted arrays of 64-bit hashes cut into hash buckets. A task that holds a bucket
adds the chunks' numbers and answers each chunk in the order of its question, so an answer carries no keys. A word or pair
that a third of all tokens are is one entry of each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.scratch import Scratch
from pairloom.llm.words import Powers, mix, slices, words_of

U = np.uint64
END, START = U(0x0E4D), U(0x57A7)  # hashes of the end of a text and of what stands before its first word
TOKENS = 1 << 19  # of a chunk, at least one text
KEYS = 1 << 19  # wanted in a bucket
STEPS = 8  # of a probability ratio, for each doubling
LEVELS = 40  # buckets of log2 c(v)
TOP = 64 * STEPS  # ratios up to 2**64


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * U(0x9E3779B97F4A7C15) + (w ^ U(0x7F4A7C15F39CC060)))


def pack(x: np.ndarray, size: int | None = None) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs (or `size`): first that number, then all lowest bytes, all second ones."""
    if size is None:
        size = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x).astype("<u8").view(np.uint8).reshape(-1, 8).T[:size]
    return bytes([size]) + planes.tobytes()


def unpack(raw: bytes) -> np.ndarray:
    size = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(size, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :size] = planes.T
    return out.view("<u8").ravel()


def squeeze(x: np.ndarray) -> bytes:
    """Packed and compressed: what a chunk carries through the job."""
    raw = pack(x)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def loosen(raw: bytes) -> np.ndarray:
    return unpack(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True))


def chunks(docs: DataFrame) -> DataFrame:
    """Rows (id, role, text) to chunk rows; role 0 is scored only, 1 trained on, 2 trained on and held out for the weights."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, number = Powers(), 0
        base = TaskContext.get().partitionId() << 24
        ids, roles, lengths, hashes, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, ids, roles, lengths, hashes, size
            vocabulary, tokens, times = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")  # frequent words get small numbers, which take less room
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            own = pa.concat_arrays(ids)
            row = pa.RecordBatch.from_arrays(
                [pa.array([base + number]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own),
                 *(pa.array([squeeze(x)], pa.binary()) for x in (np.concatenate(roles), np.concatenate(lengths), vocabulary[order], place[tokens])),
                 pa.array([len(tokens) + len(vocabulary)])], ["chunk", "ids", "roles", "lengths", "vocabulary", "tokens", "size"])
            number, ids, roles, lengths, hashes, size = number + 1, [], [], [], [], 0
            return row

        for batch in batches:
            role = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
            for part in slices(batch.column(2)):
                words = words_of(part, powers)
                count = np.diff(words.begin)
                tokens = np.insert(words.hashes, words.begin[1:], END)
                ids.append(batch.column(0).slice(part.first, part.count))
                roles.append(role[part.first:part.first + part.count])
                lengths.append(count + 1)
                hashes.append(tokens)
                size += len(tokens)
                if size >= TOKENS:
                    yield flush()
        if size:
            yield flush()

    return docs.mapInArrow(run, f"chunk long, ids array<{kind}>, roles binary, lengths binary, vocabulary binary, tokens binary, size long")


class Chunk:
    """A chunk row: its tokens as places in the vocabulary, and its distinct pairs of neighbours."""

    def __init__(self, roles: bytes, lengths: bytes, vocabulary: bytes, tokens: bytes):
        self.roles, self.lengths, self.tokens = (loosen(x).astype(np.int64) for x in (roles, lengths, tokens))
        self.vocabulary = loosen(vocabulary)
        self.end = np.flatnonzero(self.vocabulary == END)  # one place: every text has an end
        self.begin = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        n = len(self.vocabulary)
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1]
        before[self.begin] = n  # the start
        self.pairs, self.pair = np.unique(before * (n + 1) + self.tokens, return_inverse=True)
        self.v, self.w = self.pairs // (n + 1), self.pairs % (n + 1)
        self.role = np.repeat(self.roles, self.lengths)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        return self.vocabulary, pair_keys(np.append(self.vocabulary, START)[self.v], self.vocabulary[self.w])

    def numbers(self, which: np.ndarray, size: int, role: int) -> np.ndarray:
        """How often each entry occurs in texts of at least that role."""
        return np.bincount(which[self.role >= role], minlength=size)


PAIR_BITS = 48  # of a pair's key behind the bits that name its bucket; words keep all 64


def cut_keys(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and where each bucket begins in it."""
    order = np.argsort(keys)
    bits = buckets.bit_length() - 1
    begin = np.searchsorted(keys[order], np.arange(buckets, dtype=U) << U(64 - bits)) if bits else np.zeros(1, np.int64)
    return order, np.append(begin, len(keys))


def questions(chunk_rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, keys1, all1, out1, keys2, all2, out2): sorted keys of words and pairs with the chunk's own numbers."""
    bits = U(buckets.bit_length() - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                chunk = Chunk(*(batch.column(c)[i].as_py() for c in range(1, 5)))
                columns: list[list] = []
                for kind, keys, which in zip("12", chunk.keys(), (chunk.tokens, chunk.pair)):
                    order, cuts = cut_keys(keys, buckets)
                    keys = keys[order]
                    short = (keys << bits) >> U(64 - PAIR_BITS) if kind == "2" else keys
                    sides = [(short, PAIR_BITS // 8 if kind == "2" else 8), *((chunk.numbers(which, len(keys), r)[order], None) for r in (1, 2))]
                    columns += [[pack(x[a:b], size) for a, b in zip(cuts[:-1], cuts[1:])] for x, size in sides]
                used = [b for b in range(buckets) if len(columns[0][b]) > 1 or len(columns[3][b]) > 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used, pa.int64()), pa.array([batch.column(0)[i].as_py()] * len(used), pa.int64()), *(pa.array([c[b] for b in used], pa.binary()) for c in columns)],
                    ["bucket", "chunk", "keys1", "all1", "out1", "keys2", "all2", "out2"])

    return chunk_rows.select("chunk", "roles", "lengths", "vocabulary", "tokens").mapInArrow(
        run, "bucket long, chunk long, keys1 binary, all1 binary, out1 binary, keys2 binary, all2 binary, out2 binary")


def answer(group: pa.Table) -> pa.Table:
    """The corpus counts of a bucket's keys, for each chunk in the order of its question; `types` counts trained words once."""
    out, types = {}, 0
    for kind in "12":
        parts = [unpack(x) for x in group[f"keys{kind}"].to_pylist()]
        ends = np.cumsum([len(p) for p in parts])
        unique, which = np.unique(np.concatenate(parts), return_inverse=True)
        for name in ("all", "out"):
            numbers = np.concatenate([unpack(x) for x in group[f"{name}{kind}"].to_pylist()])
            total = np.bincount(which, weights=numbers, minlength=len(unique)).astype(np.int64)
            if name == "all" and kind == "1":
                types = int((total > 0).sum())
            out[name + kind] = [pack(x) for x in np.split(total[which], ends[:-1])]
    n = group.num_rows
    return pa.table([group["bucket"], group["chunk"], *(pa.array(out[c], pa.binary()) for c in COUNTS), pa.array([types] + [0] * (n - 1), pa.int64())],
                    names=["bucket", "chunk", *COUNTS, "types"])


ANSWER = "bucket long, chunk long, all1 binary, out1 binary, all2 binary, out2 binary, types long"
COUNTS = ("all1", "out1", "all2", "out2")


def level(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.log2(np.maximum(count, 1)).astype(np.int64) + 1, 0).clip(0, LEVELS - 1)


def answered(row: pa.RecordBatch, i: int) -> tuple[Chunk, list[np.ndarray]]:
    """A chunk and its counts, put back in the order of its vocabulary and pairs; the start's count is the number of texts."""
    get = lambda c: row.column(row.schema.names.index(c))[i].as_py()
    chunk = Chunk(get("roles"), get("lengths"), get("vocabulary"), get("tokens"))
    out = []
    for keys, names in zip(chunk.keys(), (("all1", "out1"), ("all2", "out2"))):
        order = np.argsort(keys)
        for name in names:
            counts = np.empty(len(keys), np.int64)
            counts[order] = loosen(get(name))
            out.append(counts)
    return chunk, out


def statistics(ready: DataFrame, total: int, out: int, types: int) -> DataFrame:
    """Held-out tokens by (level, q2, q1, n): the probabilities' ratios to the uniform one, in steps of a STEPS-th doubling."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for i in range(len(batch)):
                chunk, (all1, out1, all2, out2) = answered(batch, i)
                n = chunk.numbers(chunk.pair, len(chunk.pairs), 2)
                left = all1 - out1
                context = np.append(left, left[chunk.end])[chunk.v]  # as many starts as ends
                p2 = (all2 - out2) / np.maximum(context, 1)
                p1 = left[chunk.w] / max(total - out, 1)
                q2, q1 = (np.where(p > 0, np.round(STEPS * np.log2(np.maximum(p, 1e-300) * (types + 1))) + TOP, 0).clip(0, 2 * TOP).astype(np.int64) for p in (p2, p1))
                used = n > 0
                key = ((level(context) * 4096 + q2) * 4096 + q1)[used]
                keys, which = np.unique(np.concatenate([sums[0], key]), return_inverse=True)
                sums = keys, np.bincount(which, weights=np.concatenate([sums[1], n[used]]), minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums[0]), pa.array(sums[1])], ["key", "n"])

    return ready.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def learn(cells: pd.DataFrame, rounds: int = 100) -> np.ndarray:
    """Weights (l2, l1, l0) by level. Levels without held-out tokens take those of the nearest level that has some."""
    weights = np.full((LEVELS, 3), np.nan)
    key, n = cells["key"].to_numpy(np.int64), cells["n"].to_numpy(float)
    p = np.ones((len(key), 3))
    for j, q in ((0, (key >> 12) & 4095), (1, key & 4095)):
        p[:, j] = np.where(q > 0, 2.0 ** ((q - TOP) / STEPS), 0)
    for b in np.unique(key >> 24):
        mine = key >> 24 == b
        x, m, w = p[mine], n[mine], np.array([1 / 3, 1 / 3, 1 / 3]) if b else np.array([0, 1 / 2, 1 / 2])
        for _ in range(rounds):
            part = x * w
            w = (m[:, None] * part / part.sum(axis=1, keepdims=True)).sum(axis=0)
            w = np.maximum(w / w.sum(), 1e-9 if b else [0, 1e-9, 1e-9])  # l0 never vanishes: every text keeps a probability
            w /= w.sum()
        weights[b] = w
    known = np.flatnonzero(~np.isnan(weights[:, 0]))
    for b in range(LEVELS):
        if b not in known:
            near = known[known > 0] if b else known[:0]
            weights[b] = weights[near[np.argmin(np.abs(near - b))]] if len(near) else ([0, 0.5, 0.5] if b == 0 else [1 / 3] * 3)
    return weights


def interpolated(docs: DataFrame, key: str = "doc_id", text: str = "text", trained: Column | None = None, held_out: Column | None = None) -> DataFrame:
    """Scores of all whole texts: (key, n_tokens, n_known, train_tokens, base_score, score), one row for each input row.

    Tokens are lower-cased words and one end. `trained` says which rows the model learns from (all, if left out; null: not),
    `held_out` which of those the weights are learned on (a fifth of them by the key's crc32, if left out). `base_score` is the
    add-one unigram score, `n_known` counts tokens that occur in training, `score` is log10 of the text's probability. Null
    texts are empty: their end is still a token. Repeated rows count each; null keys stay null. Without training text, all
    tokens are unknown. Words are told apart by 64-bit hashes. Other columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "ngram")
    trained = F.lit(True) if trained is None else trained
    held_out = F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0 if held_out is None else held_out
    role = F.when(F.coalesce(trained, F.lit(False)), F.when(F.coalesce(held_out, F.lit(False)), 2).otherwise(1)).otherwise(0)
    rows = docs.select(F.col(key).alias("id"), role.cast("int").alias("role"), F.col(text).cast("string").alias("text"))
    made = scratch.table(chunks(rows), "chunks")
    sizes = made.agg(F.sum("size")).first()[0] or 0
    buckets = 1 << max(0, int(sizes / KEYS).bit_length())
    answers = scratch.table(questions(made, buckets).groupBy("bucket").applyInArrow(answer, ANSWER), "answers")
    types = answers.agg(F.sum("types")).first()[0] or 0

    def merge(group: pa.Table) -> pa.Table:
        """A chunk's row with all its answers in the order of the buckets."""
        group = group.combine_chunks().sort_by("bucket")
        own = group.slice(0, 1)  # bucket -1: the chunk itself
        joined = {c: squeeze(np.concatenate([unpack(x) for x in group[c].to_pylist()[1:]])) for c in COUNTS}
        return pa.table([own[c] if c not in COUNTS else pa.array([joined[c]], pa.binary()) for c in own.schema.names], schema=own.schema)

    kinds = made.schema["ids"].dataType
    schema = f"bucket long, chunk long, ids {kinds.simpleString()}, roles binary, lengths binary, vocabulary binary, tokens binary, all1 binary, out1 binary, all2 binary, out2 binary"
    names = [part.strip().split(" ")[0] for part in schema.split(", ")]
    both = made.drop("size").withColumn("bucket", F.lit(-1).cast("long")).unionByName(answers.drop("types"), allowMissingColumns=True).select(*names)
    ready = scratch.table(both.groupBy("chunk").applyInArrow(merge, schema), "ready")
    scratch.drop("chunks")
    scratch.drop("answers")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = out = 0
        for batch in batches:
            for roles, lengths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                role, length = loosen(roles), loosen(lengths)
                total, out = total + int(length[role >= 1].sum()), out + int(length[role == 2].sum())
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([out])], ["total", "out"])

    total, out = (x or 0 for x in ready.select("roles", "lengths").mapInArrow(count, "total long, out long").agg(F.sum("total"), F.sum("out")).first())
    weights = learn(statistics(ready, total, out, types).toPandas())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                chunk, (all1, _, all2, _) = answered(batch, i)
                context = np.append(all1, all1[chunk.end])[chunk.v]
                w = weights[level(context)]
                p = w[:, 0] * all2 / np.maximum(context, 1) + w[:, 1] * all1[chunk.w] / max(total, 1) + w[:, 2] / (types + 1)
                base = np.log10((all1 + 1) / (total + types + 1))
                ids = batch.column(batch.schema.names.index("ids"))[i].values
                per_text = lambda x: np.add.reduceat(x, chunk.begin)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(chunk.lengths), pa.array(per_text((all1 > 0)[chunk.tokens].astype(np.int64))), pa.array(np.full(len(ids), total)),
                     pa.array(per_text(base[chunk.tokens])), pa.array(per_text(np.log10(p)[chunk.pair]))],
                    ["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scored = ready.mapInArrow(score, f"id {kinds.elementType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", key)

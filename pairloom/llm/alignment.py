"""Alignment of two tokenizers' tokens on the same texts, and how often their ids meet across the corpus.

A byte-level tokenizer (A) and a piece tokenizer with byte fallback (B) cut the bytes of a blank and the text behind it.
Two tokens are linked if their byte ranges overlap. Groups come from pointer jumping: a token points to the token that
overlaps it and ends farthest to the right, a token of A where both end points to itself, and successors are doubled until
nothing moves; tokens with one terminal are one group.

Both tokenizers always begin a token at a blank that follows a character other than white space. Between two such places
a stretch of text has the same tokens, links and groups wherever it stands, so each task aligns every distinct stretch
once and puts documents together from stretches in numpy. A chunk of a few megabytes of documents keeps its distinct id
pairs; those are shuffled, to be counted over the corpus and to bring the counts back to the chunk. Of a document's links
the chunk's row holds each pair's number in the chunk and how often it comes, in as few bytes as they need.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.scratch import Scratch
from pairloom.llm.words import slices, tidy

CHUNK = 2 << 20  # bytes of text whose id pairs are counted together; a longer text is a chunk of its own
ROW = 128  # bytes that a row weighs besides its text, so that empty texts fill a chunk too
SLICE = 256 << 10  # bytes of text that are aligned at once
BATCH = str(4 << 20)  # bytes of rows that Spark hands to a worker at once, whatever the length of a text
TOGETHER = 4096  # characters of new stretches that go to a tokenizer in one call
KNOWN = 40 << 20  # bytes of stretches remembered from chunk to chunk, some 200,000 words
MARK = "▁"  # a blank, within the pieces of B
ODD = re.compile(r"\s |\s\Z")  # white space before a blank or at the end
CUT = re.compile(r"(?<=\S)(?= )")
BYTE = re.compile(r"<0x([0-9A-F]{2})>")
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(None)
def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else the next free from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_tokenizer(path: str):
    """The tokenizer in a file, the same one in all tasks of a worker: what this library holds for texts it has encoded stays in memory when a tokenizer goes."""
    import tokenizers  # this module travels with each task, so the tokenizer is kept at one that does not
    kept, at = vars(tokenizers).setdefault("_pairloom_kept", {}), os.stat(path)
    name = path, at.st_mtime_ns, at.st_size
    if name not in kept:
        kept.clear()
        kept[name] = tokenizers.Tokenizer.from_file(path)
    return kept[name]


class Pair:
    """Both tokenizers, and the bytes of every id."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        self.a = byte_tokenizer(a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        letters = byte_letters()
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        self.bytes_a = [bytes(letters[c] for c in names.get(i, "")) for i in range(max(names) + 1)]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of the second tokenizer goes on behind a blank")
        self.bytes_b = [bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := BYTE.fullmatch(p)) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.blank = [self.b.piece_to_id(MARK)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in table], np.int64) for table in (self.bytes_a, self.bytes_b))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of texts that begin with a blank; B adds that blank itself, but not to an empty text."""
        ids_a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        return ids_a, [ids or self.blank for ids in self.b.encode([t[1:] for t in texts], num_threads=1)]

    def spell(self, texts: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> list[bool]:
        """Whether the tokens of both sides join to the text."""
        bytes_a, bytes_b = self.bytes_a, self.bytes_b
        return [b"".join([bytes_a[i] for i in x]) == (raw := t.encode()) and b"".join([bytes_b[i] for i in y]) == raw
                for t, x, y in zip(texts, ids_a, ids_b)]


def overlaps(ends_a: np.ndarray, sizes_a: np.ndarray, ends_b: np.ndarray, sizes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A the first token of B that overlaps it, and the one behind the last."""
    return np.searchsorted(ends_b, ends_a - sizes_a, side="right"), np.searchsorted(ends_b - sizes_b, ends_a, side="left")


def terminals(ends_a: np.ndarray, sizes_a: np.ndarray, ends_b: np.ndarray, sizes_b: np.ndarray) -> np.ndarray:
    """The terminal token of each token's group, tokens of A first, then those of B: pointer jumping over successors."""
    n = len(ends_a)
    last_b = overlaps(ends_a, sizes_a, ends_b, sizes_b)[1] - 1
    last_a = overlaps(ends_b, sizes_b, ends_a, sizes_a)[1] - 1
    after = np.concatenate([np.where(ends_b[last_b] > ends_a, n + last_b, np.arange(n)), last_a]) if n else np.zeros(0, np.int64)
    while True:
        beyond = after[after]
        if np.array_equal(beyond, after):
            return after
        after = beyond


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for `lengths[0]` numbers, then the same for the next."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def flat(lists: Iterable[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64)


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, and the sum of its times."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.add.reduceat(times[order], first) if len(first) else times[:0]


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on, in as few bytes each as the largest needs."""
    return x.astype(np.min_scalar_type(x.max(initial=0)).newbyteorder("<")).tobytes()


def unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run inside gets its rows in batches of BATCH bytes."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, BATCH)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Stretches:
    """Aligned stretches by number: tokens, groups, the id pairs of their links, and their groups as text.

    A stretch is known by its text without the blank in front.
    """

    def __init__(self, pair: Pair):
        self.pair = pair
        self.shown = [[f"{i}{mark}" for i in range(max(len(pair.bytes_a), len(pair.bytes_b)))] for mark in ",|;"]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.named: list[str] = []
        self.size = 0
        self.good = np.zeros(0, bool)
        self.counts, self.begin, self.links = np.zeros((0, 4), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)

    def learn(self, new: list[str]) -> None:
        """Align stretches that are not known yet, many in one text as long as that text is spelled by both sides."""
        groups, group, size = [], [], 0
        for t in new:
            group.append(t)
            size += len(t)
            if size > TOGETHER or not t or t[-1].isspace():  # nothing may follow white space
                groups.append(group)
                group, size = [], 0
        groups += [group] if group else []
        texts = [" " + " ".join(g) for g in groups]
        coded = self.pair.encode(texts)
        fine = self.pair.spell(texts, *coded)
        whole = [(g, x, y) for g, x, y, ok in zip(groups, *coded, fine) if ok]
        odd = [t for g, ok in zip(groups, fine) if not ok for t in g]
        wrong = []
        if odd:
            texts = [" " + t for t in odd]
            coded = self.pair.encode(texts)
            fine = self.pair.spell(texts, *coded)
            whole += [([t], x, y) for t, x, y, ok in zip(odd, *coded, fine) if ok]
            wrong = [t for t, ok in zip(odd, fine) if not ok]
        self.align(whole)
        self.add(wrong, np.zeros((len(wrong), 4), np.int64), [""] * len(wrong), np.zeros(0, np.int64), False)

    def align(self, whole: list[tuple[list[str], list[int], list[int]]]) -> None:
        texts = [t for g, _, _ in whole for t in g]
        if not texts:
            return
        ids_a, ids_b = flat(x for _, x, _ in whole), flat(y for _, _, y in whole)
        sizes_a, sizes_b = self.pair.sizes_a[ids_a], self.pair.sizes_b[ids_b]
        ends_a, ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        stops = np.cumsum([len(t.encode()) + 1 for t in texts])
        stop_a, stop_b = np.searchsorted(ends_a, stops), np.searchsorted(ends_b, stops)
        if not (np.array_equal(ends_a[stop_a], stops) and np.array_equal(ends_b[stop_b], stops)):
            raise ValueError("a tokenizer joins text across a blank")
        n = len(ids_a)
        terminal = terminals(ends_a, sizes_a, ends_b, sizes_b)
        label = ends_a[terminal]  # a group is told by the byte at which it ends
        first, behind = overlaps(ends_a, sizes_a, ends_b, sizes_b)
        links = np.repeat(ids_a, behind - first) << 32 | ids_b[ranges(first, behind - first)]
        linked = np.concatenate([[0], np.cumsum(behind - first)])
        per = [np.diff(np.concatenate([[0], x])) for x in (stop_a + 1, stop_b + 1)]
        closes = ends_a[terminal[:n] == np.arange(n)]
        per.append(np.diff(np.searchsorted(closes, np.concatenate([[0], stops]), side="right")))
        per.append(np.diff(np.concatenate([[0], linked[stop_a + 1]])))
        side = np.concatenate([np.zeros(n, np.int64), np.ones(len(ids_b), np.int64)])
        order = np.lexsort((side, label))  # stable: by group, A before B, in the order of the text
        label, side = label[order], side[order]
        mark = np.where(label[1:] != label[:-1], 2, np.where(side[1:] != side[:-1], 1, 0)).tolist() + [2]
        shown = self.shown
        words = [shown[m][i] for i, m in zip(np.concatenate([ids_a, ids_b])[order].tolist(), mark)]
        at = np.concatenate([[0], np.cumsum(per[0] + per[1])]).tolist()
        self.add(texts, np.stack(per, 1), ["".join(words[i:j])[:-1] for i, j in zip(at, at[1:])], links, True)

    def add(self, texts: list[str], counts: np.ndarray, named: list[str], links: np.ndarray, good: bool) -> None:
        first = len(self.named)
        self.number.update(zip(texts, range(first, first + len(texts))))
        self.named += named
        self.size += sum(map(len, texts)) + sum(map(len, named)) + links.nbytes + 100 * len(texts)
        self.good = np.concatenate([self.good, np.full(len(texts), good)])
        self.counts = np.concatenate([self.counts, counts])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(counts[:, 3])])
        self.links = np.concatenate([self.links, links])

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The stretches of each text's tokens, by number; new ones are learned first."""
        cut = []
        for t in texts:
            odd = ODD.search(t) or t[:1] == " "
            cut.append([s[1:] for s in CUT.split(" " + t)] if odd else t.split(" ") if t else [])
        new = set(chain.from_iterable(cut)).difference(self.number)
        if new:
            self.learn(list(new))
        number = self.number.__getitem__
        return [np.fromiter(map(number, c), np.int64, len(c)) for c in cut]


class Chunk:
    """Documents of one chunk: which stretches each has how often, and the id pairs of those."""

    def __init__(self, known: Stretches, digest: bool):
        self.known, self.digest, self.size = known, digest, 0
        self.keys: list[pa.Array] = []
        self.named: list[str] = []
        self.counts: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.stretches: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.n = 0

    def add(self, keys: pa.Array, texts: list[str], size: int) -> None:
        lists = self.known.of(texts)
        good, named, out = self.known.good, self.known.named, []
        lists = [x if good[x].all() else x[:0] for x in lists]
        for numbers in lists:
            text = ";".join([named[i] for i in numbers.tolist()])
            out.append(hashlib.sha256(text.encode()).hexdigest() if self.digest and len(numbers) else text)
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.concatenate(lists)
        doc = np.repeat(np.arange(len(lists)), lengths)
        sums = np.stack([np.bincount(doc, self.known.counts[flat, k], len(lists)).astype(np.int64) for k in range(4)], 1)
        each, times = np.unique(doc * len(self.known.named) + flat, return_counts=True) if len(flat) else (flat, flat)
        doc, number = np.divmod(each, max(len(self.known.named), 1))
        self.keys.append(keys)
        self.named += out
        self.counts.append(sums)
        self.docs.append(doc + self.n)
        self.stretches.append(number)
        self.times.append(times)
        self.n += len(lists)
        self.size += size + ROW * len(lists)

    def row(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        docs, used, times = (np.concatenate(x) for x in (self.docs, self.stretches, self.times))
        own, which = np.unique(used, return_inverse=True)
        lengths = self.known.counts[own, 3]
        links = self.known.links[ranges(self.known.begin[own], lengths)]
        pairs, at = np.unique(links, return_inverse=True)
        begin = np.cumsum(lengths) - lengths
        # Every (document, pair) once, and how often it comes.
        held = np.repeat(docs, lengths[which]) * max(len(pairs), 1) + at[ranges(begin[which], lengths[which])]
        held, often = summed(held, np.repeat(times, lengths[which]))
        docs, at = np.divmod(held, max(len(pairs), 1))
        holders = np.bincount(at, minlength=len(pairs))
        counts = np.concatenate(self.counts)
        one = lambda x, t: pa.array([x], t)
        raw = lambda x: one(x, pa.binary())
        listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        keys = pa.concat_arrays(self.keys).cast(kind)
        return pa.RecordBatch.from_arrays(
            [one(number, pa.int64()), listed(keys), listed(pa.array(self.named, pa.string())), raw(counts.astype("<i8").tobytes()),
             raw(np.bincount(docs, minlength=self.n).astype("<i8").tobytes()), raw(packed(at)), raw(packed(often)),
             listed(pa.array(pairs)), listed(pa.array(holders.astype(np.int64)))],
            ["chunk", "keys", "named", "counts", "sizes", "at", "often", "pairs", "holders"])


def align(docs: DataFrame, key: str = "doc_id", text: str = "text", a: str | None = None, b: str | None = None,
          digest: bool = False) -> DataFrame:
    """One row for each row of `docs`: `key`, n_a, n_b, n_groups, n_links, n_best, count_sum, groups.

    n_a and n_b count tokens, n_links all overlapping pairs of a token of A and one of B. The count of an id pair is the
    number of rows that hold it linked; n_best counts links whose count is the highest of their A id (ties included),
    count_sum adds the counts of all links. `groups` reads `a1,a2|b1;a3|b2,b3`: ids of A and B, group after group; with
    `digest` its sha256 in hex. A null or empty text, or one that either side's tokens do not spell (a blank mark of B in
    the text), has zeros and an empty `groups`. Repeated rows count as rows of their own; a null key stays null; columns
    besides key and text are not read. An empty table gives an empty table. `a` is the path of a byte-level vocabulary,
    `b` of a piece model; stretches between blanks have to be tokenised alone by both, which is verified on the vocabulary
    and on every stretch.
    """
    scratch = Scratch(docs.sparkSession, "alignment")
    a, b = a or vocabulary("byte_bpe_50k.json"), b or vocabulary("piece_bpe_32k.model")
    kind = docs.schema[key].dataType.simpleString()

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = Stretches(Pair(a, b)), TaskContext.get().partitionId() << 32
        chunk = Chunk(known, digest)
        key_type = None
        for batch in batches:
            keys, texts, key_type = batch.column(0), batch.column(1), batch.schema.field(0).type
            for part in slices(texts, SLICE):
                own = texts.slice(part.first, part.count).to_pylist()
                chunk.add(keys.slice(part.first, part.count), [t or "" for t in own], len(part.data))
                if chunk.size >= CHUNK:
                    yield chunk.row(number, key_type)
                    number += 1
                    if known.size > KNOWN:
                        known.forget()
                    chunk = Chunk(known, digest)
        if chunk.n:
            yield chunk.row(number, key_type)

    with small_batches(docs.sparkSession):
        chunks = scratch.table(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
            read, f"chunk long, keys array<{kind}>, named array<string>, counts binary, sizes binary, at binary, often binary, "
                  "pairs array<long>, holders array<long>"), "chunks")
    asked = chunks.select("chunk", F.posexplode(F.arrays_zip("pairs", "holders")).alias("at", "p")).select(
        "chunk", "at", F.col("p.pairs").alias("pair"), F.col("p.holders").alias("n"))
    total = scratch.table(asked.groupBy("pair").agg(F.sum("n").alias("n")), "total")
    most = total.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    # A count and whether it is its A id's highest, in one number.
    counts = total.join(most, F.shiftright("pair", 32) == F.col("a")).select("pair", (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("long")).alias("v"))
    answers = asked.select("chunk", "at", "pair").join(counts, "pair").select("chunk", "at", "v")

    def finish(_: tuple, mine: pa.Table, found: pa.Table) -> pa.Table:
        row = mine.combine_chunks().to_batches()[0]
        raw = lambda name, t: np.frombuffer(row.column(name)[0].as_py(), t)
        keys, named = row.column("keys")[0].values, row.column("named")[0].values
        counts = raw("counts", "<i8").reshape(len(keys), 4)
        v = np.zeros(found.num_rows, np.int64)
        v[found.column("at").to_numpy()] = found.column("v").to_numpy()
        ends = np.concatenate([[0], np.cumsum(raw("sizes", "<i8"))])
        at, often = (unpacked(row.column(name)[0].as_py(), int(ends[-1])) for name in ("at", "often"))
        sums = []
        for x in (v & 1, v >> 1):
            upto = np.concatenate([[0], np.cumsum(x[at] * often)])
            sums.append(upto[ends[1:]] - upto[ends[:-1]])
        return pa.Table.from_arrays([keys, *(pa.array(counts[:, k]) for k in range(4)), *map(pa.array, sums), named],
                                    ["key", *COUNTS, "n_best", "count_sum", "groups"])

    held = chunks.withColumnRenamed("chunk", "own").drop("pairs", "holders")
    out = held.groupBy("own").cogroup(answers.groupBy("chunk")).applyInArrow(
        finish, f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return out.withColumnRenamed("key", key)

"""Best-fit packing of tokenised documents into sequences of a fixed length.

Tokens: a document's ids come from a public tokenizer, computed once for each distinct blank-separated chunk of a task and
put together in numpy; an end id closes the document. Only documents longer than a sequence are cut.

Packing is bulk-synchronous best-fit. Pieces and gaps are integers up to the sequence length, so pieces of one length are
interchangeable and so are gaps of one size; a sweep works on their counts (at most one class for each length, however
many documents there are). Sweeping lengths from long to short, each class takes the smallest gap that fits; when several
pieces want one gap, ranks decide who gets it; gaps shrink; the next class repeats. Pieces are range-sorted by (length,
key) on Spark to get their ranks, and every task looks its pieces' ranks up among the successors in the sweep's plan.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.scratch import Scratch, cut_lineage
from pairloom.llm.words import Powers, Words, slices, tidy, words_of

END = 0
KNOWN = 1 << 20  # chunks remembered in a task before its memory is cleared


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class ChunkEncoder:
    """Ids of chunks, remembered by hash while a task runs.

    White space never reaches a token, so the ids of a text are those of its blank-separated chunks in order. Chunks of
    plain letters, perhaps with one mark behind them, go to the same merges without the general normaliser and splitter;
    all other chunks take the whole tokenizer. Its control strings are found in texts as they are written, before letters
    become small, so a chunk that holds one is known by its own bytes and never lower-cased here.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.path, self.literal = path, None
        self.whole = Tokenizer.from_file(path)
        controls = [re.escape(t.content.encode()) for t in self.whole.get_added_tokens_decoder().values()]
        self.control = re.compile(b"|".join(controls)) if controls else None
        self.whole.encode_special_tokens = True  # for lower-cased chunks, whose control strings may not be written so
        self.plain = Tokenizer.from_file(path)
        self.plain.encode_special_tokens = True
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        ids = self.plain.get_vocab(with_added_tokens=False)
        self.closing = np.zeros(max(ids.values()) + 1, bool)  # ids that end a word
        self.closing[[i for t, i in ids.items() if t.endswith("</w>")]] = True
        self.marks = {m: self.whole.encode(m, add_special_tokens=False).ids for m in ".,;:!?"}
        self.forget()

    def forget(self) -> None:
        self.keys, self.where = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def learn(self, hashes: np.ndarray, chunks: list[str], controlled: np.ndarray) -> None:
        found: list = [None] * len(chunks)
        for i in np.flatnonzero(controlled):
            found[i] = self.encode_literally(chunks[i])
        letters, marks, plain = [], [], []
        for i, chunk in enumerate(chunks):
            mark = chunk[-1] if chunk[-1] in self.marks else ""
            word = chunk[:-1] if mark else chunk
            if word.isalpha() and word.islower() and max(word) < "ƀ":
                letters.append(word)
                marks.append(mark)
                plain.append(i)
        lists = self.encode_words(letters)
        for i, mark, ids in zip(plain, marks, lists):
            found[i] = [*ids, *self.marks[mark]] if mark else ids
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, coded in zip(rest, self.whole.encode_batch_fast([chunks[i] for i in rest], add_special_tokens=False)):
            found[i] = coded.ids
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((x for ids in found for x in ids), np.uint32, int(lengths.sum()))
        first = len(self.starts) - 1
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        self.ids = np.concatenate([self.ids, flat])
        keys = np.concatenate([self.keys, hashes])
        where = np.concatenate([self.where, np.arange(first, first + len(hashes))])
        order = np.argsort(keys, kind="stable")
        self.keys, self.where = keys[order], where[order]

    def encode_literally(self, chunk: str) -> list[int]:
        """Ids of a chunk as written, control strings as their ids; few texts hold one, so its tokenizer is loaded when one does."""
        if self.literal is None:
            from tokenizers import Tokenizer
            self.literal = Tokenizer.from_file(self.path)
        return self.literal.encode(chunk, add_special_tokens=False).ids

    def encode_words(self, words: list[str], together: int = 64) -> list[list[int]]:
        """Words of letters, many in one call: an id that ends a word tells them apart."""
        out: list[list[int]] = []
        texts = [" ".join(words[i:i + together]) for i in range(0, len(words), together)]
        for i, coded in enumerate(self.plain.encode_batch_fast(texts, add_special_tokens=False)):
            ids, part = coded.ids, words[i * together:(i + 1) * together]
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) == len(part):
                out += [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
            else:  # a vocabulary without whole ends
                out += [x.ids for x in self.whole.encode_batch_fast(part, add_special_tokens=False)]
        return out

    def controlled(self, raw: bytes, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Which chunks hold a control string, and the hashes of all chunks: those chunks' are of their bytes as written."""
        found = np.zeros(len(words.starts), bool)
        at = [m.start() for m in self.control.finditer(raw)] if self.control else []
        if not at:
            return found, words.hashes
        hashes = words.hashes.copy()
        for i in np.unique(np.searchsorted(words.starts, at, side="right") - 1).tolist():
            chunk = raw[words.starts[i]:words.ends[i]]
            if self.control.search(chunk):  # not one that two texts make together
                found[i], hashes[i] = True, xxhash.xxh64_intdigest(chunk, 9)
        return found, hashes

    def encode(self, part, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a slice's texts, one after the other, and where each text's begin."""
        words, raw = words_of(part, powers), part.data.tobytes()
        controlled, hashes = self.controlled(raw, words)
        unique, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN:
            self.forget()
        new = unique if not len(self.keys) else unique[self.keys[np.minimum(np.searchsorted(self.keys, unique), len(self.keys) - 1)] != unique]
        if len(new):
            at = first[np.searchsorted(unique, new)]
            chunks = [raw[a:b] if own else raw[a:b].lower() for a, b, own in zip(words.starts[at].tolist(), words.ends[at].tolist(), controlled[at].tolist())]
            self.learn(new, [c.decode("utf-8") for c in chunks], controlled[at])
        entry = self.where[np.searchsorted(self.keys, unique)][which] if len(unique) else np.zeros(0, np.int64)
        lengths = self.starts[entry + 1] - self.starts[entry]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(self.starts[entry] - ends[:-1], lengths) + np.arange(ends[-1])
        return self.ids[at], ends[words.begin]


def checked(path: str) -> None:
    """Raise unless the tokenizer's ids of a text are those of its lower-cased, blank-separated chunks."""
    from tokenizers import Tokenizer
    ids = lambda text: Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    if ids("The  CAT\n sat,") != [*ids("the"), *ids("cat"), *ids("sat,")]:
        raise ValueError(f"{path} keeps letter case or white space: its texts cannot be cut into lower-cased chunks")


def cut_documents(docs: DataFrame, tokenizer: str | None = None, length: int = 2048, key: str = "doc_id",
                  text: str = "text", end: int = END) -> DataFrame:
    """Tokenise whole texts and cut those longer than `length`: (key, piece, start, length, ids).

    `ids` holds unsigned little-endian 32-bit ids, the end id last. Null and empty texts give one piece, the end id alone.
    Repeated rows give repeated pieces; a null key stays null. Other columns are not read. Control strings of the
    tokenizer inside texts become its control ids. A tokenizer that tells large letters or white space apart is refused.
    """
    path = tokenizer or vocabulary()
    if tokenizer:
        checked(tokenizer)
    kind = docs.schema[key].dataType

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, powers = ChunkEncoder(path), Powers()
        for batch in batches:
            for part in slices(batch.column(1)):
                ids, begin = coder.encode(part, powers)
                rows, pieces, starts, lengths, parts = [], [], [], [], []
                for i in range(part.count):
                    whole = np.append(ids[begin[i]:begin[i + 1]], np.uint32(end)).astype("<u4")
                    for piece, a in enumerate(range(0, len(whole), length)):
                        cut = whole[a:a + length]
                        rows.append(part.first + i)
                        pieces.append(piece)
                        starts.append(a)
                        lengths.append(len(cut))
                        parts.append(cut.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(parts, pa.binary())], ["key", "piece", "start", "length", "ids"])

    out = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"key {kind.simpleString()}, piece int, start long, length long, ids binary")
    return out.withColumnRenamed("key", key)


def best_fit(counts: dict[int, int], length: int) -> pd.DataFrame:
    """The sweep over classes: for each length a number of rank ranges, and the sequence and place each range starts at.

    Rows: length, rank (the first of the range), n, sequence (of the first), offset. Ranks i of a range go to consecutive
    sequences. Sequences of one state (same gap) form runs; a run is split where only part of it takes a piece. Runs are
    bounded by the number of (length, gap) pairs that meet, whatever the number of pieces.
    """
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]  # by gap: runs (first sequence, number)
    open_gaps: set[int] = set()
    plan, opened = [], 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            # The next sweep of this class: each gap once, the smallest that fits first; then new sequences, as many pieces
            # of this length to each as fit into it.
            gap = min((g for g in open_gaps if g >= size), default=None)
            if gap is None:
                each = length // size
                first, number = opened, -(-left // each)
                opened += number
                runs, gap = [(first, number)], length
            else:
                runs, gaps[gap] = gaps[gap], []
                open_gaps.discard(gap)
            fits = gap // size
            for first, number in runs:
                whole = min(number, left // fits)  # these sequences take as many pieces as fit
                at = gap
                if whole:
                    for j in range(fits):
                        plan.append((size, rank, whole, first, length - gap + j * size))
                        rank += whole
                    left -= whole * fits
                    rest = gap - fits * size
                    if rest:
                        gaps[rest].append((first, whole))
                        open_gaps.add(rest)
                if left and whole < number:  # one sequence takes what is left
                    for j in range(left):
                        plan.append((size, rank, 1, first + whole, length - gap + j * size))
                        rank += 1
                    rest = gap - left * size
                    left = 0
                    if rest:
                        gaps[rest].append((first + whole, 1))
                        open_gaps.add(rest)
                    whole += 1
                if whole < number:
                    gaps[at].append((first + whole, number - whole))
                    open_gaps.add(at)
    return pd.DataFrame(plan, columns=["length", "rank", "n", "sequence", "offset"]).astype("int64")


def ranked(pieces: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Range-sort by length and all other columns, and number each partition's pieces of one length from 0 (`rank`).

    Returns the written pieces and, for each (length, part), how many pieces of that length stand in earlier partitions. A
    length that a third of all pieces have spreads over many partitions, because the other columns are part of the range.
    """
    others = [F.col(c) for c in pieces.columns if c != "length"]
    at = pieces.columns.index("length")

    @tidy
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = -1, 0
        for batch in batches:
            size = batch.column(at).to_numpy(zero_copy_only=False)
            if not len(size):
                continue
            new = np.flatnonzero(np.diff(size, prepend=last))  # a run of one length begins here
            begin = np.zeros(len(size), np.int64)
            begin[new] = new
            rank = np.arange(len(size)) - np.maximum.accumulate(begin)
            rank[:new[0] if len(new) else len(size)] += seen
            seen, last = int(rank[-1]) + 1, size[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank, pa.int64())], [*batch.schema.names, "rank"])

    schema = pieces.schema.simpleString()[len("struct<"):-1]
    placed = pieces.repartitionByRange(F.col("length"), *others).sortWithinPartitions("length", *others)
    placed = placed.mapInArrow(number, f"{schema},rank:bigint").withColumn("part", F.spark_partition_id())
    placed = scratch.table(placed, "placed")
    sizes = placed.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return placed, sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def pack(pieces: DataFrame, length: int = 2048) -> DataFrame:
    """Put every row of `pieces` (a long `length` from 1 to `length`) into a sequence: adds `sequence_id` and `offset`.

    Rows are kept as they are, repeated ones too; rows of one length are interchangeable, ties go by the other columns.
    A length that is null, below 1 or too long raises. An empty table stays empty. Input columns of the names `rank`,
    `part`, `before`, `sequence_id` and `offset` are refused: select what to keep first.
    """
    taken = {"rank", "part", "before", "sequence_id", "offset"} & {c.lower() for c in pieces.columns}
    if taken:
        raise ValueError(f"rename or drop {sorted(taken)}")
    spark, scratch = pieces.sparkSession, Scratch(pieces.sparkSession, "packing")
    # Written first: range bounds are sampled in a pass of their own, which must not tokenise again.
    written = scratch.table(pieces.withColumn("length", F.col("length").cast("long")), "pieces")
    placed, sizes = ranked(written, scratch)
    scratch.drop("pieces")
    sizes = cut_lineage(sizes)
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).limit(length + 2).collect()}
    if any(x is None or not 0 < x <= length for x in counts):
        raise ValueError(f"lengths must be from 1 to {length}")
    plan = best_fit(counts, length).sort_values(["length", "rank"])
    keys = plan["length"].to_numpy() << 44 | plan["rank"].to_numpy()  # one ordered key: fewer than 2**44 pieces of a length
    shared = spark.sparkContext.broadcast((keys, *(plan[c].to_numpy() for c in ("rank", "sequence", "offset"))))
    at, names = {c: i for i, c in enumerate([*placed.columns, "before"])}, pieces.columns

    @tidy
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, first, sequence, offset = shared.value
        for batch in batches:
            size, rank, before = (batch.column(at[c]).to_numpy(zero_copy_only=False) for c in ("length", "rank", "before"))
            rank = rank + before
            row = np.searchsorted(keys, size << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(at[c]) for c in names), pa.array(sequence[row] + rank - first[row]), pa.array(offset[row])],
                [*names, "sequence_id", "offset"])

    schema = placed.select(*names).schema.simpleString()[len("struct<"):-1]
    # Lengths and partitions are few beside the pieces: at most one row for each length and each partition.
    joined = placed.join(sizes.select("length", "part", "before"), ["length", "part"]).select(*placed.columns, "before")
    return joined.mapInArrow(place, f"{schema},sequence_id:bigint,offset:bigint")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces with their ids and places: (key, piece, start, length, ids, sequence_id, offset)."""
    return pack(cut_documents(docs, tokenizer, length, key, text), length)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence in order, with its number of pieces: (sequence_id, n_pieces, ids)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.size("parts").alias("n_pieces"), F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))

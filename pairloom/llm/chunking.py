"""Removal of repeated passages by content-defined chunking.

A gear hash rolls over the bytes of each text; where its bits match a pattern, a chunk ends. Boundaries depend on the last
WINDOW bytes alone, so an insertion moves no boundary behind it. Chunks are compared by a 128-bit digest. Of a digest's
occurrences, the one in the document with the smallest key stays (there the first); runs of others go when they are long.

Two passes over the texts: the first counts digests, with partial sums, so a line that a third of all documents hold is one
row for each task. Only digests that occur twice are kept. The second pass makes the same chunks again and passes on those
that a filter of a checked size lets through; an exact join decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.scratch import Scratch, cut_lineage
from pairloom.llm.words import BASE, BLANK, Powers, Slice, mix, randoms, slices, tidy

WINDOW = 16
LEAST, MOST = 16, 512  # bytes between boundaries
GEAR = randoms(256, 3).astype(np.uint32)
FIRST, SECOND = randoms(256, 4), randoms(256, 5)
U = np.uint64
FILTER_BITS = 1 << 29  # 64 MB at most; with more repeated digests the filter is left out


def boundaries(part: Slice) -> np.ndarray:
    """Where chunks begin, text after text; each text's first byte is one."""
    data, n = part.data, len(part.data)
    rolled = GEAR[data]
    for shift in (1, 2, 4, 8):  # doubling: after the last, each value covers WINDOW bytes
        rolled[shift:] = rolled[shift:] + (rolled[:-shift] << np.uint32(shift))
    rolled = (rolled * np.uint32(0x9E3779B1)) >> np.uint32(24)
    blank = BLANK[data]
    char = (data & 0xC0) != 0x80
    cut = np.zeros(n, bool)  # a chunk begins at this byte
    # Chances: a word's start 1 in 4. Inside words a character of three or more bytes, as of scripts without blanks, 1 in 8;
    # any other 1 in 32 where the window holds no blank, else 1 in 256.
    blanks = np.concatenate([[0], np.cumsum(blank)])
    unspaced = blanks[1:n] == blanks[np.maximum(np.arange(1, n) - WINDOW, 0)]
    among = np.where(data[1:] >= 0xE0, 7, np.where(unspaced, 31, 255)).astype(np.uint32)
    cut[1:] = (blank[:-1] & ~blank[1:] & (rolled[:-1] & 3 == 0)) | (char[1:] & ~blank[1:] & ~blank[:-1] & (rolled[:-1] & among == 0))
    found = np.flatnonzero(cut)
    begin = part.offsets[np.searchsorted(part.offsets, found, side="right") - 1]
    found = found[found - begin >= WINDOW]  # the window must lie in one text
    starts = part.offsets[:-1][np.diff(part.offsets) > 0]
    every = np.concatenate([starts, found])
    first = np.concatenate([np.ones(len(starts), bool), np.zeros(len(found), bool)])
    order = np.argsort(every, kind="stable")
    every, first = every[order], first[order]
    every = every[first | (np.diff(every, prepend=-LEAST) >= LEAST)]
    gaps = np.diff(every, append=n)
    if (gaps > MOST).any():  # text without boundaries, such as one letter repeated: cut by length from the last one
        more = [np.arange(a + MOST, a + g, MOST) for a, g in zip(every[gaps > MOST], gaps[gaps > MOST])]
        more = np.concatenate(more)
        while not char[more].all():
            more = np.where(char[more], more, more - 1)
        every = np.union1d(every, more)
    return every


def chunks_of(part: Slice, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of a slice: text index, start in the text, length, and the digest's two halves."""
    starts = boundaries(part)
    ends = np.append(starts[1:], len(part.data))[:len(starts)]
    up, down = powers.upto(len(part.data))
    halves = []
    for values in (FIRST, SECOND):
        total = np.zeros(len(part.data) + 1, U)
        np.cumsum(values[part.data] * up[:len(part.data)], out=total[1:])
        halves.append(mix((total[ends] - total[starts]) * down[starts]).view(np.int64))
    text = np.searchsorted(part.offsets, starts, side="right") - 1
    return text, starts - part.offsets[text], ends - starts, *halves


def slots(hi: np.ndarray, lo: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (hi.view(U) % U(bits)).astype(np.int64), (lo.view(U) % U(bits)).astype(np.int64)


def chunk_rows(texts: DataFrame, keep=None) -> DataFrame:
    """(id, version, seq, start, length, hi, lo) for texts (id, version, text); `keep` is a filter over digests."""
    kind = texts.schema["id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, allowed = Powers(), keep.value if keep else None
        for batch in batches:
            for part in slices(batch.column(2)):
                text, start, length, hi, lo = chunks_of(part, powers)
                seq = np.arange(len(text))  # consecutive within a text
                if allowed is not None:
                    a, b = slots(hi, lo, len(allowed) * 8)
                    ok = np.flatnonzero((allowed[a >> 3] >> (a & 7)) & (allowed[b >> 3] >> (b & 7)) & 1)
                    text, start, length, hi, lo, seq = (x[ok] for x in (text, start, length, hi, lo, seq))
                rows = pa.array(text + part.first)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), *(pa.array(x) for x in (seq, start, length, hi, lo))],
                    ["id", "version", "seq", "start", "length", "hi", "lo"])

    return texts.mapInArrow(run, f"id {kind}, version long, seq long, start long, length long, hi long, lo long")


def digest_filter(digests: DataFrame, count: int):
    """A broadcast bit table of the digests, two bits each; None where it would pass its bound."""
    bits = 1 << max(16, int(count * 10).bit_length())
    if bits > FILTER_BITS:
        return None

    @tidy
    def run(batches):  # each task sets its bits; the driver gets bit positions as one small table for each task
        table = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in slots(*(batch.column(i).to_numpy() for i in (0, 1)), bits):
                np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], ["bits"])

    table = np.zeros(bits // 8, np.uint8)
    few = digests.select("hi", "lo").coalesce(max(1, min(8, count // 200_000)))
    for row in few.mapInArrow(run, "bits binary").toLocalIterator():
        table |= np.frombuffer(row["bits"], np.uint8)
    return digests.sparkSession.sparkContext.broadcast(table)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, Scratch]:
    """Occurrences of repeated chunks: (id, version, seq, start, length, keeper, hi, lo)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "chunking")
    texts = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(
        F.col(key).alias("id"), F.xxhash64(text).alias("version"), F.col(text).cast("string").alias("text"))
    counted = chunk_rows(texts).groupBy("hi", "lo").agg(F.min("id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = scratch.table(counted.drop("n"), "twice")
    found = chunk_rows(texts, digest_filter(twice, twice.count())).join(twice, ["hi", "lo"])
    return found, scratch


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 100, into: str = "spans") -> DataFrame:
    """Cut repeated passages out of whole texts; all columns of `docs` stay, with `text` shortened, and `spans` is added.

    A passage goes if it is a run of chunks that all occurred before (in a document with a smaller key, or earlier in the
    same text), of at least `least` bytes together. `spans` lists what went: byte start and length in the old text, and
    the key of the document that keeps it; empty if nothing went. Null and empty texts and rows with a null key stay as
    they are. Rows that repeat a key and text are one document; different texts of one key are told apart. An input column
    of the name `into` is replaced.
    """
    found, scratch = repeats(docs, key, text)
    hits = found.distinct().groupBy("id", "version").agg(
        F.array_sort(F.collect_list(F.struct("seq", "start", "length", "hi", "lo", "keeper"))).alias("hits"))
    hits = scratch.table(hits, "hits").select(F.col("id").alias("_id"), F.col("version").alias("_version"), F.col("hits").alias("_hits"))
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(key).alias("k"), F.xxhash64(text).alias("v"))
    joined = rows.join(hits, (F.col("k") == F.col("_id")) & (F.col("v") == F.col("_version")), "left").select(
        "_id", "_hits", *[F.col(f"row.`{c}`").alias(c) for c in kept])
    kind = docs.schema[key].dataType.simpleString()

    @tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, own = batch.column(1), batch.columns[2:]
            texts, spans = own[kept.index(text)].to_pylist() if column.null_count < len(column) else None, [[]] * len(batch)
            for i in np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False)):
                raw = texts[i].encode()
                spans[i] = long_runs(batch.column(0)[i].as_py(), column[i].as_py(), least)
                parts, last = [], 0
                for s in spans[i]:
                    parts.append(raw[last:s["start"]])
                    last = s["start"] + s["length"]
                texts[i] = b"".join([*parts, raw[last:]]).decode()
            if texts is not None:
                own[kept.index(text)] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*own, pa.array(spans, span_type(batch.schema.field(0).type))], [*kept, into])

    schema = docs.select(*kept).schema.simpleString()[len("struct<"):-1]
    return joined.mapInArrow(cut, f"{schema},{into}:array<struct<start:bigint,length:bigint,keeper:{kind}>>")


def span_type(kind: pa.DataType) -> pa.DataType:
    return pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("keeper", kind)]))


def long_runs(key, hits: list[dict], least: int) -> list[dict]:
    """Runs of repeated chunks of at least `least` bytes; in the keeper's own text, a digest's first chunk is no repeat."""
    seen, runs, last = set(), [], None
    for h in hits:
        digest = (h["hi"], h["lo"])
        if h["keeper"] == key and digest not in seen:
            seen.add(digest)
            last = None
            continue
        if last is not None and h["start"] == last["start"] + last["length"]:
            last["length"] += h["length"]
        else:
            last = {"start": h["start"], "length": h["length"], "keeper": h["keeper"]}
            runs.append(last)
    return [r for r in runs if r["length"] >= least]

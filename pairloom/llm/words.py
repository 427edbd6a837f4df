"""Words and shingles of whole texts, hashed in numpy.

A word is a maximal run of bytes other than the six ASCII blanks, with A-Z in lower case. Its hash is a polynomial over
random byte values modulo 2**64, computed for all words of a slice at once from prefix sums, and mixed at the end.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SLICE = 512 << 10  # bytes handled at once, some 20 MB of arrays; a longer text makes a slice of its own


def release() -> None:
    """Give freed memory back to the system, as far as the allocators can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that releases its memory at the end: Python workers live on, and what they keep counts with their executor."""
    @wraps(run)
    def run_tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return run_tidy


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0x51ED2701))


BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
VALUES = randoms(256, 1)
BASE = 0x9E3779B97F4A7C15
STEP = randoms(8, 2) | U(1)


class Powers:
    """Powers of BASE and of its inverse, as many as the longest slice needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            base = np.full(n, BASE, U)
            back = np.full(n, pow(BASE, -1, 1 << 64), U)
            base[0] = back[0] = 1
            self.up, self.down = np.cumprod(base), np.cumprod(back)
        return self.up, self.down


class Slice(NamedTuple):
    """Some consecutive texts: rows first..first+count of the batch, their bytes, and where each begins (count + 1 offsets)."""

    first: int
    count: int
    data: np.ndarray
    offsets: np.ndarray


def slices(column: pa.Array, size: int = SLICE) -> Iterator[Slice]:
    """Cut a text column into slices of about `size` bytes. Null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Slice(first, last - first, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first])
        first = last


class Words(NamedTuple):
    """Words of a slice: byte ranges, hashes, and the index of each text's first word (count + 1 entries)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    begin: np.ndarray


def words_of(part: Slice, powers: Powers) -> Words:
    n = len(part.data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(0, U), np.zeros(part.count + 1, np.int64))
    solid = ~BLANK[part.data]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[part.offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    np.logical_not(solid[:-1], out=before[1:])
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    np.logical_not(solid[1:], out=after[:-1])
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    up, down = powers.upto(n)
    total = np.zeros(n + 1, U)
    np.cumsum(VALUES[LOWER[part.data]] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    return Words(starts, ends, hashes, np.searchsorted(starts, part.offsets))


def shingles_of(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words, text after text, and where each text's begin. A shorter text has one, of all its words."""
    counts = np.diff(words.begin)
    many = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(many)])
    out = np.zeros(begin[-1], U)
    h = words.hashes
    if len(h) >= width:
        sums = np.zeros(len(h) - width + 1, U)
        for j in range(width):
            sums += h[j:len(h) - width + 1 + j] * STEP[j]
        inside = np.zeros(len(h), bool)
        long = np.flatnonzero(counts >= width)
        flips = np.zeros(len(h) + 1, np.int64)
        np.add.at(flips, words.begin[long], 1)
        np.add.at(flips, words.begin[long + 1] - width + 1, -1)
        inside = np.cumsum(flips[:-1]) > 0
        target = np.ones(len(out), bool)
        target[begin[:-1][(counts > 0) & (counts < width)]] = False
        out[target] = sums[np.flatnonzero(inside)]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        run = h[words.begin[i]:words.begin[i + 1]]
        out[begin[i]] = (run * STEP[:len(run)]).sum(dtype=U) + U(len(run))
    return mix(out), begin

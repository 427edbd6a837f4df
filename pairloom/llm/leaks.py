"""Benchmark decontamination by latent semantic retrieval.

Fit: document frequencies of hashed words over the whole corpus; then a randomised SVD of TF-IDF passages by subspace
iteration. The passages are those of all documents and all benchmark items, which weigh more so that the space covers what is
searched for, in the same proportion to all documents however many they are (`EVEN`). Every round multiplies by every passage,
from a table of all texts' terms, which is written once. Products with the passages run in tasks; the driver holds TERMS x rank numbers.

Search: every text of the corpus, whole, is cut into blocks of words; windows of a few blocks that a benchmark item is near
to by cosine are candidates. Products with items are additive over blocks, so all windows come from one product for each block.
An item's least cosine follows the share of its norm that the space captures; what it finds must also be near by whole TF-IDF
rows, from lists of terms. Items of which it captures too little, as happens when they are many, are searched by these rows
alone, so no item depends on the space's fixed rank.

Confirmation: the longest common subsequence of the item's words and the words around the candidate. Enough of the item, or
less of it together with its answer (its last sentence, where no answer column is named), is a leak.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.scratch import Scratch, release
from pairloom.llm.words import Powers, Slice, slices, tidy, words_of

TERMS, RANK, EXTRA = 1 << 16, 96, 16
SHARE = 512  # rows of a tall array that one group adds up
SLAB = 4096  # rows of a tall array in double precision at once
EVEN, PASSAGE = 2000, 64  # documents that all of them weigh as, if they are more; words of a passage
TASK = 50_000  # texts whose products a task adds up
MANY, OFTEN, ROWS = 512, 512, 16  # passages whose first, most frequent terms are multiplied at once; passages whose other terms are
MOST_ITEMS = 100_000  # bound of what is broadcast; more raise
BLOCK, WINDOWS = 16, (2, 4)  # words of a block; blocks of a window
NEAR = 0.42  # cosine of a candidate, as a share of an exact copy's; a leak has PART of the item at least
CAUGHT = 0.5  # share of an item's norm in the space; items with less are searched by their own terms
COMMON = 0.1  # share of an item's squared norm, in its most common terms, that its lists leave out
GROUP, LISTED = 1024, 1 << 19  # items compared at once; entries of their lists read at once
WHOLE, PART, ANSWER = 0.7, 0.5, 0.8  # shares of an item, of an item with its answer, and of the answer
WEIGHT = 3.0  # of an item beside a passage of EVEN documents
SMALL, TAKEN = 128 << 10, 1024  # bytes of text searched at once, and words whose rows are added up at once: they fit a core's cache


def text_words(texts: list[str]) -> list[np.ndarray]:
    """Word hashes of a few texts."""
    powers, out = Powers(), []
    for part in slices(pa.array(texts, pa.string())):
        words = words_of(part, powers)
        out += [words.hashes[words.begin[i]:words.begin[i + 1]] for i in range(part.count)]
    return out


def terms_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % TERMS


@dataclass(frozen=True)
class Item:
    key: object
    words: np.ndarray
    answer: np.ndarray


@dataclass(frozen=True)
class Group:
    """Items compared at once, all or none by the space: their vectors, and their terms, of which term t has entries begin[t] to begin[t + 1]."""

    items: np.ndarray
    begin: np.ndarray
    item: np.ndarray  # place in `items`
    weight: np.ndarray  # scaled so that a product of the window's norm or more is a candidate
    images: np.ndarray  # vectors in the space, scaled in the same way; no rows if it misses the items


@dataclass(frozen=True)
class Space:
    items: list[Item]
    weights: np.ndarray  # inverse document frequencies of the terms, and 0 for no term
    basis: np.ndarray  # a row of rank numbers for each term, already weighted, and zeros
    groups: list[Group]


def read_items(benchmark: DataFrame, key: str, text: str, answer: str | None) -> list[Item]:
    """The benchmark's items with at least one word; rows without a key are left out, repeated ones count once."""
    columns = [F.col(key).alias("key"), F.col(text).cast("string").alias("text"), (F.col(answer) if answer else F.lit(None)).cast("string").alias("answer")]
    rows = benchmark.select(*columns).where("key is not null and text is not null").distinct().limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} benchmark items")
    rows = sorted(rows, key=lambda r: (r["key"], r["text"], r["answer"] or ""))
    last = [r["answer"] if r["answer"] is not None else re.split(r"(?<=[.!?])\s+", r["text"].strip())[-1] for r in rows]
    found = zip(rows, text_words([r["text"] for r in rows]), text_words(last))
    return [Item(r["key"], words, own) for r, words, own in found if len(words)]


def term_table(texts: DataFrame) -> DataFrame:
    """The terms of each text's words, in order, as two bytes each; null texts have none."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            parts = []
            for part in slices(batch.column(0), SMALL):
                words = words_of(part, powers)
                ends, terms = (2 * words.begin).astype(np.int32), terms_of(words.hashes).astype("<u2")
                parts.append(pa.Array.from_buffers(pa.binary(), part.count, [None, pa.py_buffer(ends), pa.py_buffer(terms)]))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(parts)], ["terms"])

    return texts.mapInArrow(run, "terms binary")


def read_terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Terms of the texts of a batch of `term_table`, and where each text's begin."""
    column = batch.column(0).cast(pa.large_binary())
    begin = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] // 2
    return np.frombuffer(column.buffers()[2] or b"", "<u2"), begin


def term_counts(terms: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) by row and term, for fewer than 65,536 rows of so many terms each."""
    keys = np.sort(np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes) * np.uint32(TERMS) + terms.astype(np.uint32))
    new = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    first = np.flatnonzero(new)
    keys = keys[first].astype(np.intp)
    return keys // TERMS, keys % TERMS, np.diff(np.append(first, len(new)))


def document_frequencies(terms: DataFrame) -> np.ndarray:
    """How many texts have each term, over all rows of `term_table`."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TERMS, np.int64)
        for batch in batches:
            found, begin = read_terms(batch)
            for first in range(0, len(begin) - 1, MANY):
                own = begin[first:first + MANY + 1]
                total += np.bincount(term_counts(found[own[0]:own[-1]], np.diff(own))[1], minlength=TERMS)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["term", "n"])

    found = np.zeros(TERMS, np.int64)
    for row in terms.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # TERMS rows at most
        found[row["term"]] = row["n"]
    return found


def add_products(terms: np.ndarray, begin: np.ndarray, weights: np.ndarray, x: np.ndarray, out: np.ndarray, scale: float = 1.0) -> None:
    """Add A'(A x) to `out` for the unit TF-IDF rows A of passages, of which row i has the terms begin[i] to begin[i + 1].

    Any order of terms gives the same sums; it is fast if the first OFTEN terms are the most frequent ones.
    """
    place = np.zeros(TERMS, np.intp)
    for first in range(0, len(begin) - 1, MANY):
        own = begin[first:first + MANY + 1]
        many = len(own) - 1
        row, term, tf = term_counts(terms[own[0]:own[-1]], np.diff(own))
        value = np.sqrt(tf, dtype=np.float32) * weights[term]
        value *= (scale / np.maximum(np.sqrt(np.bincount(row, value * value, many)), 1e-30)).astype(np.float32)[row]
        often = term < OFTEN
        dense = np.zeros((many, OFTEN), np.float32)
        dense[row[often], term[often]] = value[often]
        ax = dense @ x[:OFTEN]
        row, term, value = row[~often], term[~often], value[~often]
        cut = np.searchsorted(row, np.arange(0, many + ROWS, ROWS)).tolist()
        for i, (a, b) in enumerate(zip(cut, cut[1:])):
            ids, count = term[a:b], np.arange(b - a)
            place[ids] = count
            ids = ids[place[ids] == count]  # each term once
            place[ids] = count[:len(ids)]
            part = ax[i * ROWS:(i + 1) * ROWS]
            rest = np.zeros((len(part), len(ids)), np.float32)
            rest[row[a:b] - i * ROWS, place[term[a:b]]] = value[a:b]
            part += rest @ x.take(ids, axis=0)
            sums = out.take(ids, axis=0)
            sums += rest.T @ part
            out[ids] = sums
        out[:OFTEN] += dense.T @ ax


def back_and_forth(words: list[np.ndarray], weights: np.ndarray, x: np.ndarray, scale: float = 1.0, rank: np.ndarray | None = None) -> np.ndarray:
    """A'(A x) for the unit TF-IDF rows A of passages, given as word hashes; `rank`: the row of each term, if not its own number."""
    out = np.zeros_like(x)
    if words:
        terms = terms_of(np.concatenate(words))
        add_products(terms if rank is None else rank[terms], np.cumsum([0, *map(len, words)]), weights, x, out, scale)
    return out


def gram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x'y in double precision, a slab of rows at a time."""
    return sum((x[a:a + SLAB].astype(float).T @ y[a:a + SLAB].astype(float) for a in range(0, len(x), SLAB)), np.zeros((x.shape[1], y.shape[1])))


def turn(x: np.ndarray, by: np.ndarray) -> None:
    """Replace x by x times a small matrix, in place, a slab of rows at a time."""
    for a in range(0, len(x), SLAB):
        x[a:a + SLAB, :by.shape[1]] = x[a:a + SLAB].astype(float) @ by


def orthonormalise(x: np.ndarray) -> None:
    """Make the columns of a tall matrix orthonormal in place, by its small Gram matrix alone; the second time mends what rounding left."""
    for _ in range(2):
        values, vectors = np.linalg.eigh(gram(x, x))
        turn(x, vectors / np.sqrt(np.maximum(values, max(values[-1] * 1e-10, 1e-30))))


def products(terms: DataFrame, rank: np.ndarray, weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A'(A x) over the passages of whole texts, given as `term_table`, added up in tasks, a share of the rows each; term t is row rank[t] of all arrays."""
    shared = terms.sparkSession.sparkContext.broadcast((rank, weights, x))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, weights, x = shared.value
        out = np.zeros_like(x)
        for batch in batches:
            found, begin = read_terms(batch)
            many = -(-np.diff(begin) // PASSAGE)
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            add_products(rank[found], np.append(np.repeat(begin[:-1], many) + PASSAGE * place, begin[-1]), weights, x, out)
        for a in range(0, len(out), SHARE):
            yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([out[a:a + SHARE].astype("<f4").tobytes()], pa.binary())], ["first", "sums"])

    def add(part: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), "<f4").astype(float) for x in part.column("sums"))
        return pa.table({"first": part.column("first").slice(0, 1), "sums": pa.array([total.astype("<f4").tobytes()], pa.binary())})

    total = np.zeros_like(x)
    parts = terms.mapInArrow(run, "first long, sums binary").groupBy("first").applyInArrow(add, "first long, sums binary")
    for row in parts.toLocalIterator():  # a few rows of the array at a time
        own = np.frombuffer(row["sums"], "<f4").reshape(-1, x.shape[1])
        total[row["first"]:row["first"] + len(own)] = own
    shared.destroy()
    del parts
    release(terms.sparkSession)  # the next round's shuffle is as large as this one's: a tall array for each task
    return total


def fit(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
        answer: str | None = None, rounds: int = 2, near: float = NEAR) -> Space:
    """The latent space of a corpus and a benchmark. Null texts are empty; an empty benchmark gives a space that finds nothing."""
    items = read_items(benchmark, item_key, item_text, answer)
    scratch = Scratch(docs.sparkSession, "leaks")
    every = scratch.table(term_table(docs.select(F.col(text).cast("string").alias("text"))), "terms")
    n = every.count()
    every = every.coalesce(max(4, n // TASK))
    df = document_frequencies(every)
    weights = np.log((n + 1) / (df + 0.5)).clip(0.01).astype(np.float32)
    own = [i.words for i in items]
    order = np.argsort(weights, kind="stable")  # rows of the tall arrays: frequent terms come first
    rank, ranked = np.argsort(order).astype(np.uint16), weights[order]
    x = np.random.default_rng(0).standard_normal((TERMS, RANK + EXTRA), np.float32)[order]
    for i in range(max(rounds, 1)):  # two tall arrays at a time
        if i:
            x = y
        orthonormalise(x)
        y = products(every, rank, ranked, x)
        y *= min(1.0, EVEN / max(n, 1))
        y += back_and_forth(own, ranked, x, WEIGHT, rank)
    scratch.drop("terms")
    _, vectors = np.linalg.eigh(gram(x, y))
    x = y
    turn(x, vectors[:, ::-1][:, :RANK])
    x = x[:, :RANK]
    del y
    orthonormalise(x)
    basis = np.zeros((TERMS + 1, RANK), np.float32)  # the last row is that of no term
    x *= ranked[:, None]
    basis[order] = x
    del x
    images = np.array([basis[terms_of(w)].sum(axis=0) for w in own], np.float32).reshape(len(own), RANK)
    length = np.linalg.norm(images, axis=1)
    share = np.minimum(1, length / np.maximum([full_norm(w, weights) for w in own], 1e-9))
    caught, rest = np.flatnonzero(share >= CAUGHT), np.flatnonzero(share < CAUGHT)
    images = (images / np.maximum(length * least_cosines(own, share, near), 1e-9)[:, None]).astype(np.float32)
    groups = term_lists(own, caught, weights, near, images[caught]) + term_lists(own, rest, weights, near, images[:0])
    return Space(items, np.append(weights, np.float32(0)), basis, groups)


def full_norm(words: np.ndarray, weights: np.ndarray) -> float:
    terms, tf = np.unique(terms_of(words), return_counts=True)
    return float(np.linalg.norm(tf * weights[terms]))


def least_cosines(own: list[np.ndarray], caught: np.ndarray, near: float) -> np.ndarray:
    """Cosine from which a window is an item's candidate: a share of what an exact copy in one window would have."""
    words, window = np.array([len(w) for w in own], float).reshape(-1), BLOCK * max(WINDOWS)
    return near * caught * np.sqrt(np.minimum(words, window) / np.maximum(words, window))


def term_lists(own: list[np.ndarray], which: np.ndarray, weights: np.ndarray, near: float, images: np.ndarray) -> list[Group]:
    """Lists for the items `which`, in groups of bounded size, with the vectors of those that have one."""
    out = []
    for a in range(0, len(which), GROUP):
        group, terms, items, values = which[a:a + GROUP], [], [], []
        for place, i in enumerate(group.tolist()):
            ids, tf = np.unique(terms_of(own[i]), return_counts=True)
            square = (tf * weights[ids].astype(float)) ** 2
            order = np.argsort(weights[ids], kind="stable")
            left = np.cumsum(square[order])
            kept = order[left > COMMON * left[-1]]
            norm = np.sqrt(square[kept].sum())
            scale = norm * least_cosines([own[i]], np.sqrt(square[kept].sum() / left[-1]), near)[0]
            terms.append(ids[kept])
            items.append(np.full(len(kept), place, np.int32))
            values.append((tf * weights[ids].astype(float) ** 2)[kept] / scale)
        terms, order = np.concatenate(terms), np.argsort(np.concatenate(terms), kind="stable")
        begin = np.searchsorted(terms[order], np.arange(TERMS + 2))
        out.append(Group(group, begin, np.concatenate(items)[order], np.concatenate(values)[order].astype(np.float32), images[a:a + GROUP]))
    return out


def listed_dots(lists: Group, padded: np.ndarray) -> np.ndarray:
    """Products of blocks of terms with a group's items, from the lists of the terms."""
    many, blocks = len(lists.items), len(padded) // BLOCK
    out = np.zeros((blocks, many), np.float32)
    size = lists.begin[padded + 1] - lists.begin[padded]
    total = np.concatenate([[0], np.cumsum(size.reshape(-1, BLOCK).sum(axis=1))])
    low = 0
    while low < blocks:
        high = max(low + 1, int(np.searchsorted(total, total[low] + LISTED, side="right")) - 1)
        own, first = size[low * BLOCK:high * BLOCK], lists.begin[padded[low * BLOCK:high * BLOCK]]
        at = np.arange(own.sum()) + np.repeat(first - np.cumsum(own) + own, own)
        cell = np.repeat(np.arange(len(own)) // BLOCK, own) * many + lists.item[at]
        out[low:high] = np.bincount(cell, lists.weight[at], (high - low) * many).reshape(-1, many)
        low = high
    return out


def common(item: np.ndarray, text: list[int]) -> int:
    """Length of the longest common subsequence, by bit vectors."""
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    whole = (1 << len(item)) - 1
    row = whole
    for w in text:
        hit = row & masks.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & whole
    return len(item) - row.bit_count()


def candidates(space: Space, terms: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, item, blocks of the window) of the windows that are near to an item, for texts of terms from begin to begin."""
    counts = np.diff(begin)
    blocks = -(-counts // BLOCK)
    text = np.repeat(np.arange(len(counts)), blocks)
    if not len(text):
        return (np.zeros(0, np.int64),) * 3
    first = np.concatenate([[0], np.cumsum(blocks)])[:-1]
    # Blocks of equal size: the last of a text is filled up with a term that weighs nothing.
    place = np.repeat(first * BLOCK - begin[:-1], counts) + np.arange(begin[0], begin[-1])
    padded = np.full(len(text) * BLOCK, TERMS)
    padded[place] = terms
    norms = (space.weights[padded] ** 2).reshape(-1, BLOCK).sum(axis=1)
    sums = block_sums(space.basis, padded) if any(len(g.images) for g in space.groups) else None
    found = []
    for group in space.groups:
        if len(group.images):  # the lists have only to confirm what the space finds
            near = near_windows(sums @ group.images.T, norms, text)
            block, item, size = (x[listed_near(group, padded, norms, text, *near)] for x in near)
        else:
            block, item, size = near_windows(listed_dots(group, padded), norms, text)
        found.append((block, group.items[item], size))
    return tuple(np.concatenate(x) for x in zip(*found))


def block_sums(basis: np.ndarray, padded: np.ndarray) -> np.ndarray:
    """Sums of the rows of `basis` over blocks of terms."""
    out, step = np.empty((len(padded) // BLOCK, basis.shape[1]), basis.dtype), TAKEN // BLOCK
    for i in range(0, len(out), step):
        rows = basis.take(padded[i * BLOCK:(i + step) * BLOCK], axis=0)
        np.add.reduce(rows.reshape(-1, BLOCK, basis.shape[1]), axis=1, out=out[i:i + step])
    return out


def listed_near(group: Group, padded: np.ndarray, norms: np.ndarray, text: np.ndarray, block: np.ndarray, item: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether windows of `size` blocks from `block` are near to the group's `item` by the lists too, which are read for these windows' blocks only."""
    last = np.searchsorted(text, text[block], side="right")  # behind the text's last block
    steps = [(block + j, np.flatnonzero((j < size) & (block + j < last))) for j in range(max(WINDOWS))]
    wanted = np.zeros(len(text), bool)
    for at, held in steps:
        wanted[at[held]] = True
    dots, place = listed_dots(group, padded.reshape(-1, BLOCK)[wanted].reshape(-1)), np.cumsum(wanted) - 1
    total, square = np.zeros(len(block), np.float32), np.zeros(len(block), np.float32)
    for at, held in steps:
        total[held] += dots[place[at[held]], item[held]]
        square[held] += norms[at[held]]
    return total >= np.sqrt(square)


def near_windows(dots: np.ndarray, norms: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, item, blocks of the window) of the windows that are near to an item by the products of blocks with items."""
    found, total, square = [], dots.copy(), norms.copy()
    for j in range(1, max(WINDOWS) + 1):
        if j in WINDOWS:
            least = np.sqrt(square)
            rows = np.flatnonzero(total.max(axis=1) >= least)
            at, item = np.nonzero(total[rows] >= least[rows, None])
            found.append((rows[at], item, np.full(len(at), j)))
        if j < max(WINDOWS):
            same = (text[j:] == text[:-j]).astype(np.float32)
            total[:-j] += same[:, None] * dots[j:]
            square[:-j] += same * norms[j:]
    return tuple(np.concatenate(x) for x in zip(*found))


def confirm(space: Space, item: Item, words: np.ndarray) -> tuple[float, float] | None:
    """Shares of the item and of its answer in these words, if they make a leak."""
    text = words.tolist()
    whole = common(item.words, text) / len(item.words)
    if whole < PART:
        return None
    own = common(item.answer, text) / len(item.answer) if len(item.answer) else 0.0
    return (whole, own) if whole >= WHOLE or own >= ANSWER else None


def search(docs: DataFrame, space: Space, text: str = "text", into: str = "leaks") -> DataFrame:
    """`docs` with `leaks`, an array of (item, share, answer, word): the items found in each whole text, by key.

    `share` is the part of the item's words that the text has in order around word `word`, `answer` that of the answer. Empty
    for null and empty texts, and for texts without a leak. Rows are judged one by one; an input column of the name `into` is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    at = kept.index(text)
    plain = [(i.key, i.words, i.answer) for i in space.items], space.weights, space.basis, [(g.items, g.begin, g.item, g.weight, g.images) for g in space.groups]
    shared = docs.sparkSession.sparkContext.broadcast(plain)  # plain values: workers need not import this module
    keys = pa.array([i.key for i in space.items])
    kind = keys.type if len(space.items) else pa.int64()
    row = pa.list_(pa.struct([("item", kind), ("share", pa.float64()), ("answer", pa.float64()), ("word", pa.int64())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, *rest, groups = shared.value
        space, powers = Space([Item(*i) for i in items], *rest, [Group(*g) for g in groups]), Powers()
        for batch in batches:
            leaks: list[list] = [[] for _ in range(len(batch))]
            for part in slices(batch.column(at), SMALL) if space.items else ():
                words = words_of(part, powers)
                for i, hit in text_leaks(space, part, words):
                    leaks[part.first + i].append(hit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaks, row)], [*batch.schema.names, into])

    from pyspark.sql.pandas.types import from_arrow_type
    schema = docs.select(*kept).schema.simpleString()[len("struct<"):-1]
    return docs.select(*kept).mapInArrow(run, f"{schema},{into}:array<struct<item:{from_arrow_type(kind).simpleString()},share:double,answer:double,word:bigint>>")


def text_leaks(space: Space, part: Slice, words) -> Iterator[tuple[int, dict]]:
    """(text, leak) of a slice; neighbouring candidate windows of one item are confirmed together."""
    terms = terms_of(words.hashes)
    block, item, size = candidates(space, terms, words.begin)
    if not len(block):
        return
    blocks = -(-np.diff(words.begin) // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    text = np.searchsorted(first, block, side="right") - 1
    order = np.lexsort((block, item, text))
    best: dict[tuple[int, int], tuple] = {}
    run: list[int] = []

    def close():
        t, which = int(text[run[0]]), int(item[run[0]])
        own = space.items[which]
        low = int(words.begin[t] + (block[run[0]] - first[t]) * BLOCK)
        high = int(words.begin[t] + (max(block[r] + size[r] for r in run) - first[t]) * BLOCK)
        low, high = max(low - len(own.words), int(words.begin[t])), min(high + len(own.words), int(words.begin[t + 1]))
        found = confirm(space, own, words.hashes[low:high])
        if found and (t, which) not in best:
            best[t, which] = (*found, low - int(words.begin[t]))

    for r in order.tolist():
        if run and (text[r] != text[run[0]] or item[r] != item[run[0]] or block[r] > block[run[-1]] + max(WINDOWS)):
            close()
            run = []
        run.append(r)
    close()
    for (t, which), (share, answer, word) in best.items():
        yield t, {"item": space.items[which].key, "share": share, "answer": answer, "word": word}

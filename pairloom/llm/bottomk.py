"""Near-duplicate documents by bottom-k sketches of their word shingles.

One hash function; a document's sketch is its k smallest shingle hashes. Steps:

1. Documents with the same shingle set form a class; its smallest id represents it. The rest works on representatives.
2. Inverted lists over the rarest values of each sketch. Two sketches that share enough values for the estimate below must
   share one of the first `k - needed + 1` in any common order; rare first keeps passages that many documents share out.
3. A list proposes its most central member, the one with the most common values, against all others, never all pairs. The
   sketch of the union estimates the similarity of a proposal; exact Jaccard on the full sets of the whole texts confirms it.
4. In lists of up to SHORT members, all that are still apart are proposed to each other. Longer lists whose members are
   still apart form clusters; within a cluster, full sets are compared block against block inside tasks, which return only
   links that join components. So no link between different texts is lost, except where the estimate of a proposal misses
   by over five standard deviations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.components import components
from pairloom.llm.scratch import Scratch, cut_lineage, release
from pairloom.llm.words import Powers, shingles_of, slices, tidy, words_of
from pairloom.session import small_side

K = 64
SLACK = 0.25  # proposals whose estimate is that far below the threshold are dropped: five deviations of 64 values
RARE = 32  # values in more sketches than this come last in the order
SHORT = 64  # members of a list whose pairs are all proposed
BLOCK = 512  # documents of a cluster in one block
COLUMNS = 4096  # values compared at once


def sets_of(batches: Iterator[pa.RecordBatch], width: int):
    """(batch, row, sorted distinct shingle hashes) for every text."""
    powers = Powers()
    for batch in batches:
        for part in slices(batch.column(batch.num_columns - 1)):
            hashes, begin = shingles_of(words_of(part, powers), width)
            yield batch, part, [np.unique(hashes[begin[i]:begin[i + 1]]) for i in range(part.count)]


def longs(lists: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    flat = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, k: int = K) -> DataFrame:
    """(id, n, hi, lo, sketch): set size, 128-bit digest of the set, and its k smallest hashes."""
    @tidy
    def run(batches):
        for batch, part, sets in sets_of(batches, width):
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(part.first, part.count), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array(halves[:, 0]), pa.array(halves[:, 1]), longs([s[:k] for s in sets])], ["id", "n", "hi", "lo", "sketch"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, n long, hi long, lo long, sketch array<long>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, values) with all shingle hashes, for docs (id, text)."""
    @tidy
    def run(batches):
        for batch, part, sets in sets_of(batches, width):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, part.count), longs(sets)], ["id", "values"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, values array<long>")


def union_estimate(a: list[np.ndarray], b: list[np.ndarray], k: int) -> np.ndarray:
    """Share of the union's k smallest values that both sketches hold, for many pairs at once."""
    top = np.iinfo(np.int64).max
    table = np.full((len(a), 2 * k), top, np.int64)
    for i, (x, y) in enumerate(zip(a, b)):
        table[i, :len(x)] = x
        table[i, k:k + len(y)] = y
    table.sort(axis=1)
    twice = np.zeros(table.shape, bool)
    twice[:, 1:] = (table[:, 1:] == table[:, :-1]) & (table[:, 1:] != top)
    real = (table != top) & ~twice
    place = np.cumsum(real, axis=1)
    size = np.minimum(place[:, -1], k)
    return (twice & (place <= k)).sum(axis=1) / np.maximum(size, 1)


def near(n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


class Linker:
    """Candidate search and confirmation for one document table."""

    def __init__(self, docs: DataFrame, key: str, text: str, percent: int, width: int, k: int):
        self.docs = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
        self.percent, self.width, self.k, self.floor = percent, width, k, percent / 100 - SLACK
        self.scratch = Scratch(docs.sparkSession, "bottomk")
        self.sketches = self.scratch.table(sketches(docs, key, text, width, k), "sketches")
        found = self.sketches.where("n > 0 and id is not null").groupBy("n", "hi", "lo").agg(
            F.min("id").alias("id"), F.first("sketch").alias("sketch"))
        self.classes = self.scratch.table(found, "classes")

    def lists(self) -> DataFrame:
        """Members of the inverted lists that have at least two: (value, id, n, m, hub)."""
        values = self.classes.select("id", F.explode("sketch").alias("value"))
        common = small_side(values.groupBy("value").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > RARE))
        ranks = values.join(common, "value").groupBy("id").agg(F.collect_list(F.struct("c", "value")).alias("common"))
        none = F.array().cast("array<struct<c:bigint,value:bigint>>")
        whole = self.classes.join(ranks, "id", "left").withColumn("common", F.coalesce("common", none))
        rare = F.transform(F.array_except("sketch", F.col("common.value")), lambda v: F.struct(F.lit(0).cast("long").alias("c"), v.alias("value")))
        order = F.array_sort(F.concat(rare, "common"))
        size = F.size("sketch")
        first = F.slice(order, F.lit(1), size - F.ceil(size * self.floor).cast("int") + 1)
        central = F.aggregate("common", F.lit(0.0), lambda s, x: s + F.log2(x["c"].cast("double")))
        lists = self.scratch.table(whole.select("id", central.alias("central"), F.explode(first["value"]).alias("value")), "lists")
        counts = lists.groupBy("value").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("value")
        members = self.scratch.table(lists.join(counts, "value"), "members")
        self.scratch.drop("lists")
        return members

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Of proposals (a, b), those whose estimate is high enough: (a, b, est)."""
        k = self.k
        high = F.transform("sketch", lambda v: F.shiftrightunsigned(v, 33).cast("int"))  # the order stays, half the size
        side = lambda end: self.classes.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), high.alias(f"s_{end}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b").where(near(F.col("n_a"), F.col("n_b"), self.percent))

        @tidy
        def run(batches):
            for batch in batches:
                for i in range(0, len(batch), 2048):
                    cut = batch.slice(i, 2048)
                    flat = [[x.values.to_numpy() for x in cut.column(c)] for c in (2, 3)]
                    yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), pa.array(union_estimate(*flat, k))], ["a", "b", "est"])

        kind = self.classes.schema["id"].dataType.simpleString()
        rated = both.select("a", "b", "s_a", "s_b").mapInArrow(run, f"a {kind}, b {kind}, est double")
        return cut_lineage(rated.where(F.col("est") >= self.floor).groupBy("a", "b").agg(F.max("est").alias("est")))

    def sets(self, ids: DataFrame, name: str) -> DataFrame:
        """Full shingle sets of the documents `ids`, from their whole texts."""
        wanted = self.docs.join(small_side(ids.distinct(), 1_000_000), "id", "left_semi")
        return self.scratch.table(full_sets(wanted, self.width).where(F.size("values") > 0), name)

    def confirmed(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs whose full sets are similar enough."""
        side = lambda end: sets.select(F.col("id").alias(end), F.col("values").alias(f"v_{end}"))
        both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
        both = both.withColumn("i", F.size(F.array_intersect("v_a", "v_b")))
        union = F.size("v_a") + F.size("v_b") - F.col("i")
        return cut_lineage(both.where(100 * F.col("i") >= self.percent * union).select("a", "b"))

    def apart(self, rows: DataFrame, groups: DataFrame, *ends: str) -> DataFrame:
        """`rows` with the component of each end as c_<end>."""
        for end in ends:
            named = groups.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
            rows = rows.join(named, end, "left").withColumn(f"c_{end}", F.coalesce(f"c_{end}", end))
        return rows

    def blocks(self, docs: DataFrame) -> DataFrame:
        """Links (a, b) that join components, for docs (cluster, id, component): all pairs of a cluster, within tasks."""
        sizes = docs.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
        placed = docs.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
        sets = self.sets(docs.select("id"), "clustered")
        placed = placed.join(sets, "id")
        every = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
        low, high = F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
        rows = placed.select("cluster", "block", every, "id", "component", "values").select("cluster", low, high, "block", "id", "component", "values")
        kind, percent = docs.schema["id"].dataType.simpleString(), self.percent

        def compare(group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            block = group["block"].to_numpy()
            left = np.flatnonzero(block == group["i"][0].as_py())
            right = np.flatnonzero(block == group["j"][0].as_py())
            values = [group["values"][i].values.to_numpy() for i in range(len(block))]
            shared = overlaps([values[i] for i in left], [values[i] for i in right])
            size = np.array([len(v) for v in values])
            near = 100 * shared >= percent * (size[left][:, None] + size[right][None, :] - shared)
            names, parent, a, b = group["component"].to_pylist(), {}, [], []

            def top(x):
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            for x, y in zip(*np.nonzero(near)):
                p, q = top(names[left[x]]), top(names[right[y]])
                if p != q:  # one link joins two components; more say nothing new
                    parent[q] = p
                    a.append(int(left[x]))
                    b.append(int(right[y]))
            ids = group["id"].combine_chunks() if isinstance(group["id"], pa.ChunkedArray) else group["id"]
            return pa.table([ids.take(pa.array(a, pa.int64())), ids.take(pa.array(b, pa.int64()))], names=["a", "b"])

        return rows.groupBy("cluster", "i", "j").applyInArrow(compare, f"a {kind}, b {kind}")

    def free(self, name: str) -> None:
        """Remove the table `name`, and the files of shuffles that went before."""
        self.scratch.drop(name)
        release(self.scratch.spark)

    def links(self) -> DataFrame:
        """Components of the representatives: (node, component)."""
        members = self.lists()
        hubs = members.groupBy("value").agg(F.max(F.struct("central", "id")).alias("hub")).select("value", F.col("hub.id").alias("hub"))
        members = members.join(hubs, "value").select("value", "hub", "id")
        proposed = members.where("id <> hub").select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
        proposed = self.likely(proposed)
        links = self.confirmed(proposed, self.sets(proposed.select(F.explode(F.array("a", "b")).alias("id")), "proposed"))
        groups = components(links)
        self.free("proposed")
        # Short lists: every pair that is still apart.
        sizes = members.groupBy("value").agg(F.count(F.lit(1)).alias("m"))
        members = self.scratch.table(members.join(sizes, "value"), "sized")
        self.scratch.drop("members")
        left = self.apart(members.where((F.col("id") != F.col("hub")) & (F.col("m") <= SHORT)).select("value", "id"), groups, "id")
        other = left.select("value", F.col("id").alias("b"), F.col("c_id").alias("c_b"))
        pairs = left.withColumnRenamed("id", "a").join(other, "value").where("a < b and c_id <> c_b").select("a", "b").distinct()
        pairs = self.likely(pairs)
        links = links.unionByName(self.confirmed(pairs, self.sets(pairs.select(F.explode(F.array("a", "b")).alias("id")), "short")))
        groups = components(links)
        self.free("short")
        # Long lists that are still open.
        left = self.apart(members.where((F.col("id") != F.col("hub")) & (F.col("m") > SHORT)).select("value", "id"), groups, "id")
        wide = left.groupBy("value").agg(F.min("c_id").alias("low"), F.max("c_id").alias("high")).where("low <> high").select("value", "low")
        left = cut_lineage(left.join(wide, "value"))
        if left.isEmpty():
            return groups
        # Documents of an open list belong together; so do lists that share a document or a component.
        stars = left.select(F.col("low").alias("a"), F.col("c_id").alias("b")).distinct()
        clusters = components(stars).select(F.col("node").alias("c_id"), F.col("component").alias("cluster"))
        docs = left.select("id", "c_id").distinct().join(clusters, "c_id").select("cluster", "id", F.col("c_id").alias("component"))
        return components(links.unionByName(self.blocks(cut_lineage(docs))))


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets on the left with all on the right."""
    flat = [np.concatenate(side) for side in (left, right)]
    of = [np.repeat(np.arange(len(side)), [len(v) for v in side]) for side in (left, right)]
    common = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.float32)
    places = []
    for values, owner in zip(flat, of):
        at = np.searchsorted(common, values)
        hit = np.flatnonzero(common[np.minimum(at, len(common) - 1)] == values) if len(common) else np.zeros(0, np.int64)
        order = np.argsort(at[hit], kind="stable")
        places.append((at[hit][order], owner[hit][order]))
    for first in range(0, len(common), COLUMNS):
        sides = []
        for (at, owner), n in zip(places, (len(left), len(right))):
            a, b = np.searchsorted(at, (first, first + COLUMNS))
            dense = np.zeros((n, COLUMNS), np.float32)
            dense[owner[a:b], at[a:b] - first] = 1
            sides.append(dense)
        out += sides[0] @ sides[1].T
    return np.rint(out).astype(np.int64)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, width: int = 5, k: int = K) -> DataFrame:
    """Groups of near-duplicate documents: (key, n_shingles, component_id, kept), one row for each input row.

    Two documents are linked if `100 * common >= percent * union` of their sets of `width`-word shingles; a text with fewer
    words has one shingle, all its words; a null text or one without words has none and no link. `component_id` is the
    smallest key that links reach, and the row with that key is kept. Rows that repeat a key are judged each by its
    own text; a row with a null key is linked with nothing and kept. Other columns are not read. `percent` must be
    80 or more, which the sketch estimate is laid out for.
    """
    if percent < 80:
        raise ValueError("percent must be 80 or more")
    work = Linker(docs, key, text, percent, width, k)
    groups = work.links()
    named = groups.select(F.col("node").alias("id"), "component")
    classes = work.classes.select("n", "hi", "lo", "id").join(named, "id", "left").select(
        "n", "hi", "lo", F.coalesce("component", "id").alias("component"))
    classes = cut_lineage(classes)
    for name in ("sized", "clustered", "classes"):
        work.scratch.drop(name)
    rows = work.sketches.select("id", "n", "hi", "lo").join(classes, ["n", "hi", "lo"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return rows.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
                       component.eqNullSafe(F.col("id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """`docs` without the documents that are not the kept one of their group; a key goes if none of its rows is kept."""
    judged = near_duplicates(docs.select(key, text), key, text, percent)
    gone = judged.groupBy(key).agg(F.max("kept").alias("kept")).where(~F.col("kept")).select(key)
    return docs.join(small_side(gone, 1_000_000), key, "left_anti").select(*docs.columns)

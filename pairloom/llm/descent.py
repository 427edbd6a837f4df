"""Near-duplicate vectors by NN-descent.

1. Equal vectors form a class; its smallest id stands for it.
2. A first neighbour graph: in several rounds, vectors are sorted by the signs of random projections and compared with those
   in the same block of the sorted order.
3. Descent: each vector's neighbours, forward and backward, are compared with each other; better neighbours replace worse
   ones, until few change.
4. Edges above the threshold, checked in double precision, give components. Of the close vectors met in one place, a spanning
   forest is kept beside the lists, so no list's length cuts a link off. A neighbour list is saturated if all of it is above the
   threshold: then rounds are added whose lists hold only vectors outside the own component, until none is saturated.
   All links in a component are counted, block against block; pairs are not written out.
5. An audit compares a fixed number of vectors, and as many of small components, with all rows. If too small a share of a
   vector's links was found in the mean, rounds are added; after the last, all rows are compared with all others in strips.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.components import components
from pairloom.llm.scratch import Scratch, cut_lineage

K = 8  # neighbours of a list
BLOCK = 64  # vectors compared in one block of a sorted round
ROUNDS, MORE, MOST = 12, 12, 48  # random orders at first, added after an audit, in all
DESCENTS = 4
AUDIT, ENOUGH = 2048, 0.99  # audited vectors at most; share of their links that must be found
SMALL = 64  # members of a small component
LIST = 512  # members of a component in one block
STRIP, ROWS = 8192, 512  # vectors that all rows are compared with at once, and rows of one product
SLACK = 1e-4  # of a cosine in single precision


def prepared(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, node, unit) for all rows: vectors scaled to length one, with a digest of their values; no node if unusable."""
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            # Nulls have become NaN; scaling by the largest part first keeps very large and very small vectors exact.
            most = np.abs(values).max(axis=1)
            usable = np.isfinite(values).all(axis=1) & (most > 0)
            values[~usable], most[~usable] = 1.0, 1.0
            scaled = values / most[:, None]
            unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
            nodes = np.array([xxhash.xxh3_64_intdigest(v.tobytes()) for v in values + 0.0], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, mask=~usable), listed(unit)], ["id", "node", "unit"])

    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    fits = F.col("id").isNotNull() & (F.coalesce(F.size("v"), F.lit(-1)) == dim)
    rest = rows.where(~fits).select("id", F.lit(None).cast("long").alias("node"), F.lit(None).cast("array<double>").alias("unit"))
    return rows.where(fits).mapInArrow(run, f"id {kind}, node long, unit array<double>").unionByName(rest)


def listed(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def groups(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows with equal first column, which are sorted together; with `most`, every so many rows instead."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        if most:
            cuts = np.arange(most, len(batch), most)
        else:
            cuts = np.flatnonzero(np.diff(batch.column(0).to_numpy())) + 1
        first = 0
        for cut in cuts.tolist():
            yield batch.slice(first, cut - first)
            first = cut
        rest = batch.slice(first)
    if rest is not None:
        yield rest


def closest(cosines: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row."""
    k = min(k, cosines.shape[1])
    return np.argpartition(-cosines, k - 1, axis=1)[:, :k]


EDGES = "node long, other long, cosine float, tie boolean"  # a tie is an edge of a spanning forest; the others are for lists


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of a symmetric table of links."""
    a, b, unseen = [], [], near.any(axis=1)
    while unseen.any():
        todo = [int(unseen.argmax())]
        unseen[todo] = False
        while todo:
            i = todo.pop()
            new = np.flatnonzero(near[i] & unseen)
            unseen[new] = False
            a += [i] * len(new)
            b += new.tolist()
            todo += new.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def ties(names: np.ndarray, cosines: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A forest of the pairs surely above the threshold, and all pairs that single precision leaves open."""
    a, b = spanning(cosines >= threshold + SLACK)
    c, d = np.nonzero(np.triu(np.abs(cosines - threshold) < SLACK))
    a, b = np.concatenate([a, c]), np.concatenate([b, d])
    return names[a], names[b], cosines[a, b]


def first_graph(nodes: DataFrame, count: int, dim: int, rounds: range, threshold: float) -> DataFrame:
    """Edges between vectors of different components in one block of a random order; one range sort holds all rounds."""
    bits = int(np.clip(np.log2(max(count, 2) / BLOCK), 1, 40))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {r: np.random.default_rng(r).standard_normal((dim, bits + 1)) for r in rounds}
        for batch in batches:
            units = matrix(batch.column(1), dim)
            for r in rounds:
                at = units @ planes[r]
                number = ((at[:, :bits] > 0) << np.arange(bits)).sum(axis=1).astype(np.int64)
                number ^= number >> 1  # neighbours in the order differ in few signs
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), r)), pa.array(number), pa.array(at[:, bits]), batch.column(0), listed(units.astype(np.float32)), batch.column(2)],
                                                 ["round", "code", "at", "node", "unit", "component"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in groups(batches, BLOCK):
            if len(block) < 2:
                continue
            units, names = matrix(block.column(4), dim), block.column(3).to_numpy()
            cosines = units @ units.T
            rounds, own = block.column(0).to_numpy(), block.column(5).to_numpy()
            cosines[(rounds[:, None] != rounds[None, :]) | (own[:, None] == own[None, :])] = -2
            best = closest(cosines, K)
            row = np.repeat(np.arange(len(names)), best.shape[1])
            column = best.ravel()
            good = cosines[row, column] > -2
            yield edges(names[row[good]], names[column[good]], cosines[row[good], column[good]])
            yield edges(*ties(names, cosines, threshold), tie=True)

    coded = nodes.select("node", "unit", "component").mapInArrow(code, "round long, code long, at double, node long, unit array<float>, component long")
    placed = coded.repartitionByRange("round", "code", "at").sortWithinPartitions("round", "code", "at")
    return placed.mapInArrow(compare, EDGES)


def edges(node, other, cosine, tie: bool = False) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(cosine, pa.float32()), pa.array(np.full(len(node), tie))],
                                      ["node", "other", "cosine", "tie"])


def best_lists(found: DataFrame, k: int) -> DataFrame:
    """The k best of each node's edges, each once. A node's edges are few: bounded by the rounds and lists they come from."""
    lists = found.groupBy("node").agg(F.collect_set(F.struct("cosine", "other")).alias("all"))
    best = F.slice(F.sort_array("all", asc=False), 1, k)
    return lists.select("node", F.explode(best).alias("e")).select("node", F.col("e.other").alias("other"), F.col("e.cosine").alias("cosine"))


def descend(graph: DataFrame, nodes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Edges that one step of descent finds: neighbours of a common vector, where they beat the worst of either's list; and ties."""
    worst = graph.groupBy("node").agg(F.min("cosine").alias("worst"))
    reverse = best_lists(graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "cosine"), K)
    around = graph.select("node", "other").unionByName(reverse.select("node", "other")).distinct()
    here = nodes.join(worst, "node").select(F.col("node").alias("other"), "worst", F.transform("unit", lambda x: x.cast("float")).alias("unit"), "component")
    rows = around.join(here, "other").select("node", "other", "worst", "unit", "component").repartition("node").sortWithinPartitions("node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, near, size = [], [], 0
        for group in groups(batches):
            if len(group) < 2:
                continue
            units, names, worst = matrix(group.column(3), dim), group.column(1).to_numpy(), group.column(2).to_numpy()
            own = group.column(4).to_numpy()
            cosines = units @ units.T
            cosines[own[:, None] == own[None, :]] = -2
            row, column = np.nonzero(cosines > worst[:, None])
            out.append((names[row], names[column], cosines[row, column]))
            near.append(ties(names, cosines, threshold))
            size += len(row) + len(near[-1][0])
            if size > 50_000:
                yield edges(*(np.concatenate(x) for x in zip(*out)))
                yield edges(*(np.concatenate(x) for x in zip(*near)), tie=True)
                out, near, size = [], [], 0
        if out:
            yield edges(*(np.concatenate(x) for x in zip(*out)))
            yield edges(*(np.concatenate(x) for x in zip(*near)), tie=True)

    return rows.mapInArrow(compare, EDGES)


def checked(found: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) whose cosine in double precision reaches the threshold."""
    near = found.where(F.col("cosine") >= threshold - SLACK).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    side = lambda end: nodes.select(F.col("node").alias(end), F.col("unit").alias(f"u_{end}"))
    both = near.join(side("a"), "a").join(side("b"), "b")
    dot = F.aggregate(F.zip_with("u_a", "u_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return cut_lineage(both.where(dot >= threshold).select("a", "b"))


def counted(members: DataFrame, dim: int, threshold: float) -> DataFrame:
    """(node, links): for members (node, component, unit, times), how many other vectors of the component reach the threshold.

    A large component is cut into blocks of about LIST members; each pair of blocks is a task's group of bounded size.
    """
    sizes = members.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / LIST).cast("int").alias("blocks"))
    placed = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    left = placed.select("component", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(True).alias("asks"), "node", "times", "unit")
    right = placed.select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("block").alias("j"), F.lit(False).alias("asks"), "node", "times", "unit")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        asks = group["asks"].to_numpy()
        names, times = group["node"].to_numpy(), group["times"].to_numpy()
        units = matrix(group["unit"].combine_chunks() if isinstance(group["unit"], pa.ChunkedArray) else group["unit"], dim)
        near = units[asks] @ units[~asks].T >= threshold
        links = (near & (names[asks][:, None] != names[~asks][None, :])) @ times[~asks]
        return pa.table([pa.array(names[asks], pa.int64()), pa.array(links.astype(np.int64))], names=["node", "links"])

    # Dealt by block pair: the layout by component that the join leaves would serve the grouping too, all blocks in one task.
    both = left.unionByName(right).repartition("component", "i", "j")
    pairs = both.groupBy("component", "i", "j").applyInArrow(compare, "node long, links long")
    return pairs.groupBy("node").agg(F.sum("links").alias("links"))


def placed(nodes: DataFrame, links: DataFrame | None) -> DataFrame:
    """`nodes` with their component, which is the node itself without a link."""
    if links is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))


def audit(nodes: DataFrame, links: DataFrame, dim: int, threshold: float) -> float:
    """Mean share of a node's links, found by comparison with all rows, that lie within its component of `links`.

    Up to AUDIT nodes with a link count alike, however many links they have; so do up to AUDIT nodes outside large components,
    where a lost link weighs most. The smaller of the two means.
    """
    rows = cut_lineage(placed(nodes.select("node", "unit"), links))
    large = rows.groupBy("component").count().where(F.col("count") > SMALL).select("component")
    some = lambda df: df.select("node", "unit", "component").orderBy(F.xxhash64("node"), "node").limit(AUDIT).collect()
    strata = [some(rows), some(rows.join(large, "component", "left_anti"))]
    chosen = [r for rows in strata for r in rows]
    if not chosen:
        return 1.0
    asked = np.array([r["node"] for r in chosen], np.int64), np.array([r["unit"] for r in chosen]), np.array([r["component"] for r in chosen], np.int64)
    shared = nodes.sparkSession.sparkContext.broadcast(asked)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, units, component = shared.value
        n, found = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        for batch in batches:
            for i in range(0, len(batch), ROWS):
                part = batch.slice(i, ROWS)
                near = (matrix(part.column(1), dim) @ units.T >= threshold) & (part.column(0).to_numpy()[:, None] != names[None, :])
                n += near.sum(axis=0)
                found += (near & (part.column(2).to_numpy()[:, None] == component[None, :])).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names))), pa.array(n), pa.array(found)], ["at", "n", "found"])

    sums = rows.select("node", "unit", "component").mapInArrow(compare, "at long, n long, found long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("found").alias("found"))
    share = {r["at"]: r["found"] / r["n"] for r in sums.where("n > 0").collect()}
    own = [[share[i] for i in part if i in share] for part in (range(len(strata[0])), range(len(strata[0]), len(chosen)))]
    return min(float(np.mean(x)) if x else 1.0 for x in own)


def all_pairs(nodes: DataFrame, links: DataFrame, count: int, dim: int, threshold: float) -> DataFrame:
    """Pairs (a, b) of components that any link joins: every row is compared with all others, a strip of them at a time."""
    rows, strips = cut_lineage(placed(nodes.select("node", "unit"), links)), -(-count // STRIP)
    found = []
    for i in range(strips):
        strip = rows.where(F.pmod(F.xxhash64("node"), F.lit(strips)) == i).orderBy("component").collect()
        if not strip:
            continue
        shared = nodes.sparkSession.sparkContext.broadcast((np.array([r["unit"] for r in strip]), *np.unique([r["component"] for r in strip], return_index=True)))

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            units, components_, first = shared.value
            for batch in batches:
                for i in range(0, len(batch), ROWS):
                    part = batch.slice(i, ROWS)
                    near = np.logical_or.reduceat(matrix(part.column(1), dim) @ units.T >= threshold, first, axis=1)
                    row, column = np.nonzero(near)
                    a, b = part.column(2).to_numpy()[row], components_[column]
                    pairs = np.unique(np.stack([a[a != b], b[a != b]]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        found.append(cut_lineage(rows.select("node", "unit", "component").mapInArrow(compare, "a long, b long").distinct()))
        shared.destroy()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept), one row for each input row.

    Two vectors are linked if their cosine in double precision is at least `threshold`. `n_links` counts the other vectors
    linked to it, equal ones and repeated rows included; `component_id` is the smallest key that links reach, itself
    included; `kept` says whether that is the row's own. Vectors that are null, zero, hold null or non-finite components,
    or are not of the most frequent length (the smaller on a tie) link with nothing. A row with a null key links with
    nothing, and is kept. Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "descent")
    lengths = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), "dim").first()
    dim = common["dim"] if common else 1
    rows = scratch.table(prepared(vectors, key, vector, dim), "rows")
    nodes = scratch.table(rows.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("times"), F.first("unit").alias("unit")), "nodes")
    count = nodes.count()
    graph, linked, done = None, None, 0
    while True:
        here = cut_lineage(placed(nodes.select("node", "unit"), linked))
        fresh = cut_lineage(first_graph(here, count, dim, range(done, done + (MORE if done else ROUNDS)), threshold))
        done += MORE if done else ROUNDS
        close, lists = fresh.where("tie"), fresh.where("not tie")
        if graph is not None:  # neighbours that have come into the own component leave their place to others
            side = lambda end: here.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
            lists = lists.unionByName(graph.join(side("node"), "node").join(side("other"), "other").where("c_node <> c_other").select(*graph.columns, F.lit(False).alias("tie")))
        graph = cut_lineage(best_lists(lists, K))
        for _ in range(DESCENTS):
            more = cut_lineage(descend(graph, here, dim, threshold))
            close = close.unionByName(more.where("tie"))
            better = cut_lineage(best_lists(graph.unionByName(more.where("not tie").drop("tie")), K))
            changed = better.join(graph, ["node", "other"], "left_anti").count()
            graph = better
            if changed <= 0.002 * K * count:
                break
        pairs = checked(graph.unionByName(close.drop("tie")), nodes, threshold)
        stars = lambda: linked.select(F.col("node").alias("a"), F.col("component").alias("b"))
        linked = components(pairs if linked is None else pairs.unionByName(stars()))
        full = graph.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("worst")).where((F.col("n") >= K) & (F.col("worst") >= threshold - SLACK))
        if full.isEmpty() and audit(nodes, linked, dim, threshold) >= ENOUGH:
            break
        if done >= MOST:
            linked = components(stars().unionByName(all_pairs(nodes, linked, count, dim, threshold)))
            break
    members = nodes.join(linked, "node").select("node", "component", "times", "unit")
    links = counted(members, dim, threshold)
    smallest = nodes.join(linked, "node").groupBy("component").agg(F.min("id").alias("smallest"))
    found = nodes.select("node", "id", "times").join(linked, "node", "left").join(smallest, "component", "left").join(links, "node", "left")
    found = cut_lineage(found.select("node", F.coalesce("smallest", "id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")))
    scratch.drop("nodes")
    usable = rows.where("node is not null").select("id", "node").join(found, "node").select("id", "n_links", "component_id")
    out = usable.unionByName(rows.where("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))

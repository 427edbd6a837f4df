"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.scratch import cut_lineage

PART, PARTS = 50_000, 8  # edges of a task, and tasks at least
FEW = 100_000  # edges of a table whose nodes' minima are broadcast


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b); the component is the smallest node that links reach.

    Each step points neighbours at the smallest node known; a node with very many links is reduced by partial
    minima before its rows move, and its join is split by adaptive execution. Repeated links, loops and both directions
    are allowed; links with a null end are ignored. An empty table gives an empty table. Steps add no edges, so the tasks that
    read and write them are as many as the edges ask for, and minima of a small table are broadcast instead of shuffling its edges.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut_lineage(edges)
    count, done = standing(edges)
    parts, few = max(PARTS, -(-count // PART)), count <= FEW
    edges = edges.coalesce(parts)
    while not done:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(F.broadcast(low) if few else low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not few:
            large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(F.broadcast(low) if few else low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct().coalesce(parts))
        _, done = standing(edges)
    # Every edge now points from a node to its component's smallest node.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def standing(edges: DataFrame) -> tuple[int, bool]:
    """How many edges (larger, smaller) there are, and whether they are stars: no node has two smaller neighbours, or one on either side."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    count, open_ = nodes.agg(F.sum("up"), F.max(F.expr("up > 1 or up + down > 1"))).first()
    return count or 0, not open_

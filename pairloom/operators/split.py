"""Exact, seeded splits and samples; a table with usable ordinals is not sorted."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.order import ORD, kth_smallest, number_rows

POSITION = "_pairloom_position"   # a written row number, while a table without usable ordinals is cut


def seeded_hash(seed: int, *columns: str) -> Column:
    """A non-negative 63-bit hash of the given columns under a seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(c) for c in columns]), 1)


def _lowest(ids: DataFrame, k: int, seed: int, ord: str) -> Column | None:
    """The condition that holds for the k rows with the smallest (hash, ordinal); more or fewer where ordinals are not unique."""
    h = seeded_hash(seed, ord)
    edge = kth_smallest(ids, h, k)
    if edge is None:
        return None
    below, ties = ids.agg(F.count_if(h < edge), F.count_if(h == edge)).first()
    if below + ties == k:
        return h <= edge
    last = kth_smallest(ids.where(h == edge), ord, k - below)
    return h < edge if last is None else (h < edge) | ((h == edge) & F.coalesce(F.col(ord) <= last, F.lit(False)))


def _last(ids: DataFrame, k: int, rows: int, ord: str) -> Column:
    """The condition that holds for the last k rows; rows without an ordinal come first."""
    place = F.coalesce(F.col(ord).cast("long"), F.lit(-2**63))
    return place > kth_smallest(ids, place, rows - k)


def _exactly(df: DataFrame, ids: DataFrame, k: int, pick: Callable[[DataFrame, str], Column], ord: str) -> tuple[DataFrame, Column]:
    """(table, condition) where the condition holds for exactly k rows.

    A row without an ordinal, or with one that others have too, may sit on the edge. Then the table is written once with
    positions by (ordinal, content), and those take the ordinal's place.
    """
    chosen = pick(ids, ord)
    if ids.where(chosen).count() == k:
        return df, chosen
    content = F.xxhash64(*[F.to_json(F.struct(f"`{c}`")) for c in df.columns])
    numbered = number_rows(df, F.col(ord), content, into=POSITION)
    return numbered, pick(numbered.select(POSITION), POSITION)


def split(df: DataFrame, test_size: float | None, seed: int = 42, shuffle: bool = True,
          ord: str = ORD, ordinals: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(train, eval) with ceil(test_size * rows) rows in eval; a falsy size holds nothing back.

    Shuffled, the eval rows are those with the smallest seeded hashes; unshuffled, the last ones.
    Both sides are filters on the same table, so nothing is shuffled or joined. The place to cut is
    found in `ordinals`, the table's ordinals written out, when reading them from `df` is costly.
    Every row is on one side, with or without an ordinal of its own; rows without one come first.
    """
    if not test_size:
        return df, None
    if not 0 < test_size < 1:
        raise ValueError("test_size is a fraction between 0 and 1")
    ids = df.select(ord) if ordinals is None else ordinals
    rows = ids.count()
    k = math.ceil(test_size * rows)
    if rows < 2 or k >= rows:
        raise ValueError(f"{rows} rows cannot be split with test_size={test_size}")
    pick = (lambda d, o: _lowest(d, k, seed, o)) if shuffle else (lambda d, o: _last(d, k, rows, o))
    table, in_eval = _exactly(df, ids, k, pick, ord)
    return table.where(~in_eval).select(*df.columns), table.where(in_eval).select(*df.columns)


def split_if_large(df: DataFrame, test_size: float | None = None, seed: int = 42, more_than: int = 1,
                   ord: str = ORD) -> tuple[DataFrame, DataFrame | None]:
    """Split only tables with more than `more_than` rows, by default all that can be split; a falsy size means one percent."""
    large = df.select(ord).limit(more_than + 1).count() > more_than
    return split(df, test_size or 0.01, seed, True, ord) if large else (df, None)


def sample_rows(df: DataFrame, n: int | None, seed: int = 42, ord: str = ORD) -> DataFrame:
    """Exactly n random rows (shuffle, then cap); a table of n rows or fewer stays whole."""
    if not n:
        return df
    ids = df.select(ord)
    if ids.limit(n + 1).count() <= n:
        return df
    table, chosen = _exactly(df, ids, n, lambda d, o: _lowest(d, n, seed, o), ord)
    return table.where(chosen).select(*df.columns)


def shuffle_rows(df: DataFrame, seed: int = 42, *ids: str) -> DataFrame:
    """Rows in seeded random order; do this right before writing.

    Hashes are spread evenly, so their leading bits say which partition a row goes to: no pass looks for the bounds that a
    sort of the table would need, and rows are read once. Partitions follow each other in order.
    """
    ids = ids or (ORD,)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    width = min((2**63 - 1) // parts + 1, 2**63 - 1)
    placed = df.withColumn("_pairloom_hash", seeded_hash(seed, *ids))
    return (placed.repartitionById(parts, F.expr(f"_pairloom_hash div {width}L").cast("int"))
            .sortWithinPartitions("_pairloom_hash", *ids).drop("_pairloom_hash"))

"""Row order at scale.

Rows carry a unique `long` ordinal (`_ord`). Positions are found by narrowing the range that holds
the k-th ordinal with small histograms, so a head, a page or a split is a plain filter on the
ordinal and never a sort of whole rows into one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.session import cut_lineage, scratch_path, stage

ORD = "_ord"
INTERNAL = (ORD, "_src", "_error")   # columns this library adds; no other name is special
SMALL = 50_000      # single numbers one task may sort
WIDE = 1_000        # whole rows one task may sort
FANOUT = 4096       # histogram cells per narrowing pass


def kth_smallest(df: DataFrame, column: str | Column, k: int) -> int | None:
    """The exact k-th smallest value (from 1) of a long column; None when there are fewer than k.

    Each pass reads that one column, counts up to twice FANOUT equal cells of the current range and keeps the
    cell holding the k-th value. The last cell is small enough to sort.
    """
    if k < 1:
        raise ValueError("k counts from 1")
    values = df.select((F.col(column) if isinstance(column, str) else column).cast("long").alias("v"))
    low, high, rows = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if k > rows:
        return None
    while rows > SMALL and low < high:
        bits = max(0, (high - low).bit_length() - FANOUT.bit_length() + 1)   # cells by leading bits: a range may be as wide as longs are
        cells = (values.where(F.col("v").between(low, high))
                 .groupBy(F.shiftright("v", bits).alias("cell")).agg(F.count("*").alias("n")))
        upto = F.sum("n").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        cell, rows, reached = (cells.withColumn("upto", upto).where(F.col("upto") >= k)
                               .orderBy("cell").select("cell", "n", "upto").first())
        k -= reached - rows
        low, high = max(low, cell << bits), min(high, ((cell + 1) << bits) - 1)
    if low == high:
        return low
    return (values.where(F.col("v").between(low, high)).orderBy("v").limit(k).agg(F.max("v")).first()[0])


def head(df: DataFrame, n: int | None, ord: str = ORD, ordinals: DataFrame | None = None) -> DataFrame:
    """The first n rows by ordinal; a falsy n keeps all rows. Rows without an ordinal come first.

    The edge is looked for in `ordinals`, the table's ordinals written out, where reading them from `df` is costly.
    """
    if not n:
        return df
    if n <= WIDE and ordinals is None:
        return df.orderBy(ord).limit(n)
    return _up_to(df, n, ord, df.select(ord) if ordinals is None else ordinals)


def _place(ord: str) -> Column:
    """The ordinal; rows without one come first, as in a sort."""
    return F.coalesce(F.col(ord).cast("long"), F.lit(-2**63))


def _up_to(df: DataFrame, n: int, ord: str, ids: DataFrame) -> DataFrame:
    """Exactly the n first rows; where rows share the last ordinal, any of them fill the number, the same in every pass."""
    place = _place(ord)
    last = kth_smallest(ids, place, n)
    if last is None:
        return df
    below, ties = ids.agg(F.count_if(place < last), F.count_if(place == last)).first()
    if below + ties == n:
        return df.where(place <= last)
    return df.where(place < last).unionByName(cut_lineage(df.where(place == last).limit(n - below)))


@dataclass(frozen=True)
class Page:
    """A slice of a table and the size of the whole."""

    rows: DataFrame
    total: int


def page_rows(df: DataFrame, size: int = 5, offset: int = 0, ord: str = ORD) -> DataFrame:
    """Rows [offset, offset + size) by ordinal, clamped to the table."""
    offset, size = max(0, offset), max(0, size)
    if offset + size <= WIDE:
        return df.orderBy(ord).offset(offset).limit(size)
    place = _place(ord)
    first = kth_smallest(df, place, offset + 1)
    if first is None or size == 0:
        return df.where(F.lit(False))
    skipped = offset - df.where(place < first).count()
    if skipped:   # the page begins among rows that share an ordinal
        numbered = number_rows(df.where(place >= first), ord)
        return numbered.where(F.col("_pos").between(skipped, skipped + size - 1)).orderBy("_pos").drop("_pos")
    return head(df.where(place >= first), size, ord).orderBy(ord)


def page(df: DataFrame, size: int = 5, offset: int = 0, ord: str = ORD) -> Page:
    return Page(page_rows(df, size, offset, ord), df.count())


def number_rows(df: DataFrame, *order: str | Column, into: str = "_pos") -> DataFrame:
    """Dense positions from 0 in the given total order.

    A distributed sort is written once; each sorted part then only needs the number of rows in the
    parts before it.
    """
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    ranged = stage(df.orderBy(*order).withColumns({"_part": part, "_place": place}), scratch_path(df.sparkSession, "numbered"))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))  # one row per sorted part
    return (ranged.join(F.broadcast(starts), "_part")
            .withColumn(into, F.col("_start") + F.col("_place")).drop("_part", "_place", "_start"))


def running_before(df: DataFrame, value: Column, keys: Sequence[str], ord: str, into: str,
                   fold: Callable[[Column], Column], block: int) -> DataFrame:
    """`fold` (F.max or F.sum) of `value` over the rows of the same keys with a smaller ordinal.

    A key's rows are cut into blocks of `block` ordinals, so a key holding most of the table is
    still spread over many tasks: blocks are folded first, the value carried into each block joins
    its rows as one more row in front, and only a block is ever sorted at once.
    """
    rows = df.withColumns({"_value": value, "_block": F.expr(f"`{ord}` div {block}L"), "_carry": F.lit(False)})
    totals = rows.groupBy(*keys, "_block").agg(fold(F.col("_value")).alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (totals.select(*keys, "_block", fold(F.col("_total")).over(earlier).alias("_value"))
               .where(F.col("_value").isNotNull()).withColumn("_carry", F.lit(True)))
    within = (Window.partitionBy(*keys, "_block").orderBy(F.col("_carry").desc(), ord)
              .rowsBetween(Window.unboundedPreceding, -1))
    before = fold(F.col("_value")).over(within)
    if fold is F.sum:
        before = F.coalesce(before, F.lit(0))
    return (rows.unionByName(carried, allowMissingColumns=True).withColumn(into, before)
            .where(~F.col("_carry")).drop("_value", "_block", "_carry"))


def narrow_to_nth(rows: DataFrame, wanted: DataFrame, keys: Sequence[str], cell: str) -> DataFrame:
    """For every key, the cell that holds its row number `_nth` (from 0) when rows are ordered by cell.

    Returns keys, cell and the row's number within the cell. Only cells are ordered, not rows;
    repeated with finer cells it closes in on one row of each key, however many rows a key has.
    """
    cells = rows.join(wanted, list(keys), "left_semi").groupBy(*keys, cell).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    counted = cells.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).join(wanted, list(keys))
    holds = (F.col("_nth") >= F.col("_before")) & (F.col("_nth") < F.col("_before") + F.col("_n"))
    return counted.where(holds).select(*keys, cell, (F.col("_nth") - F.col("_before")).alias("_nth"))

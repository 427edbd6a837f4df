"""The files of a source, ranked when a plan is made, and row ranges that read only the files they touch.

Spark lists a source's files on the driver anyway. Their order becomes a lookup expression over each row's file path, so
ordinals need neither a pass over the rows nor a join. A filter on that expression alone holds for whole files, and Spark
leaves files out before it opens them.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.order import ORD, Page

ORD_BITS = 55          # bits of an ordinal within one source
MAX_FILES = 2**22      # files of one source
LOOKUP = 2**17         # files whose ranks fit into an expression; more are joined as a broadcast table
PLACE_BITS = 33        # rows that one task numbers
WIDEST_SPLIT = 40      # bits of a byte offset within a text file


def _as_metadata(uri: str) -> str:
    """A listed file's path the way `_metadata.file_path` writes it."""
    return re.sub(r"^(\w[\w+.-]*):///+", r"\1:/", uri)


class FileRanks:
    """Files in path order. `shift` is how far a rank is moved to leave room for the place in a file."""

    def __init__(self, scan: DataFrame):
        self.paths = sorted(_as_metadata(p) for p in scan.inputFiles())
        if len(self.paths) > MAX_FILES:
            raise ValueError(f"more than {MAX_FILES} files in one source; compact them first")
        self.shift = ORD_BITS - max(len(self.paths) - 1, 0).bit_length()

    def rank(self) -> Column:
        """The rank of a row's file: a hash table of the paths, folded into the plan as a constant."""
        if len(self.paths) <= 1:
            return F.lit(0).cast("long")
        width = 1 << (len(self.paths) - 1).bit_length()
        cells: list[dict[str, int]] = [{} for _ in range(width)]
        for i, path in enumerate(self.paths):
            cells[zlib.crc32(path.encode()) % width][path] = i
        table = F.from_json(F.lit(json.dumps(cells, ensure_ascii=False)), "array<map<string,bigint>>")
        path = F.col("_metadata.file_path")
        found = F.element_at(table, (F.crc32(path.cast("binary")) % width + 1).cast("int"))[path]
        missing = F.raise_error(F.concat(F.lit("a file that was not there when the source was opened: "), path)).cast("long")
        return F.coalesce(found, missing)

    def ranked(self, scan: DataFrame, *metadata: Column) -> DataFrame:
        """The scan with `_rank` and the given metadata columns."""
        if len(self.paths) <= LOOKUP:
            return scan.select("*", *metadata, self.rank().alias("_rank"))
        spark = scan.sparkSession
        table = spark.sparkContext.parallelize(list(enumerate(self.paths)), 64).toDF("_rank long, _path string")
        return (scan.select("*", *metadata, F.col("_metadata.file_path").alias("_path"))
                .join(F.broadcast(table), "_path").drop("_path"))


def text_ordinal(df: DataFrame, lineage: bool = False) -> DataFrame:
    """A text scan with `_ord` by file, input split and row. It changes with the splits: land it before a second pass.

    A split's first byte plus the row's number within its task orders rows, as long as a task has fewer rows than its splits
    have bytes; spare bits widen that for compressed files that can be split, and a split beyond it stops the job.
    """
    ranks = FileRanks(df)
    spare = max(0, min(ranks.shift - WIDEST_SPLIT, 10))
    meta = {n: F.col(f"_metadata.{n}") for n in ("file_block_start", "file_block_length", "file_size")}
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(2**PLACE_BITS - 1))
    extra = [F.col("_metadata.file_path").alias("_file")] if lineage else []
    rows = ranks.ranked(df, *extra, *(c.alias(f"_{n}") for n, c in meta.items()), place.alias("_place"))
    inner = F.col("_file_block_start") + F.col("_file_block_length") < F.col("_file_size")
    fits = ~inner | (F.col("_place") < F.shiftleft("_file_block_length", spare))
    within = F.shiftleft("_file_block_start", spare) + F.col("_place")
    wrong = F.raise_error(F.lit("a file too long, or a split with more rows than bytes: decompress or divide it")).cast("long")
    ordinal = F.when(fits & (within < F.lit(1 << ranks.shift)), F.shiftleft("_rank", ranks.shift) + within).otherwise(wrong)
    return rows.withColumn(ORD, ordinal).drop("_rank", "_place", *(f"_{n}" for n in meta))


class FileTable:
    """A Parquet source whose rows are numbered by file and place. Heads and pages open only the files that hold them.

    `scan` reads the whole source. Row counts come from file footers, a group of files at a time and only as far as a
    question needs them.
    """

    def __init__(self, scan: DataFrame):
        self.scan, self.files = scan, FileRanks(scan)
        self.starts = [0]   # rows before each file, as far as counted

    def _ranked(self, first: int = 0, last: int | None = None, lineage: bool = False) -> DataFrame:
        extra = [F.col("_metadata.file_path").alias("_file")] if lineage else []
        rows = self.files.ranked(self.scan, *extra, F.col("_metadata.row_index").alias("_place"))
        if first == 0 and (last is None or last >= len(self.files.paths) - 1):
            return rows
        return rows.where(F.col("_rank").between(first, last))

    def _ordered(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(ORD, F.shiftleft("_rank", self.files.shift) + F.col("_place")).drop("_rank", "_place")

    def rows(self, lineage: bool = False) -> DataFrame:
        """All rows with `_ord`."""
        return self._ordered(self._ranked(lineage=lineage))

    def _count_to(self, rows: int | None) -> None:
        """Count files until they hold more than `rows` rows, each time as many files as are counted already."""
        while len(self.starts) <= len(self.files.paths) and (rows is None or self.starts[-1] <= rows):
            first = len(self.starts) - 1
            last = len(self.files.paths) - 1 if rows is None else min(max(2 * first, first + 15), len(self.files.paths) - 1)
            found = self._ranked(first, last).groupBy("_rank").agg(F.count(F.lit(1)).alias("n")).collect()   # a row for each file
            counts = {r["_rank"]: r["n"] for r in found}
            for i in range(first, last + 1):
                self.starts.append(self.starts[-1] + counts.get(i, 0))

    def total(self) -> int:
        """The number of rows, from the footers of all files."""
        self._count_to(None)
        return self.starts[-1]

    def is_empty(self) -> bool:
        self._count_to(0)
        return self.starts[-1] == 0

    def slice(self, offset: int = 0, size: int | None = None) -> DataFrame:
        """Rows [offset, offset + size), clamped to the table; all from `offset` on without a size. They are not sorted."""
        offset = max(0, offset)
        if size is None and offset == 0:
            return self.rows()
        end = None if size is None else offset + max(0, size)
        self._count_to(end if end is not None else offset)
        known = self.starts[-1]
        end = known if end is None and len(self.starts) > len(self.files.paths) else end
        if offset >= known or end is not None and end <= offset:
            return self.rows().where(F.lit(False))
        first = bisect_right(self.starts, offset) - 1
        low = (first << self.files.shift) + offset - self.starts[first]
        last = len(self.files.paths) - 1
        out = F.col(ORD) >= low
        if end is not None and end < known:
            last = bisect_right(self.starts, end - 1) - 1
            out = out & (F.col(ORD) < (last << self.files.shift) + end - self.starts[last])
        elif end is not None:
            last = min(last, len(self.starts) - 2)
        return self._ordered(self._ranked(first, last)).where(out)

    def head(self, n: int | None) -> DataFrame:
        """The first n rows; a falsy n means all."""
        return self.slice(0, n) if n else self.rows()

    def page(self, size: int = 5, offset: int = 0) -> Page:
        """Rows [offset, offset + size) in order, and the number of all rows."""
        return Page(self.slice(offset, size).orderBy(ORD), self.total())

"""Following text files that grow: a stream source of new whole lines, resumed by byte offset.

`spark.readStream.format("growing_lines")` watches a folder. A batch covers, for every file, the bytes from where the last
batch ended up to the last line end there is now; a line still being written waits. Large stretches are cut into byte
ranges of which each is one task, and a line belongs to the range in which it begins, so the same batch read twice gives
the same rows. Offsets are part of the stream's checkpoint.

The driver lists the folder and looks at the last bytes of files that grew; lines are read in tasks only. Files are reached
through pyarrow, which knows local and shared paths, HDFS and object stores.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from pairloom.streaming.progress import EVENT_SCHEMA, parse_events

SCHEMA = "path string, offset bigint, value string"
MAX_FILES = 100_000    # files of one stream: each has an offset in every batch's checkpoint
RANGE = 64 << 20       # bytes of one task
BLOCK = 1 << 16        # bytes looked at or read at once
ROWS = 8192            # lines handed to Spark at once


def _last_end(file: pa.NativeFile, low: int, high: int) -> int:
    """The byte behind the last line end in [low, high), `low` if there is none."""
    while high > low:
        start = max(low, high - BLOCK)
        file.seek(start)
        at = file.read(high - start).rfind(b"\n")
        if at >= 0:
            return start + at + 1
        high = start
    return low


def _lines(file: pa.NativeFile, first: int, start: int, stop: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of lines that begin in [start, stop), of text whose lines begin at `first` and end at `end`."""
    at = start
    if start > first:   # the line that reaches into this range belongs to the one before
        file.seek(start - 1)
        at = start - 1
        while at < stop:
            found = file.read(min(BLOCK, end - at))
            i = found.find(b"\n")
            if i >= 0:
                at += i + 1
                break
            if not found:
                return
            at += len(found)
    file.seek(at)
    rest, position = b"", at
    while at < stop:
        block = file.read(min(BLOCK, end - position))
        if not block:
            return
        position += len(block)
        *whole, rest = (rest + block).split(b"\n")
        for line in whole:
            if at >= stop:
                return
            yield at, line
            at += len(line) + 1


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Range(InputPartition):
    def __init__(self, path: str, first: int, start: int, stop: int, end: int):
        self.path, self.first, self.start, self.stop, self.end = path, first, start, stop, end


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.suffix = options["path"], options.get("suffix", "")
        self.range, self.most = int(options.get("rangebytes", RANGE)), int(options.get("maxfiles", MAX_FILES))

    def _files(self) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
        system, root = open_folder(self.root)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        files = [f for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix)
                 and not f.base_name.startswith((".", "_"))]
        if len(files) > self.most:
            raise ValueError(f"more than {self.most} growing files in one stream; move finished ones away or use several streams")
        return system, files

    def initialOffset(self) -> dict[str, Any]:
        return {"ends": "{}"}

    def latestOffset(self) -> dict[str, Any]:
        """The last line end of every file. `seen` remembers where it was looked for, so that only files that grew are opened."""
        system, files = self._files()
        before, ends = getattr(self, "seen", {}), {}
        for f in sorted(files, key=lambda f: f.path):
            size, end = before.get(f.path, (0, 0))
            if f.size < size:
                size, end = 0, 0
            if f.size > size:
                with system.open_input_file(f.path) as file:
                    end = _last_end(file, end, f.size)
            before[f.path] = (f.size, end)
            if end:
                ends[f.path] = end
        self.seen = {p: v for p, v in before.items() if p in {f.path for f in files}}
        return {"ends": json.dumps(ends)}

    def partitions(self, start: dict[str, Any], end: dict[str, Any]) -> list[Range]:
        """Byte ranges of what is new. A file that became shorter was written anew and is read from its start."""
        before, out = json.loads(start["ends"]), []
        for path, stop in json.loads(end["ends"]).items():
            first = before.get(path, 0)
            first = 0 if first > stop else first
            out += [Range(path, first, a, min(a + self.range, stop), stop) for a in range(first, stop, self.range)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(self.root)
        with system.open_input_file(partition.path) as file:
            offsets, values = [], []
            for at, line in _lines(file, partition.first, partition.start, partition.stop, partition.end):
                offsets.append(at)
                values.append(line.decode("utf-8", "replace"))
                if len(offsets) == ROWS:
                    yield self._batch(partition.path, offsets, values)
                    offsets, values = [], []
            if offsets:
                yield self._batch(partition.path, offsets, values)

    @staticmethod
    def _batch(path: str, offsets: list[int], values: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path] * len(offsets)), pa.array(offsets, pa.int64()), pa.array(values)], ["path", "offset", "value"])


class GrowingLines(DataSource):
    """Options: `path` (a folder), `suffix` of the files to follow, `rangebytes` for each task, `maxfiles`."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: T.StructType) -> GrowingReader:
        return GrowingReader(dict(self.options))


def tail_lines(spark: SparkSession, path: str, suffix: str = "", range_bytes: int = RANGE) -> DataFrame:
    """New whole lines of the files below `path` as a stream of (path, offset, value)."""
    spark.dataSource.register(GrowingLines)
    return (spark.readStream.format("growing_lines").option("path", path).option("suffix", suffix)
            .option("rangebytes", range_bytes).load())


def tail_growing_events(spark: SparkSession, path: str, suffix: str = ".jsonl", schema: str = EVENT_SCHEMA) -> DataFrame:
    """Progress events of files that runs keep appending to; blank and broken lines are skipped.

    `job_id` comes from the events when the schema has it, else from the name of the file's folder. `_file` and `_at` tell
    the file and byte at which an event's line begins, in the order in which a run wrote.
    """
    lines = tail_lines(spark, path, suffix).select("value", F.col("path").alias("_file"), F.col("offset").alias("_at"))
    if "job_id" in T.StructType.fromDDL(schema).names:
        return parse_events(lines, ["_file", "_at"], schema)
    job = F.regexp_extract("_file", r"([^/]+)/[^/]*$", 1)
    return parse_events(lines.withColumn("job_id", job), ["job_id", "_file", "_at"], schema)

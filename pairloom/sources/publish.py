"""Replacing a file or folder by a new version of itself: written aside, one backup, moved into place.

Until the move the old version stays as it is. A file is replaced in one step. A folder is moved aside first; if the move
of the new one fails, the old one is moved back, and `recover` does the same after a driver that died in between.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

ONE_FILE = 1 << 30   # bytes: up to this size a single file stays a single file


class Place:
    """A path on the file system that Spark would use for it."""

    def __init__(self, spark: SparkSession, path: str):
        hadoop = spark._jvm.org.apache.hadoop.fs
        self.spark, self.name = spark, path.rstrip("/")
        self.path = hadoop.Path(self.name)
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def beside(self, ending: str) -> "Place":
        return Place(self.spark, f"{self.name}{ending}")

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def is_file(self) -> bool:
        return self.exists() and self.fs.getFileStatus(self.path).isFile()

    def size(self) -> int:
        return self.fs.getContentSummary(self.path).getLength()

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def move(self, to: "Place") -> None:
        if not self.fs.rename(self.path, to.path):
            raise OSError(f"{self.name} could not be moved to {to.name}")

    def copy(self, to: "Place") -> None:
        conf = self.spark._jsc.hadoopConfiguration()
        if not self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self.path, to.fs, to.path, False, conf):
            raise OSError(f"{self.name} could not be copied to {to.name}")

    def replace(self, file: "Place") -> None:
        """Take a file's place, in one step where the file system can."""
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        kinds = self.spark.sparkContext._gateway.new_array(options, 1)
        kinds[0] = options.OVERWRITE
        conf = self.spark._jsc.hadoopConfiguration()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        context.rename(file.fs.makeQualified(file.path), self.fs.makeQualified(self.path), kinds)

    def only_part(self) -> "Place":
        """The one part file of a written folder."""
        parts = [s.getPath().toString() for s in self.fs.listStatus(self.path) if re.match(r"part-", s.getPath().getName())]
        if len(parts) != 1:
            raise OSError(f"{self.name} holds {len(parts)} part files instead of one")
        return Place(self.spark, parts[0])


def recover(spark: SparkSession, path: str) -> bool:
    """Bring back a folder that was moved aside for a new version that never came; whether there was one."""
    place = Place(spark, path)
    if place.exists():
        return False
    parent = place.path.getParent()
    if not place.fs.exists(parent):
        return False
    name = place.path.getName()
    asides = [s.getPath().toString() for s in place.fs.listStatus(parent) if s.getPath().getName().startswith(f"{name}.old-")]
    backup = place.beside(".bak")
    if asides:
        Place(spark, asides[0]).move(place)
    elif backup.exists():
        backup.copy(place)
    return place.exists()


def replace_path(spark: SparkSession, path: str, write: Callable[[str, bool], None], check: Callable[[str], None] = lambda _: None) -> str:
    """Replace what lies at `path` by what `write(new path, as one file)` writes as a folder; returns the backup's path.

    The first time, the original is kept as `path.bak`; later versions leave that backup alone. `check` may look at the
    new folder and raise. A file of moderate size stays a file: its new version has to be written as one part.
    """
    place = Place(spark, path)
    recover(spark, path)
    if not place.exists():
        raise FileNotFoundError(f"nothing to replace at {path}")
    token = uuid.uuid4().hex
    new, backup = place.beside(f".tmp-{token}"), place.beside(".bak")
    one = place.is_file() and place.size() <= ONE_FILE
    try:
        write(new.name, one)
        check(new.name)
        if one:
            if not backup.exists():
                half = place.beside(f".bak-{token}")
                place.copy(half)
                half.move(backup)   # whole or not at all
            place.replace(new.only_part())
            return backup.name
        first = not backup.exists()
        old = backup if first else place.beside(f".old-{token}")
        place.move(old)
        try:
            new.move(place)
        except Exception:
            old.move(place)
            raise
        if not first:
            old.delete()
        return backup.name
    finally:
        new.delete()

"""Readers. Every table read here carries `_ord`, a unique long that follows file and row order."""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators.order import INTERNAL, ORD
from pairloom.session import scratch_path, stage
from pairloom.sources.files import FileRanks, FileTable, text_ordinal
from pairloom.sources.records import read_array, read_quoted_csv, spans_lines
from pairloom.sources.spec import SourceSpec, SpecError, infer_format

def with_ordinal(df: DataFrame, row_index: bool = False, lineage: bool = False) -> DataFrame:
    """Add `_ord` to a table straight above its scan: by file path, then by place in the file.

    Parquet knows each row's index in its file. Text formats are numbered by input split and row; how a file is split
    depends on the cores at hand and may change from job to job, so text tables are landed as Parquet with their
    ordinals: every later pass sees the same ones, and text is parsed once. `lineage` keeps the path of each row's file
    as `_file`.
    """
    if row_index:
        return FileTable(df).rows(lineage)
    return stage(text_ordinal(df, lineage), scratch_path(df.sparkSession, "landed"))


def _first_line(spark: SparkSession, path: str) -> str:
    """The first line of the first file by path."""
    lines = spark.read.text(path)
    ranks = FileRanks(lines)
    first = ranks.ranked(lines, F.col("_metadata.file_block_start").alias("_start")).where("_rank = 0 and _start = 0").limit(1).collect()
    return first[0]["value"].strip() if first else ""


def is_json_lines(spark: SparkSession, path: str) -> bool:
    """A JSON file is line-delimited when its first line is a whole JSON value."""
    try:
        json.loads(_first_line(spark, path))
    except ValueError:
        return False
    return True


def _parse_mode(on_error: str) -> dict[str, str]:
    modes = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "quarantine": "PERMISSIVE"}
    if on_error not in modes:
        raise ValueError(f"on_error is one of {sorted(modes)}")
    return {"mode": modes[on_error], **({"columnNameOfCorruptRecord": "_error"} if on_error == "quarantine" else {})}


def _read_text(reader, kind: str, path: str, schema: str | T.StructType | None, options: dict[str, Any]) -> DataFrame:
    """A text table; the column for broken records is part of the schema, whether or not there are any."""
    if options.get("columnNameOfCorruptRecord") == "_error":
        known = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        known = known or reader.options(**options).format(kind).load(path).schema
        known = T.StructType([f for f in known.fields if f.name != "_error"] + [T.StructField("_error", T.StringType())])
        reader = reader.schema(known)
    try:
        return reader.options(**options).format(kind).load(path)
    except Py4JJavaError as e:   # raised while the schema is inferred
        if "MALFORMED_RECORD" in str(e):
            raise ValueError(f"text that does not parse in {path}") from e
        raise


def _scan(spark: SparkSession, path: str, kind: str, schema: str | T.StructType | None, on_error: str, options: dict[str, Any]) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        if kind == "parquet":
            return reader.options(**options).parquet(path)
        options = {**_parse_mode(on_error), **options}
        if kind == "csv":
            return _read_text(reader, "csv", path, schema, {"header": True, "multiLine": True, "escape": '"', **options})
        lines = kind == "jsonl" or is_json_lines(spark, path)
        return _read_text(reader, "json", path, schema, {"multiLine": not lines, **options})
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no such dataset file: {path}") from e
        raise


def _can_be_split(spark: SparkSession, path: str) -> bool:
    """Whether a file is larger than what one task reads at once; smaller ones are one task's each in any case."""
    size = spark.conf.get("spark.sql.files.maxPartitionBytes", "128m").lower().rstrip("b")
    limit = int(size[:-1]) << {"k": 10, "m": 20, "g": 30, "t": 40}[size[-1]] if size[-1:].isalpha() else int(size)
    try:   # lengths come from the listing
        return not spark.read.format("binaryFile").load(path).where(F.col("length") > limit).select("length").limit(1).isEmpty()
    except AnalysisException:
        return False   # nothing there: the reader says so


def read_file(spark: SparkSession, path: str, file_format: str | None = None,
              schema: str | T.StructType | None = None, ordinal: bool = True, lineage: bool = False,
              on_error: str = "fail", **options: Any) -> DataFrame:
    """Read JSON, JSON Lines, CSV or Parquet; the format follows the file ending unless named.

    `schema` skips inference, which costs a pass over text files. CSV files too large for one task are read in splits even
    where quoted fields hold line breaks, as long as quotes stand around whole fields, and so are JSON files that each
    hold one array of objects; otherwise, or with `multiLine=True`, a file is one task's.
    `lineage` adds each row's `_file`.
    Of text that does not parse, `on_error` says what becomes: `fail` stops the job, `drop` leaves it out, `quarantine`
    keeps the text in `_error`, beside what could be read of it.
    """
    kind = infer_format(path, file_format)
    split = ordinal and kind in ("json", "csv") and "multiLine" not in options and _can_be_split(spark, path)
    if split and kind == "json" and not is_json_lines(spark, path):
        if (rows := read_array(spark, path, schema, {**_parse_mode(on_error), **options}, lineage)) is not None:
            return rows
    df = _scan(spark, path, kind, schema, on_error, options)
    if not ordinal:
        return df
    if split and kind == "csv":
        csv = {"header": True, "escape": '"', **_parse_mode(on_error), **options}
        if not spans_lines(spark, path):   # every record is a line
            df = _scan(spark, path, kind, df.schema, on_error, {**options, "multiLine": False})
        elif (rows := read_quoted_csv(spark, path, df.schema, csv, lineage)) is not None:
            return rows
    return with_ordinal(df, kind == "parquet", lineage)


def open_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None, **options: Any) -> FileTable:
    """A Parquet source as a table of files, for heads and pages that open only the files they need."""
    return FileTable(_scan(spark, path, "parquet", schema, "fail", options))


def named_path(root: str, repo_id: str, split: str = "train", config_name: str | None = None) -> str:
    """Where an exported dataset keeps a split; an empty config means the one called `default`."""
    return f"{root.rstrip('/')}/{repo_id}/{config_name or 'default'}/{split}-*.parquet"


def read_named(spark: SparkSession, root: str, repo_id: str, split: str = "train", config_name: str | None = None,
               schema: str | T.StructType | None = None) -> DataFrame:
    """A split of a named dataset exported as `{root}/{repo}/{config}/{split}-*.parquet`."""
    return read_file(spark, named_path(root, repo_id, split, config_name), "parquet", schema)


def read_bounded(spark: SparkSession, root: str, repo_id: str, split: str = "train", config_name: str | None = None,
                 max_samples: int | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """The first `max_samples` rows of a split in file order, all of them for a falsy bound; no rows are an error.

    Only the files that hold those rows are opened, one path for every bound.
    """
    files = open_table(spark, named_path(root, repo_id, split, config_name), schema)
    if files.is_empty():
        raise ValueError(f"dataset {repo_id!r} (split {split}) has no rows")
    return files.head(max_samples)


def stream_named(spark: SparkSession, root: str, repo_id: str, schema: str | T.StructType, split: str = "train",
                 config_name: str | None = None, files_per_batch: int = 64) -> DataFrame:
    """The same split as a stream, a bounded number of files at a time."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return stream.parquet(named_path(root, repo_id, split, config_name))


def read_source(spark: SparkSession, spec: SourceSpec | Mapping[str, Any], hub_root: str | None = None,
                uploads: Mapping[str, str] | None = None, max_samples: int | None = None,
                schema: str | T.StructType | None = None) -> DataFrame:
    """Read what a source spec describes. `uploads` maps upload ids to the paths they landed at."""
    spec = SourceSpec.of(spec)
    schema = schema or spec.schema
    if spec.source_type == "local_file":
        return read_file(spark, spec.file_path, spec.file_format, schema, on_error=spec.on_error, **spec.options)
    if spec.source_type == "upload":
        landed = (uploads or {}).get(spec.dataset_id)
        if landed is None:
            raise SpecError(f"upload {spec.dataset_id!r} not found")
        return read_file(spark, landed, spec.file_format, schema, on_error=spec.on_error, **spec.options)
    if hub_root is None:
        raise SpecError("a named dataset needs hub_root, the folder of the exported datasets")
    where = (hub_root, spec.repo_id, spec.split, spec.config_name)
    return read_bounded(spark, *where, max_samples, schema) if spec.streaming else read_named(spark, *where, schema)


def open_source(spark: SparkSession, spec: SourceSpec | Mapping[str, Any], hub_root: str | None = None,
                uploads: Mapping[str, str] | None = None, schema: str | T.StructType | None = None) -> FileTable | None:
    """What a source spec describes as a table of files, if it is Parquet read without a bound."""
    spec = SourceSpec.of(spec)
    schema = schema or spec.schema
    if spec.source_type == "huggingface":
        return hub_root and open_table(spark, named_path(hub_root, spec.repo_id, spec.split, spec.config_name), schema)
    path = spec.file_path if spec.source_type == "local_file" else (uploads or {}).get(spec.dataset_id)
    if path is None or infer_format(path, spec.file_format) != "parquet":
        return None
    return open_table(spark, path, schema, **spec.options)


def inspect_columns(table: DataFrame | FileTable, samples: int = 3, ord: str = ORD) -> dict[str, Any]:
    """Column names, the first rows and the row count, for mapping columns by hand.

    Of a table of files only those are opened that hold the samples; its rows are counted by their footers.
    """
    if isinstance(table, FileTable):
        df, total = table.head(samples), table.total()
    else:
        df, total = table, table.count()
    shown = [c for c in df.columns if c not in INTERNAL]
    first = df.orderBy(ord).limit(samples) if ord in df.columns else df.limit(samples)
    rows = [r.asDict(recursive=True) for r in first.select(*shown).collect()]
    return {"columns": shown, "samples": rows, "total_rows": total}

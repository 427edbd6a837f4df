"""Edits to a manifest: new captions and deletions by row number, every other field untouched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.vision import parse_object, read_lines
from pairloom.sources.publish import recover, replace_path


def set_json_field(line: Column, field: str, value: Column) -> Column:
    """The JSON object with one text field set, in its place if it was there, else at the end.

    A line that is no JSON object comes back as it is.
    """
    row = parse_object(line)
    new = value.cast("variant")
    replaced = F.transform_values(row, lambda k, v: F.when(k == field, new).otherwise(v))
    extended = F.map_concat(row, F.create_map(F.lit(field), new))
    edited = F.when(F.map_contains_key(row, field), replaced).otherwise(extended)
    return F.when(row.isNull(), line).otherwise(F.to_json(edited))


def last_edits(edits: DataFrame, value: str = "prompt", row: str = "row_index", ord: str = "edit") -> DataFrame:
    """One edit per row as (row, _new): the last by the edits' own ordinal `ord`, or else by their place in the table."""
    at = F.col(ord) if ord in edits.columns else F.monotonically_increasing_id()
    placed = edits.select(F.col(row), F.struct(F.col(value).alias("v")).alias("_v"), at.alias("_at"))
    return placed.groupBy(row).agg(F.max_by("_v", "_at")["v"].alias("_new"))


def edit_values(df: DataFrame, edits: DataFrame, column: str, value: str = "prompt", row: str = "row_index") -> DataFrame:
    """Overwrite one column of the rows listed in `edits`; the last edit of a row counts."""
    changes = last_edits(edits, value, row)
    return (df.join(changes, row, "left")
            .withColumn(column, F.coalesce(F.col("_new"), F.col(column))).drop("_new"))


def delete_rows(df: DataFrame, deletes: DataFrame, row: str = "row_index") -> DataFrame:
    """Rows whose number is not listed."""
    return df.join(deletes.select(row), row, "left_anti")


def apply_edits(lines: DataFrame, edits: DataFrame, deletes: DataFrame, caption_column: str | None = None) -> DataFrame:
    """Lines after deletions and caption edits, with `edited` marking the ones that changed.

    `edits` is (row_index, prompt), perhaps with an ordinal `edit`, `deletes` is (row_index); the last edit of a row
    counts, and an edit of a deleted row is lost.
    """
    changes = last_edits(edits)
    kept = delete_rows(lines, deletes).join(changes, "row_index", "left")
    row_ok = parse_object(F.col("line")).isNotNull()
    hit = F.col("_new").isNotNull()
    return (kept.withColumn("edited", hit & row_ok)
            .withColumn("line", F.when(hit, set_json_field(F.col("line"), caption_column or "prompt", F.col("_new")))
                        .otherwise(F.col("line")))
            .drop("_new"))


def edit_report(lines: DataFrame, edits: DataFrame, deletes: DataFrame) -> DataFrame:
    """One row: lines before and after, edited lines, listed deletions."""
    gone = deletes.select("row_index").distinct()
    marked = (lines.join(gone.withColumn("_gone", F.lit(True)), "row_index", "left")
              .join(last_edits(edits).select("row_index", F.col("_new").isNotNull().alias("_hit")), "row_index", "left"))
    stays = F.col("_gone").isNull()
    changed = stays & F.coalesce("_hit", F.lit(False)) & parse_object(F.col("line")).isNotNull()
    seen = marked.select(F.lit(1).alias("b"), stays.cast("int").alias("a"), changed.cast("int").alias("e"), F.lit(0).alias("d"))
    listed = gone.select(F.lit(0), F.lit(0), F.lit(0), F.lit(1))
    names = {"b": "total_before", "a": "total_after", "e": "edited", "d": "deleted"}
    return seen.unionAll(listed).agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(v) for k, v in names.items()])


def rewrite_manifest(spark: SparkSession, path: str, out_path: str, edits: DataFrame, deletes: DataFrame,
                     caption_column: str | None = None) -> DataFrame:
    """Write the edited manifest to a new path, in row order, and report; the original stays as backup."""
    lines = read_lines(spark, path)
    edited = apply_edits(lines, edits, deletes, caption_column)
    edited.orderBy("row_index").select("line").write.mode("errorifexists").text(out_path)
    return edit_report(lines, edits, deletes)


def rewrite_in_place(spark: SparkSession, path: str, edits: DataFrame, deletes: DataFrame, caption_column: str | None = None) -> DataFrame:
    """Replace a manifest (a file or a folder of text files) by its edited version, and report.

    The new version is written beside it and moved into place once its number of lines is right; the first edit leaves the
    original as `path.bak`. A write that fails leaves the manifest as it was. Lines are written in row order, by many
    tasks into a folder of the manifest's name, or by one task where the manifest is a file of up to a gigabyte.
    """
    recover(spark, path)
    lines = read_lines(spark, path)
    report = edit_report(lines, edits, deletes)
    edited = apply_edits(lines, edits, deletes, caption_column).select("row_index", "line")

    def write(to: str, one: bool) -> None:
        ordered = edited.coalesce(1).sortWithinPartitions("row_index") if one else edited.orderBy("row_index")
        ordered.select("line").write.text(to)

    def check(written: str) -> None:
        wanted, found = report.first()["total_after"], spark.read.text(written).count()
        if wanted != found:
            raise ValueError(f"{found} lines were written instead of {wanted}")

    replace_path(spark, path, write, check)
    return report

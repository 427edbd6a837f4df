"""Image-caption tables: manifests, image folders, and the multimodal message form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pairloom.functions.text import caption_from_path, file_name, strip
from pairloom.operators.order import ORD, Page
from pairloom.operators.quality import filter_long
from pairloom.operators.split import sample_rows, split_if_large
from pairloom.session import scratch_path, small_side, stage
from pairloom.sources.files import PLACE_BITS
from pairloom.sources.read import read_file

# The image endings that count, and the keys an image or a caption is looked up under.
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "webp", "gif", "bmp")
IMAGE_KEYS = ("image", "chosen", "rejected")
CAPTION_KEYS = ("prompt", "caption")


def local_path(uri: Column) -> Column:
    """A file path without the `file:` scheme; other schemes stay."""
    return F.url_decode(F.regexp_replace(F.regexp_replace(uri, r"^file:(//)?", ""), r"\+", "%2B"))


def parent_dir(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def normal_path(path: Column) -> Column:
    """The path with `.` and `..` steps taken."""
    def step(done: Column, part: Column) -> Column:
        return (F.when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
                .when(part.isin(".", ""), done).otherwise(F.array_append(done, part)))
    none = F.array().cast("array<string>")
    steps = F.aggregate(F.split(path, "/"), none, step)
    return F.when(path.rlike(r"/\.{0,2}(/|$)"), F.concat(F.lit("/"), F.array_join(steps, "/"))).otherwise(path)


def resolve_path(path: Column, base: Column) -> Column:
    """An absolute path as it is, a relative one below `base`; URIs with a scheme stay untouched."""
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(base, F.lit("/"), path))
    return F.when(path.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), path).otherwise(normal_path(joined))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The non-blank lines of text files as (row_index, line, base): numbered from 0 in file order.

    Each input split reports how many lines it holds; the splits before it give its first number.
    The lines are landed first, as splits may differ between jobs. `base` is the folder of the file.
    """
    mask = F.lit(2**PLACE_BITS - 1)
    lines = (spark.read.text(path)
             .select(F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_s"),
                     strip(F.col("value")).alias("line"))
             .where(F.col("line") != "")
             .withColumn("_n", F.monotonically_increasing_id().bitwiseAND(mask)))
    lines = stage(lines, scratch_path(spark, "lines"))
    splits = lines.groupBy("_f", "_s").agg(F.min("_n").alias("_low"), F.count("*").alias("_rows"))
    earlier = Window.orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1)  # one row per input split
    starts = splits.select("_f", "_s", "_low", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_start"))
    return (lines.join(small_side(starts), ["_f", "_s"])
            .select((F.col("_start") + F.col("_n") - F.col("_low")).alias("row_index"), "line",
                    parent_dir(local_path(F.col("_f"))).alias("base")))


def parse_object(line: Column) -> Column:
    """A JSON object as a map of its fields; null when the line is not one."""
    return F.from_json(line, "map<string,variant>")


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"


def preview_manifest(lines: DataFrame, limit: int = 24, offset: int = 0, image_column: str | None = None,
                     caption_column: str | None = None) -> DataFrame:
    """The first `limit` readable rows from row `offset` on: index, image path, caption, and which keys held them.

    The image is the first key with a text value, the caption the first key that is present.
    Malformed lines and lines without an image keep their index but are not shown.
    """
    limit, offset = max(1, limit), max(0, offset)
    images = (image_column,) if image_column else IMAGE_KEYS
    captions = (caption_column,) if caption_column else CAPTION_KEYS
    row = F.col("_row")
    image_field = F.coalesce(*[F.when(_is_text(row[k]), F.lit(k)) for k in images])
    caption_field = F.coalesce(*[F.when(F.map_contains_key(row, k), F.lit(k)) for k in captions])
    found = (lines.where(F.col("row_index") >= offset)
             .select("row_index", "base", parse_object(F.col("line")).alias("_row"))
             .where(row.isNotNull())
             .withColumns({"image_field": image_field, "caption_field": caption_field})
             .where(F.col("image_field").isNotNull()))
    text = F.coalesce(F.variant_get(row[F.col("caption_field")], "$", "string"), F.lit(""))
    return (found.select("row_index", text.alias("prompt"),
                         resolve_path(F.variant_get(row[F.col("image_field")], "$", "string"), F.col("base")).alias("image_path"),
                         "image_field", "caption_field")
            .orderBy("row_index").limit(limit))


def manifest_page(lines: DataFrame, limit: int = 24, offset: int = 0, **columns: str | None) -> Page:
    """A preview and the number of all rows of the manifest, unreadable ones included."""
    return Page(preview_manifest(lines, limit, offset, **columns), lines.count())


def read_manifest(spark: SparkSession, path: str, schema: str | T.StructType | None = None, on_error: str = "fail") -> DataFrame:
    """An image manifest (JSON Lines) with its image paths resolved against the manifest's folder."""
    df = read_file(spark, path, "jsonl", schema, lineage=True, on_error=on_error)
    base = parent_dir(local_path(F.col("_file")))
    resolved = {k: resolve_path(F.col(k), base) for k in IMAGE_KEYS
                if k in df.columns and isinstance(df.schema[k].dataType, T.StringType)}
    return canonical_columns(df.withColumns(resolved) if resolved else df).drop("_file")


def canonical_columns(df: DataFrame) -> DataFrame:
    """`chosen` falls back to `image` and `prompt` to `caption`, per row where both columns exist."""
    for target, source in (("chosen", "image"), ("prompt", "caption")):
        if source in df.columns:
            value = F.coalesce(F.col(target), F.col(source)) if target in df.columns else F.col(source)
            df = df.withColumn(target, value)
    return df


def is_image(path: Column) -> Column:
    return F.lower(path).rlike(rf"\.({'|'.join(IMAGE_ENDINGS)})$")


def read_image_dir(spark: SparkSession, path: str, with_bytes: bool = False) -> DataFrame:
    """The images of a folder as (image, caption); the caption is the same-stem `.txt` file, if any.

    Image bytes are read only on request. Files are joined to their sidecars on the path without
    its ending, which is unique on the sidecar side.
    """
    files = spark.read.format("binaryFile").load(path).where(is_image(F.col("path")))
    image = local_path(F.col("path"))
    images = files.select(image.alias("image"), _without_ending(image).alias("_stem"), *(["content"] if with_bytes else []))
    texts = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(
        _without_ending(local_path(F.col("_metadata.file_path"))).alias("_stem"), strip(F.col("value")).alias("_text"))
    return (images.join(texts, "_stem", "left")
            .withColumn("caption", F.coalesce(F.col("_text"), F.lit(""))).drop("_stem", "_text"))


def _without_ending(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def build_manifest(files: DataFrame, captions: DataFrame | None = None, path: str = "path") -> DataFrame:
    """(image, prompt) rows: a caption by full or by base file name, else one made of the file stem.

    `captions` has one row per name: (name, caption).
    """
    rows = files.withColumn("_base", file_name(F.col(path)))
    given = F.lit(None).cast("string")
    if captions is not None:
        by_path = captions.select(F.col("name").alias(path), F.col("caption").alias("_by_path"))
        by_base = captions.select(F.col("name").alias("_base"), F.col("caption").alias("_by_base"))
        rows = rows.join(by_path, path, "left").join(by_base, "_base", "left")
        given = F.coalesce(F.nullif("_by_path", F.lit("")), F.nullif("_by_base", F.lit("")))
    return rows.where(F.col("_base") != "").select(
        F.col(path).alias("image"), F.coalesce(given, caption_from_path(F.col("_base"))).alias("prompt"))


def caption_messages(df: DataFrame, instruction: str, image: str = "image", caption: str = "caption") -> DataFrame:
    """Image-caption rows as {images, messages}: the user shows the image and asks, the assistant captions.

    A message has typed `parts` or a plain text `content`.
    """
    part = "struct<type:string,text:string>"
    parts = F.array(F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text")),
                    F.struct(F.lit("text").alias("type"), F.lit(instruction).alias("text")))
    user = F.struct(F.lit("user").alias("role"), F.lit(None).cast("string").alias("content"), parts.alias("parts"))
    assistant = F.struct(F.lit("assistant").alias("role"), F.col(caption).cast("string").alias("content"),
                         F.lit(None).cast(f"array<{part}>").alias("parts"))
    keep = [c for c in df.columns if c not in (image, caption)]
    return df.select(*keep, F.array(F.col(image)).alias("images"), F.array(user, assistant).alias("messages"))


def unified_messages(df: DataFrame, image: str = "image", messages: str = "messages") -> DataFrame:
    """Rows of a mixed corpus as {images, messages}: JSON text parsed, no image gives an empty list.

    Contents stay variants, since they are either text or a list of typed parts.
    """
    out = df
    if df.schema[messages].dataType.typeName() == "string":
        out = out.withColumn(messages, F.from_json(F.col(messages), "array<struct<role:string,content:variant>>"))
    images = F.array_compact(F.array(F.col(image))) if image in df.columns else F.array().cast("array<binary>")
    return out.withColumn("images", images).drop(*([image] if image != "images" else []))


def prepare_captions(df: DataFrame, instruction: str, max_samples: int | None = None, test_size: float | None = None,
                     seed: int = 42, image: str = "image", caption: str = "caption",
                     ord: str = ORD, more_than: int = 1) -> tuple[DataFrame, DataFrame | None]:
    """An image-caption corpus bounded to its first rows, split if it has more than `more_than` rows, in message form."""
    from pairloom.operators.order import head

    rows = head(df.select(ord, image, caption), max_samples, ord)
    return _each_side(split_if_large(rows, test_size, seed, more_than, ord),
                      lambda d: caption_messages(d, instruction, image, caption))


def prepare_unified(df: DataFrame, max_seq_length: int = 4096, max_samples: int | None = None,
                    test_size: float | None = None, seed: int = 42, image: str = "image",
                    ord: str = ORD, more_than: int = 1) -> tuple[DataFrame, DataFrame | None]:
    """A mixed corpus without over-long rows, sampled and split, in message form.

    The kept rows are written once; sample and split look their places up there.
    """
    rows = filter_long(df, max_seq_length)
    rows = sample_rows(stage(rows, scratch_path(rows.sparkSession, "unified")), max_samples, seed, ord)
    return _each_side(split_if_large(rows, test_size, seed, more_than, ord), lambda d: unified_messages(d, image))


def _each_side(sides, shape):
    train, evaluation = sides
    return shape(train), None if evaluation is None else shape(evaluation)

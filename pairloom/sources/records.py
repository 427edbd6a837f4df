"""Records of text files that span lines, found without giving a whole file to one task.

Lines are read in splits like any text. Whether a line break ends a record depends on what comes before it in the file:
that is a running count over lines, taken in blocks, so it is shared out over tasks as well.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators.order import ORD, running_before
from pairloom.session import cut_lineage, scratch_path, stage
from pairloom.sources.files import text_ordinal

BLOCK = 1 << 20    # ordinals (bytes, for text) of one block of lines
MARK_ORD = "_pairloom_ord"   # the field of a JSON line that carries an object's ordinal
PLAIN = {"header", "sep", "delimiter", "nullValue", "emptyValue", "mode", "columnNameOfCorruptRecord", "escape", "multiLine", "inferSchema",
         "dateFormat", "timestampFormat", "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace"}   # options that leave lines and quotes alone


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines cut at line feeds only, so that a carriage return within a field stays."""
    return spark.read.option("lineSep", "\n").text(path)


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def _well_quoted(record: Column, sep: str) -> Column:
    """Whether quotes stand only around whole fields, and doubled within them."""
    left = F.regexp_replace(F.replace(record, F.lit('""'), F.lit("")), '"[^"]*"', "\u0001")
    sep = f"\\x{ord(sep):02x}"
    return ~left.contains('"') & ~left.rlike(f"[^{sep}]\u0001|\u0001[^{sep}]")


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a line of the files holds an odd number of quotes, as one does where a field goes on in the next line."""
    return not _lines(spark, path).where(_quotes(F.col("value")) % 2 == 1).limit(1).isEmpty()


def quoted_records(spark: SparkSession, path: str, sep: str = ",") -> DataFrame | None:
    """CSV records (value, _ord, _file), some over several lines; None if quotes are not used that way throughout.

    A line begins a record if an even number of quotes stand before it in its file. Records on one line are done; the
    lines of the others are numbered by how many such records begin up to them, and joined. Ordinals are those of the
    records' first lines; blank lines between records are left out.
    """
    scan = _lines(spark, path)
    odd = _quotes(F.col("value")) % 2
    lines = stage(text_ordinal(scan, lineage=True).withColumn("_odd", odd.cast("long")), scratch_path(spark, "lines"))
    counted = running_before(lines, F.col("_odd"), ["_file"], ORD, "_before", F.sum, BLOCK)
    begins = F.col("_before") % 2 == 0
    marked = stage(counted.select("value", ORD, "_file", begins.alias("_begins"), (begins & (F.col("_odd") == 0)).alias("_whole")), scratch_path(spark, "marked"))
    whole = marked.where("_whole").where(F.trim(F.regexp_replace("value", "\r$", "")) != "").select(F.regexp_replace("value", "\r$", "").alias("value"), ORD, "_file")
    parts = marked.where("NOT _whole")
    numbered = running_before(parts, F.col("_begins").cast("long"), ["_file"], ORD, "_earlier", F.sum, BLOCK)
    record = F.col("_earlier") + F.col("_begins").cast("long")
    joined = (numbered.groupBy("_file", record.alias("_record"))
              .agg(F.array_sort(F.collect_list(F.struct(F.col(ORD).alias("o"), F.col("value").alias("v")))).alias("l"))
              .select(F.regexp_replace(F.array_join("l.v", "\n"), "\r$", "").alias("value"), F.element_at("l.o", 1).alias(ORD), "_file"))
    records = cut_lineage(whole.unionByName(joined))
    return records if records.where(~_well_quoted(F.col("value"), sep)).limit(1).isEmpty() else None


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType, options: dict[str, Any], lineage: bool = False) -> DataFrame | None:
    """CSV with line breaks in quotes over many tasks, landed as Parquet with `_ord`; None where that cannot be done.

    That is where options change what ends a line or a field, or where quotes are used in another way.
    """
    sep = options.get("sep", options.get("delimiter", ","))
    if not set(options) <= PLAIN or len(sep) != 1 or options.get("escape") != '"':
        return None
    records = quoted_records(spark, path, sep)
    if records is None:
        return None
    if str(options.get("header", "")).lower() == "true":
        records = records.join(F.broadcast(records.groupBy("_file").agg(F.min(ORD).alias("_head"))), "_file").where(F.col(ORD) > F.col("_head")).drop("_head")
    broken = options.get("columnNameOfCorruptRecord", "_broken")
    mode = options.get("mode", "PERMISSIVE")
    known = schema if broken in schema.names else T.StructType([*schema.fields, T.StructField(broken, T.StringType())])
    asked = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if k not in ("header", "mode", "inferSchema")}
    asked |= {"multiLine": "true", "mode": "FAILFAST" if mode == "FAILFAST" else "PERMISSIVE", "columnNameOfCorruptRecord": broken}
    rows = records.select(F.from_csv("value", (schema if mode == "FAILFAST" else known).toDDL(), asked).alias("_r"), ORD, *(["_file"] if lineage else []))
    if mode == "DROPMALFORMED":
        rows = rows.where(F.col("_r").getField(broken).isNull())
    out = rows.select(*[F.col("_r").getField(n).alias(n) for n in schema.names], *rows.columns[1:])
    return stage(out.select(*schema.names, *(["_file"] if lineage else []), ORD), scratch_path(spark, "landed"))


# ---- JSON arrays --------------------------------------------------------------------------------------------

def _outside(text: Column, within: bool) -> Column:
    """What of a piece of JSON stands outside of strings, if it begins outside of them or within one. Escapes are gone already."""
    if within:
        text = F.when(text.contains('"'), F.regexp_replace(text, '^[^"]*"', "")).otherwise(F.lit(""))
    return F.regexp_replace(F.regexp_replace(text, '"[^"]*"', ""), '"[^"]*$', "")


def _net(text: Column) -> Column:
    """Brackets opened less brackets closed."""
    return F.length(F.regexp_replace(text, r"[^\[{]", "")) - F.length(F.regexp_replace(text, r"[^\]}]", ""))


def array_elements(spark: SparkSession, path: str) -> DataFrame | None:
    """The objects of files that each hold one JSON array: (value, _ord, _file); None if a file holds anything else.

    Files are read in splits and cut at every closing brace, however long their lines are. Whether a piece begins within a
    string follows from the quotes before it, its depth from the brackets outside of strings, and the object it belongs
    to from how many objects end before it: three running counts over narrow rows. The pieces of an object are then
    joined by its number. Line ends between its tokens become blanks; strings cannot hold any.
    """
    scan = spark.read.option("lineSep", "}").text(path)
    pieces = stage(text_ordinal(scan, lineage=True), scratch_path(spark, "pieces"))
    bare = F.regexp_replace("value", r"\\.", "")
    states = {within: _outside(bare, within) for within in (False, True)}
    ends = {w: (_quotes(bare) + int(w)) % 2 == 0 for w in states}   # whether the brace behind a piece stands outside of strings
    narrow = stage(pieces.select(
        "_file", ORD, _quotes(bare).cast("long").alias("_quotes"),
        *[(_net(states[w]) - ends[w].cast("int")).cast("long").alias(f"_net{int(w)}") for w in states],
        *[ends[w].alias(f"_end{int(w)}") for w in states],
        F.regexp_replace(bare, r"\s", "").alias("_text")).withColumn("_text", F.substring("_text", 1, 2)), scratch_path(spark, "narrow"))
    keys = ["_file"]
    state = running_before(narrow, F.col("_quotes"), keys, ORD, "_q", F.sum, BLOCK)
    inside = F.col("_q") % 2 == 1
    state = state.select("_file", ORD, "_text", F.when(inside, F.col("_net1")).otherwise(F.col("_net0")).alias("_net"),
                         F.when(inside, F.col("_end1")).otherwise(F.col("_end0")).alias("_end"))
    depth = stage(running_before(state, F.col("_net"), keys, ORD, "_depth", F.sum, BLOCK), scratch_path(spark, "depths"))
    closes = F.col("_end") & (F.col("_depth") + F.col("_net") == 1)
    edges = depth.groupBy("_file").agg(F.min_by("_text", ORD).alias("first"), F.max_by("_text", ORD).alias("last"),
                                       F.max_by(F.col("_depth") + F.col("_net"), ORD).alias("left"), F.min("_depth").alias("lowest"))
    # The text behind the last brace has none of its own, so its depth reads one too low.
    sound = F.col("first").startswith("[") & (F.col("last") == "]") & (F.col("left") == -1) & (F.col("lowest") >= 0)
    if not edges.where(~F.coalesce(sound, F.lit(False))).limit(1).isEmpty():
        return None
    counted = running_before(depth.withColumn("_closes", closes.cast("long")), F.col("_closes"), keys, ORD, "_element", F.sum, BLOCK)
    text = pieces.select(ORD, "value").join(counted.select(ORD, "_file", "_element", "_closes"), ORD)
    joined = (text.groupBy("_file", "_element").agg(
        F.array_sort(F.collect_list(F.struct(F.col(ORD).alias("o"), F.col("value").alias("v")))).alias("l"), F.max("_closes").alias("_whole")).where("_whole = 1")
        .select(F.concat(F.array_join("l.v", "}"), F.lit("}")).alias("value"), F.element_at("l.o", 1).alias(ORD), "_file"))
    objects = cut_lineage(joined.withColumn("value", F.regexp_replace(F.regexp_replace("value", r"^[\s,\[]*", ""), r"[\r\n]", " ")))
    return objects if objects.where(~F.col("value").startswith("{")).limit(1).isEmpty() else None


def read_array(spark: SparkSession, path: str, schema: str | T.StructType | None, options: dict[str, Any], lineage: bool = False) -> DataFrame | None:
    """JSON arrays over many tasks, landed as Parquet with `_ord`; None where a file holds something else.

    Objects are written as JSON lines, each with its ordinal as its first field, and read by Spark's own reader.
    """
    objects = array_elements(spark, path)
    if objects is None:
        return None
    lines = scratch_path(spark, "objects")
    rest = F.substring("value", 2, 2**31 - 1)
    comma = F.when(F.trim(rest) == "}", F.lit("")).otherwise(F.lit(","))
    objects.select(F.concat(F.lit(f'{{"{MARK_ORD}":'), F.col(ORD).cast("string"), comma, rest)).write.text(lines)
    broken = options.get("columnNameOfCorruptRecord")
    read = spark.read.options(**{k: v for k, v in options.items() if k != "multiLine"})
    known = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema or read.json(lines).schema
    fields = [f for f in known.fields if f.name not in (MARK_ORD, broken)]
    error = [T.StructField(broken, T.StringType())] if broken else []
    rows = read.schema(T.StructType([*fields, *error, T.StructField(MARK_ORD, T.LongType())])).json(lines)
    place = F.col(MARK_ORD)
    if broken:   # of an object that does not parse, the ordinal is in its text
        mark = rf'^\{{"{MARK_ORD}":(\d+),?'
        place = F.coalesce(place, F.try_to_number(F.regexp_extract(broken, mark, 1), F.lit("9" * 19)).cast("long"))
        rows = rows.withColumns({MARK_ORD: place, broken: F.regexp_replace(broken, mark, "{")})
    out = rows.withColumnRenamed(MARK_ORD, ORD)
    if lineage:
        out = out.join(objects.select(ORD, "_file"), ORD)
    return stage(out.select(*[f"`{f.name}`" for f in [*fields, *error]], *(["_file"] if lineage else []), ORD), scratch_path(spark, "landed"))

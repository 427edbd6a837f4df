"""Keyed duplicate removal that keeps the first or the last row of each key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.operators.order import INTERNAL, ORD
from pairloom.session import cut_lineage

STRATEGIES = ("prompt", "chosen", "prompt_chosen", "exact")
# Nested values are compared as JSON that loses nothing: times to the microsecond, nulls written out.
EXACT_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"}
BROADCAST_KEYS = 500_000   # repeated keys (a digest and an ordinal each) that may be broadcast
FILTER_BITS = 32           # bits of the filter for each repeated key: about one in 32 other keys passes
BUCKET = 2**15             # bits of one row of the filter, four kilobytes
MAX_BUCKETS = 2**14        # rows of the filter that may be broadcast, 64 megabytes; beyond that it lets more keys pass


def _key_columns(df: DataFrame, strategy: str, ord: str) -> list[str]:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}: use one of {STRATEGIES}")
    if strategy == "exact":
        return sorted(c for c in df.columns if c != ord and c not in INTERNAL)
    return strategy.split("_")


def _shown(df: DataFrame, name: str) -> Column:
    """A value the way Python prints it: null as None, truth values capitalised."""
    if name not in df.columns:
        return F.lit("")
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.BooleanType):
        return F.coalesce(F.initcap(c.cast("string")), F.lit("None"))
    if not isinstance(kind, (T.StringType, T.IntegralType)):
        raise ValueError(f"compatible keys cover text, integers and booleans, not {name}: {kind.simpleString()}")
    return F.coalesce(c.cast("string"), F.lit("None"))


def _framed(df: DataFrame, name: str) -> Column:
    """A value as unambiguous text: length first, and null unlike any text."""
    if name not in df.columns:
        return F.lit("-")
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.BinaryType):
        text = F.hex(c)
    elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        text = F.to_json(F.struct(c), EXACT_JSON)
    else:
        text = c.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def dedup_key(df: DataFrame, strategy: str = "prompt_chosen", compat: bool = False, ord: str = ORD) -> Column:
    """The md5 of the fields a strategy compares.

    By default two rows share a key exactly when their fields are equal, null included. With
    `compat` the digest is taken over the joined plain text, where null reads as `None` and the
    separator is not escaped.
    """
    names = _key_columns(df, strategy, ord)
    if not compat:
        return F.md5(F.concat(*[_framed(df, n) for n in names]))
    if strategy == "exact":
        parts = [F.concat(F.lit(f"{n}:"), _shown(df, n)) for n in names]
    else:
        parts = [_shown(df, n) for n in names]
    return F.md5(reduce(lambda a, b: F.concat(a, F.lit("|||"), b), parts))


def _place(ord: str) -> Column:
    """The ordinal; rows without one come first."""
    return F.coalesce(F.col(ord).cast("long"), F.lit(-2**63))


def repeated_keys(df: DataFrame, key: Column, keep: str = "first", ord: str = ORD) -> DataFrame:
    """Keys that occur more than once, with the place to keep, the number of rows, and whether several rows may have that place."""
    pick = {"first": F.min, "last": F.max}[keep]
    found = (df.select(key.alias("_key"), _place(ord).alias("_o"), F.col(ord).isNull().alias("_none")).groupBy("_key")
             .agg(pick("_o").alias("_keep"), F.count("*").alias("_rows"), F.min("_o").alias("_low"), F.max("_o").alias("_high"), F.count_if("_none").alias("_nulls")))
    unclear = (F.col("_low") == F.col("_high")) | ((F.col("_nulls") > 1) & (F.col("_keep") == -2**63))
    return found.where("_rows > 1").select("_key", "_keep", "_rows", unclear.alias("_tied"))


def key_filter(keys: DataFrame, key: str, buckets: int) -> DataFrame:
    """A Bloom filter of one hash as a table of bit maps: (_bucket, _bits), one row for each 32,768 bits."""
    return (keys.select(*_cell(F.col(key), buckets)).groupBy("_bucket")
            .agg(F.bitmap_construct_agg("_bit").alias("_bits")))


def _cell(key: Column, buckets: int) -> list[Column]:
    h = F.xxhash64(key)
    return [F.pmod(h, F.lit(buckets)).cast("int").alias("_bucket"), F.pmod(F.shiftright(h, 32), F.lit(BUCKET)).alias("_bit")]


def may_hold(rows: DataFrame, key: str, bits: DataFrame, buckets: int, into: str) -> DataFrame:
    """`rows` with a boolean `into`: true for every key in the filter and for a few others."""
    bucket, bit = _cell(F.col(key), buckets)
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))
    return (rows.withColumns({"_bucket": bucket, "_bit": bit}).join(F.broadcast(bits), "_bucket", "left")
            .withColumn(into, hit).drop("_bucket", "_bit", "_bits"))


def _content(df: DataFrame) -> Column:
    """A hash of a whole row, to choose among rows of one key and place."""
    return F.xxhash64(*[F.to_json(F.struct(f"`{c}`"), {"ignoreNullFields": "false"}) for c in df.columns])


def deduplicate(df: DataFrame, strategy: str = "prompt_chosen", keep: str = "first", ord: str = ORD,
                compat: bool = False, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """One row per key: the one with the smallest (`first`) or largest (`last`) ordinal.

    Only digests and ordinals are shuffled, pre-aggregated per task, to find the repeated keys. When those are few they
    are broadcast and whole rows stay where they are. Otherwise a filter of their hashes is: rows that it rules out stay
    where they are too, and only the others, repeated ones and a few more, are grouped by key, one row of each kept in
    every task before they are shuffled, so that a key that most rows share is no load. Rows without an ordinal come
    first; of rows that share a key and a place, the smallest by a hash of their content stays.
    """
    if keep not in ("first", "last"):
        raise ValueError("keep is 'first' or 'last'")
    key = dedup_key(df, strategy, compat, ord)
    repeats = cut_lineage(repeated_keys(df, key, keep, ord).select("_key", "_keep", "_tied"))
    number, tied = repeats.agg(F.count("*"), F.coalesce(F.bool_or("_tied"), F.lit(False))).first()
    if number <= broadcast_keys and not tied:
        return (df.withColumn("_key", key).join(F.broadcast(repeats.select("_key", "_keep")), "_key", "left")
                .where(F.col("_keep").isNull() | (_place(ord) == F.col("_keep"))).drop("_key", "_keep"))
    buckets = max(1, min(number * FILTER_BITS // BUCKET, MAX_BUCKETS))
    bits = cut_lineage(key_filter(repeats, "_key", buckets))
    marked = may_hold(df.withColumn("_key", key), "_key", bits, buckets, "_repeated")
    place = _place(ord) if keep == "first" else F.bitwise_not(_place(ord))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    kept = (marked.where("_repeated").withColumn("_by", F.struct(place.alias("p"), _content(df).alias("c")))
            .groupBy("_key").agg(F.min_by(row, "_by").alias("_row")).select("_row.*"))
    return marked.where("NOT _repeated").drop("_key", "_repeated").unionByName(kept)


def has_duplicates(df: DataFrame, strategy: str = "prompt_chosen", compat: bool = False, ord: str = ORD) -> DataFrame:
    """One row, one boolean; false for an empty table."""
    repeats = repeated_keys(df, dedup_key(df, strategy, compat, ord), ord=ord).limit(1)
    return repeats.agg((F.count("*") > 0).alias("has_duplicates"))


def count_duplicates(df: DataFrame, strategy: str = "prompt_chosen", compat: bool = False, ord: str = ORD) -> DataFrame:
    """One row: rows beyond the first of each key."""
    repeats = repeated_keys(df, dedup_key(df, strategy, compat, ord), ord=ord)
    return repeats.agg(F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("duplicates"))


def duplicate_counts(df: DataFrame, strategies: Sequence[str] = STRATEGIES, compat: bool = False, ord: str = ORD) -> DataFrame:
    """(strategy, duplicates) for several strategies in one scan and one shuffle of digests."""
    keys = F.array(*[F.struct(F.lit(s).alias("strategy"), dedup_key(df, s, compat, ord).alias("key")) for s in strategies])
    rows = df.select(F.explode(keys).alias("k")).groupBy("k.strategy", "k.key").agg(F.count("*").alias("n"))
    counted = rows.groupBy("strategy").agg(F.sum(F.col("n") - 1).alias("duplicates"))
    names = df.sparkSession.createDataFrame([(s,) for s in strategies], "strategy string")   # a table without rows has none twice
    return names.join(F.broadcast(counted), "strategy", "left").select("strategy", F.coalesce("duplicates", F.lit(0)).alias("duplicates"))


def keep_ordinals(df: DataFrame, ordinals: DataFrame, ord: str = ORD) -> DataFrame:
    """Rows whose ordinal is listed."""
    return df.join(ordinals.select(ord), ord, "left_semi")

"""Column helpers for text, numbers and JSON. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
              "\u2028\u2029\u202f\u205f\u3000")


def has_text(c: Column) -> Column:
    """Whether stripping leaves something; never null. Looks no further than the first visible character."""
    return F.coalesce(F.ltrim(c, F.lit(WHITESPACE)) != "", F.lit(False))


def is_blank(c: Column) -> Column:
    """True for null and for text without any visible character."""
    return ~has_text(c)


def strip(c: Column) -> Column:
    """Text without leading and trailing whitespace of any kind, Unicode spaces included."""
    return F.btrim(c, F.lit(WHITESPACE))


def text_or_empty(c: Column) -> Column:
    """The value as text, null as the empty string; truth values read `True` and `False`."""
    text = c.cast("string")
    return F.coalesce(F.when(F.typeof(c) == "boolean", F.initcap(text)).otherwise(text), F.lit(""))


def char_length(c: Column) -> Column:
    """Length in code points."""
    return F.length(c.cast("string"))


def estimate_tokens(c: Column) -> Column:
    """Rough token count of a text: four characters to a token."""
    return char_length(c) / F.lit(4.0)


def round_half_even(c: Column, digits: int = 0) -> Column:
    """Round a double the way Python does: on its exact binary value, ties to even.

    `bround` decides on the shortest decimal form instead and so turns 0.35 into 0.4. Here the
    fraction is held as two 31-bit integers, exact for every double large enough to matter at up
    to four digits, and the tie is decided on integers. Values of 2**52 and more are whole and come
    back unchanged, as do infinities and NaN.
    """
    if not 0 <= digits <= 4:
        raise ValueError("digits must be between 0 and 4")
    step = 10**digits
    half, mask = 2**30, F.lit(2**31 - 1)

    def parts(x: Column) -> Column:
        whole = F.floor(x).cast("long")
        return F.struct(whole.alias("whole"), ((x - whole) * F.lit(float(2**62))).cast("long").alias("bits"))

    def scaled(p: Column) -> Column:
        low = p["bits"].bitwiseAND(mask) * step
        high = F.shiftright(p["bits"], 31) * step + F.shiftright(low, 31)
        units = p["whole"] * step + F.shiftright(high, 31)
        return F.struct(units.alias("units"), high.bitwiseAND(mask).alias("rest"), low.bitwiseAND(mask).alias("dust"))

    def settled(p: Column) -> Column:
        up = (p["rest"] > half) | ((p["rest"] == half) & ((p["dust"] > 0) | (p["units"] % 2 == 1)))
        return (p["units"] + F.when(up, 1).otherwise(0)).cast("double") / F.lit(float(step))

    value = c.cast("double")
    whole = F.abs(value) >= float(2**52)   # NaN counts as larger than any number
    rounded = named(named(named(F.when(whole, 0.0).otherwise(F.abs(value)), parts), scaled), settled)
    return F.when(whole, value).when(value < 0, -rounded).otherwise(rounded)


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, however often `use` mentions it."""
    return F.transform(F.array(value), use)[0]


def human_bytes(c: Column) -> Column:
    """A byte count as short text, e.g. `12.5 GB`."""
    units = ("B", "KB", "MB", "GB", "TB")
    size = c.cast("double")
    power = F.lit(len(units) - 1)
    for p in reversed(range(len(units) - 1)):
        power = F.when(size < float(1024 ** (p + 1)), p).otherwise(power)
    return named(power, lambda p: F.format_string(
        "%.1f %s", round_half_even(size / F.pow(F.lit(1024.0), p), 1), F.array(*map(F.lit, units))[p]))


def training_progress(step: Column, total: Column) -> Column:
    """Share of a run that is done: training fills 0.3 to 0.9 of the bar."""
    return F.least(F.lit(0.3) + F.lit(0.6) * (step.cast("double") / total), F.lit(0.9))


def checkpoint_step(name: Column) -> Column:
    """The number in `checkpoint-<number>`, null for any other name."""
    return F.try_to_number(F.nullif(F.regexp_extract(name, r"^checkpoint-(\d+)$", 1), F.lit("")),
                           F.lit("9" * 18)).cast("long")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_stem(path: Column) -> Column:
    """File name without its last extension; a leading dot does not start an extension."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def caption_from_path(path: Column) -> Column:
    """A caption made of the file stem: `_` and `-` read as spaces."""
    return F.translate(file_stem(path), "_-", "  ")


def micros(t: Column) -> Column:
    """A time as microseconds; ISO text and timestamps without a zone are read in the session's zone, unreadable text as null."""
    return F.unix_micros(t.try_cast("timestamp"))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Elapsed seconds with the fraction kept."""
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def ttl_remaining(uploaded_at: Column, now: Column, ttl_hours: float) -> Column:
    """Whole seconds left before an upload expires, never negative."""
    left = micros(uploaded_at) + F.lit(int(ttl_hours * 3_600_000_000)) - micros(now)
    return F.greatest(F.lit(0), left / F.lit(1_000_000)).cast("long")


def json_field(doc: Column, name: str, default: str | None = None) -> Column:
    """One top-level field of a JSON object as text."""
    value = F.get_json_object(doc, f"$['{name}']")
    return value if default is None else F.coalesce(value, F.lit(default))


# The fields of a run configuration that hold credentials.
SECRET_FIELDS = ("hf_token", "wandb_key")


def redact_json(doc: Column, fields: tuple[str, ...] = SECRET_FIELDS) -> Column:
    """The JSON object without its credential fields; nested values stay as they are."""
    entries = F.from_json(doc, "map<string,variant>")
    return F.to_json(F.map_filter(entries, lambda k, _: ~k.isin(*fields)))


from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions import text as t
from tests.conftest import EDGE_TEXTS


def one(spark, values, kind, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_blank_and_strip_agree_with_python_on_every_low_code_point(spark):
    chars = [chr(c) for c in range(0x3100) if not 0xD800 <= c < 0xE000]
    got = one(spark, chars, "string", t.is_blank(F.col("v")), t.has_text(F.col("v")), t.strip(F.col("v")))
    for c, (blank, filled, stripped) in zip(chars, got, strict=True):
        assert blank == (c.strip() == ""), hex(ord(c))
        assert filled != blank
        assert stripped == c.strip(), hex(ord(c))


def test_edge_texts(spark):
    got = one(spark, EDGE_TEXTS, "string", t.is_blank(F.col("v")), t.text_or_empty(F.col("v")), t.char_length(F.col("v")))
    for v, (blank, text, length) in zip(EDGE_TEXTS, got, strict=True):
        assert blank == (v is None or v.strip() == "")
        assert text == (v or "")
        assert length == (None if v is None else len(v))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=50, max_size=50))
def test_rounding_is_pythons(spark, values):
    values += [0.35, 0.25, 0.45, 2.675, 0.5, 1.5, 2.5, -0.35, -2.5, 0.0, 1e-9, 0.05, 0.15, 1023.95]
    for digits in (0, 1, 2):
        got = one(spark, values, "double", t.round_half_even(F.col("v"), digits))
        assert [g for (g,) in got] == [round(v, digits) for v in values]


def test_human_bytes(spark):
    sizes = [0, 1, 1023, 1024, 1536, 10**6, 1024**2, 5 * 1024**3, 3 * 1024**4, 9 * 1024**5]

    def shown(n):
        size = float(n)
        for unit in ["B", "KB", "MB", "GB"]:
            if size < 1024:
                return f"{size:.1f} {unit}"
            size /= 1024
        return f"{size:.1f} TB"

    assert [g for (g,) in one(spark, sizes, "long", t.human_bytes(F.col("v")))] == [shown(n) for n in sizes]


def test_paths_and_steps(spark):
    paths = ["/a/my_cat-1.png", "b/.hidden", "x.tar.gz", "noending", "checkpoint-12"]
    got = one(spark, paths, "string", t.file_name(F.col("v")), t.file_stem(F.col("v")), t.caption_from_path(F.col("v")),
              t.checkpoint_step(F.col("v")))
    assert got == [("my_cat-1.png", "my_cat-1", "my cat 1", None), (".hidden", ".hidden", ".hidden", None),
                   ("x.tar.gz", "x.tar", "x.tar", None), ("noending", "noending", "noending", None),
                   ("checkpoint-12", "checkpoint-12", "checkpoint 12", 12)]


def test_json_helpers(spark):
    doc = '{"base_model":"m","hf_token":"x","nested":{"wandb_key":"kept"},"wandb_key":"y","n":1.5}'
    got = one(spark, [doc], "string", t.redact_json(F.col("v")), t.json_field(F.col("v"), "base_model"),
              t.json_field(F.col("v"), "absent", ""))
    assert got == [('{"base_model":"m","n":1.5,"nested":{"wandb_key":"kept"}}', "m", "")] or got == [
        ('{"base_model":"m","nested":{"wandb_key":"kept"},"n":1.5}', "m", "")]


def test_ttl_and_progress(spark):
    now = F.lit("2024-01-02 00:00:00")
    got = one(spark, ["2024-01-01 12:00:00", "2023-12-01 00:00:00"], "string", t.ttl_remaining(F.col("v"), now, 24))
    assert got == [(43200,), (0,)]
    steps = one(spark, [0, 50, 100], "long", t.training_progress(F.col("v"), F.lit(100)))
    assert [s for (s,) in steps] == [min(0.3 + 0.6 * (n / 100), 0.9) for n in (0, 50, 100)]



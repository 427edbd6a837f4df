import pytest
from pyspark.sql import functions as F

from pairloom.functions.templates import conversation_renderer, describe_formats, formatter
from tests.conftest import EDGE_TEXTS

FIELDS = ("system", "prompt", "chosen", "rejected", "reasoning")
SCHEMA = ", ".join(f"{f} string" for f in FIELDS)


def table(spark, rows, extra="id int"):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{extra}, {SCHEMA}")


def collected(df):
    return [(r["prompt"], r["chosen"], r["rejected"]) for r in df.orderBy("id").collect()]


def say(v):
    return "" if v is None else v


def expected(kind, s, p, c, r, think):
    s, p, c, r, think = map(say, (s, p, c, r, think))
    has_system, block = bool(s.strip()), f"<think>\n{think}\n</think>\n\n" if think.strip() else ""
    if kind in ("chatml", "qwen3", "qwen3-off"):
        head = f"<|im_start|>system\n{s}<|im_end|>\n" if has_system else ""
        ask = f"{head}<|im_start|>user\n{p}<|im_end|>\n<|im_start|>assistant\n"
        block = "" if kind == "chatml" else block
        ask += "<think>\n\n</think>\n\n" if kind == "qwen3-off" else ""
        return ask, f"{block}{c}<|im_end|>\n", f"{block}{r}<|im_end|>\n"
    if kind == "llama3":
        head = f"<|start_header_id|>system<|end_header_id|>\n\n{s}<|eot_id|>" if has_system else ""
        return (f"<|begin_of_text|>{head}<|start_header_id|>user<|end_header_id|>\n\n{p}<|eot_id|>"
                "<|start_header_id|>assistant<|end_header_id|>\n\n", f"{c}<|eot_id|>", f"{r}<|eot_id|>")
    if kind == "mistral":
        return f"[INST] {s + chr(10) * 2 if has_system else ''}{p} [/INST] ", c, r
    return p, c, r


@pytest.mark.parametrize("kind", ["chatml", "llama3", "mistral", "qwen3", "qwen3-off", "raw"])
def test_formats_on_the_edge_matrix(spark, kind):
    data = [(a, b, b, a, a) for a in EDGE_TEXTS for b in EDGE_TEXTS]
    fmt = formatter("qwen3", enable_thinking=False) if kind == "qwen3-off" else formatter(kind.upper())
    assert collected(fmt(table(spark, data))) == [expected(kind, *row) for row in data]


def test_missing_columns_read_empty_and_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "q", "a")], "id int, prompt string, chosen string")
    out = formatter("none")(df)
    assert [tuple(r) for r in out.select("id", "prompt", "chosen", "rejected").collect()] == [(1, "q", "a", "")]


def test_custom_templates(spark):
    data = [("s", "p{x}", "c", "r", None)]
    fmt = formatter("custom", custom_templates={"prompt_template": "{{{system}}}:{prompt}", "rejected_template": "-{rejected}"})
    assert collected(fmt(table(spark, data))) == [("{s}:p{x}", "c", "-r")]
    for bad in ({"prompt_template": "{chosen}"}, {"chosen_template": "{prompt}"}, {"prompt_template": "{}"}, {"prompt_template": "{prompt!r}"}):
        with pytest.raises(ValueError):
            collected(formatter("custom", custom_templates=bad)(table(spark, data)))


def test_dispatch():
    with pytest.raises(ValueError, match="custom_templates"):
        formatter("custom")
    with pytest.raises(ValueError, match="renderer"):
        formatter("tokenizer")
    with pytest.raises(ValueError, match="unknown format"):
        formatter("vicuna")
    assert formatter("qwen3").info["enable_thinking"] is True
    assert conversation_renderer("RAW") is None and conversation_renderer("Llama3") is not None


def test_descriptors(spark):
    assert set(describe_formats()) == {"chatml", "llama3", "mistral", "qwen3", "raw"}


def test_row_format_equals_conversation_rendering(spark):
    df = table(spark, [("sys", "ask", "answer", None, None), (None, "ask", "answer", None, None)])
    turns = F.filter(F.array(
        F.struct(F.lit("system").alias("role"), F.col("system").alias("content")),
        F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.col("chosen").alias("content"))), lambda m: m["content"].isNotNull())
    for kind in ("chatml", "llama3"):
        whole = {r[0]: r[1] for r in df.select("id", conversation_renderer(kind)(turns)).collect()}
        split = {r["id"]: r["prompt"] + r["chosen"] for r in formatter(kind)(df).collect()}
        assert whole == split


def test_mistral_conversation(spark):
    df = spark.createDataFrame(
        [([("system", "S"), ("user", "U"), ("assistant", "A"), ("tool", "T"), ("system", "late")],), ([("user", None)],), ([],)],
        "messages array<struct<role:string,content:string>>")
    got = [r[0] for r in df.select(conversation_renderer("mistral")(F.col("messages"))).collect()]
    assert sorted(got) == sorted(["<s>S\n\n[INST] U [/INST] A</s>", "<s>[INST]  [/INST]", "<s>"])

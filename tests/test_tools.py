import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from pairloom.functions import rendering as R
from pairloom.functions.templates import formatter
from pairloom.operators.messages import convert_messages

cloudpickle.register_pickle_by_value(sys.modules[__name__])   # the templates below run in workers

TOOLS = [{"type": "function", "function": {"name": "look_up", "description": "Look a word up."}}]
SCHEMA = ("id int, messages array<struct<role:string,content:string,tool_calls:array<struct<type:string,"
          "function:struct<name:string,arguments:string>>>>>, tools string")


def template(messages, tools=None, add_generation_prompt=False, enable_thinking=None):
    """Schemas go in front of the system text, results into a user turn, calls behind the answer."""
    if all(m["role"] not in ("user", "tool") for m in messages):
        raise ValueError("no user turn")
    shown = ""
    for m in messages:
        role, text = m["role"], m["content"]
        if role == "system" and tools:
            text = "# Tools\n" + "\n".join(json.dumps(t) for t in tools) + "\n\n" + text
        elif role == "tool":
            role, text = "user", f"<response>\n{text}\n</response>"
        for call in m.get("tool_calls", []):
            arguments = call["function"]["arguments"]
            text += f"<call={call['function']['name']}>" + "".join(f"<{k}>{v}" for k, v in arguments.items())
        shown += f"[{role}]" + ("<think></think>" if role == "assistant" else "") + f"{text}[end]\n"
    return shown + ("[assistant]" if add_generation_prompt else "")


def call(arguments):
    return [("function", ("look_up", arguments))]


def conversation(arguments, id=1):
    return (id, [("system", "You keep a dictionary.", None), ("user", "What is a ewe?", None), ("assistant", None, call(arguments))],
            json.dumps(TOOLS))


def test_flatten(spark):
    df = spark.createDataFrame([conversation('{"word": "ewe"}')], SCHEMA)
    out = convert_messages(df, template).first()
    assert out["prompt"] == "What is a ewe?"
    assert out["chosen"] == "<call=look_up><word>ewe"
    assert out["system"].startswith("# Tools\n") and out["system"].endswith("\n\nYou keep a dictionary.")
    assert "tools" not in out.asDict() and "messages" not in out.asDict()


def test_tool_results_join_the_user_side_and_empty_parts_vanish(spark):
    rows = [(1, [("user", "go", None), ("assistant", "", None), ("tool", "done", None), ("assistant", "fine", None)], None)]
    out = convert_messages(spark.createDataFrame(rows, SCHEMA), template).first()
    assert out["prompt"] == "go\n\n<response>\ndone\n</response>" and out["chosen"] == "fine" and out["system"] == ""


def test_audit_covers_every_row(spark):
    rows = [conversation('{"word": "ewe"}', 1), conversation("{}", 2),
            (3, [("user", "a", None), ("assistant", "b", call("{}")), ("user", "c", None), ("assistant", "d", None)], None)]
    audited = {r["id"]: r["survives"] for r in R.audit_tools(spark.createDataFrame(rows, SCHEMA), template).collect()}
    assert audited == {1: True, 2: True, 3: False}


def test_a_template_that_drops_content_is_refused(spark):
    df = spark.createDataFrame([conversation("{}")], SCHEMA)
    out = convert_messages(df, lambda messages, **kw: "constant", on_error="quarantine").first()
    assert "ToolRenderError" in out["_error"]
    assert convert_messages(df, lambda messages, **kw: "constant", on_error="drop").count() == 0


def test_detection(spark):
    rows = [conversation("{}", 1), (2, [("user", "x", None)], ""), (3, [("tool", "x", None)], None), (4, [("TOOL", "x", None)], None),
            (5, None, "[]"), (6, [("assistant", None, [])], None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r[0]: r[1] for r in df.select("id", R.row_has_tools(df)).collect()} == {1: True, 2: False, 3: True, 4: False, 5: True, 6: False}
    assert R.dataset_has_tools(df)
    assert not R.dataset_has_tools(df.where("id = 2").drop("tools"))


def test_call_arguments_are_normalised(spark):
    rows = [conversation(a, i) for i, a in enumerate(['{"x": 1}', "not json", None, '"text"'])]
    df = spark.createDataFrame(rows, SCHEMA)
    element = df.schema["messages"].dataType.elementType["tool_calls"].dataType.elementType
    calls = R.normalise_calls(F.col("messages")[2]["tool_calls"], element)
    got = {r[0]: (r[1], r[2]) for r in df.select("id", calls[0]["name"], F.to_json(calls[0]["arguments"])).collect()}
    assert got == {0: ("look_up", '{"x":1}'), 1: ("look_up", '"not json"'), 2: ("look_up", "{}"), 3: ("look_up", '"text"')}


def test_structured_arguments(spark):
    schema = "calls array<struct<name:string,arguments:struct<x:int>>>"
    df = spark.createDataFrame([([("f", (1,)), ("g", None)],)], schema)
    element = df.schema["calls"].dataType.elementType
    out = df.select(F.transform(R.normalise_calls(F.col("calls"), element), lambda c: F.to_json(c["arguments"]))).first()[0]
    assert out == ['{"x":1}', "{}"]


class Tokenizer:
    chat_template = "yes"

    def apply_chat_template(self, messages, tools=None, tokenize=False, add_generation_prompt=False, enable_thinking=True):
        head = "<a>" if enable_thinking else "<a><none>"
        out = "".join((head if m["role"] == "assistant" else f"<{m['role']}>") + m["content"] for m in messages)
        return out + (head if add_generation_prompt else "")


PREF = "id int, system string, prompt string, chosen string, rejected string, reasoning string"


def test_template_formatter(spark):
    rows = [(1, "S", "p", "c", None, None), (2, " ", "p", "c", "r", "why"), (3, None, "<think>x</think>", "c", "r", None)]
    df = spark.createDataFrame(rows, PREF)
    fmt = formatter("tokenizer", renderer=R.TokenizerRenderer(Tokenizer()))
    got = [(r["prompt"], r["chosen"], r["rejected"]) for r in fmt(df).orderBy("id").collect()]
    assert got == [("<system>S<user>p<a><none>", "c", ""),
                   ("<user>p<a>", "<think>\nwhy\n</think>\n\nc", "<think>\nwhy\n</think>\n\nr"),
                   ("<user><think>x</think><a>", "c", "r")]
    fixed = formatter("tokenizer", renderer=R.TokenizerRenderer(Tokenizer()), enable_thinking=False, auto_detect_thinking=False)
    assert fixed(df).where("id = 2").first()["prompt"] == "<user>p<a><none>"


def test_template_formatter_without_a_template(spark):
    tokenizer = Tokenizer()
    tokenizer.chat_template = None
    fmt = formatter("tokenizer", renderer=R.TokenizerRenderer(tokenizer))
    out = fmt(spark.createDataFrame([(1, "S", "p", "c", None, "why")], PREF)).first()
    assert (out["prompt"], out["chosen"], out["rejected"]) == ("S\n\np\n", "<think>\nwhy\n</think>\n\nc", "<think>\nwhy\n</think>\n\n")


def test_template_that_fails_or_is_no_prefix(spark):
    df = spark.createDataFrame([(1, "S", "p", "c", "r", None)], PREF)

    def failing(messages, **kw):
        raise RuntimeError("unsupported role")

    out = formatter("tokenizer", renderer=failing)(df).first()
    assert (out["prompt"], out["chosen"], out["rejected"]) == ("S\n\np\n", "c", "r")

    def reordering(messages, **kw):
        return "|".join(m["content"] for m in reversed(messages))

    out = formatter("tokenizer", renderer=reordering, on_mismatch="quarantine")(df).first()
    assert "prefix" in out["_error"]
    assert formatter("tokenizer", renderer=reordering)(df).first()["chosen"] == "c|p|S"[len("p|S"):]


def test_lazy_renderer_is_built_in_the_worker(spark):
    fmt = formatter("tokenizer", renderer=R.LazyRenderer(lambda: R.TokenizerRenderer(Tokenizer())))
    assert fmt(spark.createDataFrame([(1, None, "p", "c", "r", None)], PREF)).first()["prompt"] == "<user>p<a><none>"


@pytest.mark.parametrize("on_error", ["fail", "drop", "quarantine"])
def test_plain_rows_pass_untouched_beside_tool_rows(spark, on_error):
    rows = [conversation("{}", 1), (2, [("user", "q", None), ("assistant", "a", None)], None)]
    got = {r["id"]: r["chosen"] for r in convert_messages(spark.createDataFrame(rows, SCHEMA), template, on_error).collect()}
    assert got == {1: "<call=look_up>", 2: "a"}

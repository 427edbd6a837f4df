import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from pairloom.operators import messages
from pairloom.operators.dedup import deduplicate
from pairloom.operators.messages import NO_ASSISTANT, NO_MESSAGES, NO_USER, convert_messages, has_messages_format, nest_turns

MESSAGES = "id int, messages array<struct<role:string,content:string>>"


def test_nesting_keeps_turn_order_also_for_a_conversation_with_most_rows(spark):
    data = [(7, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(500)]
    data += [(c, t, "user", f"c{c}-{t}") for c in range(30) for t in range(3) if c != 7] + [(None, 0, "user", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn int, role string, text string").repartition(4, "text")
    want = {}
    for c, t, role, text in sorted(data, key=lambda r: (r[0] is None, r[0], r[1])):
        want.setdefault(c, []).append((role, text))
    for block in (4096, 16):
        got = {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in nest_turns(df, block=block).collect()}
        assert got == want


@pytest.mark.parametrize("listed", [1000, 2])
def test_staged_blocks_give_the_same_conversations(spark, monkeypatch, listed):
    monkeypatch.setattr(messages, "HOT_LISTED", listed)
    data = [(7, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(300)]
    data += [(c, t, "user", f"c{c}-{t}") for c in range(12) for t in range(c) if c != 7] + [(None, t, "user", f"x{t}") for t in range(9)] + [(20, None, None, None)]
    df = spark.createDataFrame(data, "conv_id long, turn int, role string, text string").repartition(4, "text")
    for block in (4096, 4):
        want, got = ({r["conv_id"]: r["messages"] for r in nest_turns(df, block=block, staged=s).collect()} for s in (False, True))
        assert got == want and len(got) == 13
    empty = df.where("false")
    assert nest_turns(empty, staged=True).collect() == [] and nest_turns(empty, staged=True).schema.simpleString() == nest_turns(empty).schema.simpleString()


def test_removing_duplicates_of_staged_conversations_shuffles_no_texts(spark):
    data = [(c, t, r, f"{r} {c % 5}") for c in range(40) for t, r in enumerate(("user", "assistant"))]
    turns = spark.createDataFrame(data, "conv_id long, turn int, role string, text string")
    rows = deduplicate(convert_messages(nest_turns(turns, staged=True)), ord="conv_id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" in plan
    assert sorted(r["conv_id"] for r in rows.collect()) == list(range(5))


def test_conversion(spark):
    data = [
        (1, [("system", "Be kind"), ("user", "Begin"), ("assistant", "Once upon a time."), ("user", "And then?"), ("assistant", "That was all.")]),
        (2, [("USER", "q"), ("Assistant", None), ("assistant", "a"), ("critic", "skipped"), (None, "skipped")]),
    ]
    df = spark.createDataFrame(data, MESSAGES)
    assert has_messages_format(df)
    got = {r["id"]: r for r in convert_messages(df).collect()}
    assert (got[1]["system"], got[1]["prompt"], got[1]["chosen"]) == (
        "Be kind", "Begin\n\nAnd then?", "Once upon a time.\n\nThat was all.")
    assert (got[2]["system"], got[2]["prompt"], got[2]["chosen"]) == ("", "q", "\n\na")


BAD = [(1, [("user", "q"), ("assistant", "a")]), (2, []), (3, None), (4, [("assistant", "a")]), (5, [("user", "q"), ("assistant", "")]),
       (6, [("user", ""), ("assistant", "a")])]


def test_errors_can_stop_drop_or_be_kept(spark):
    df = spark.createDataFrame(BAD, MESSAGES)
    assert [r["id"] for r in convert_messages(df, on_error="drop").collect()] == [1]
    reasons = {r["id"]: r["_error"] for r in convert_messages(df, on_error="quarantine").collect()}
    assert reasons == {1: None, 2: NO_MESSAGES, 3: NO_MESSAGES, 4: NO_USER, 5: NO_ASSISTANT, 6: NO_USER}
    with pytest.raises(PySparkException, match="the conversation has no turns|nothing was said"):
        convert_messages(df).collect()
    with pytest.raises(PySparkException, match="the conversation has no turns|nothing was said"):
        convert_messages(df).count()


def test_two_empty_contents_join_to_a_blank_line(spark):
    df = spark.createDataFrame([(1, [("user", ""), ("user", None), ("assistant", "a")])], MESSAGES)
    assert convert_messages(df).first()["prompt"] == "\n\n"


def test_detection(spark):
    assert has_messages_format(spark.createDataFrame([(1, [])], MESSAGES))   # an empty conversation is an error of its row
    assert not has_messages_format(spark.createDataFrame([("x",)], "messages string"))
    assert not has_messages_format(spark.createDataFrame([("x",)], "prompt string"))
    assert has_messages_format(spark.createDataFrame([], MESSAGES))


def test_tool_rows_need_a_renderer(spark):
    df = spark.createDataFrame([(1, [("user", "q"), ("tool", "r"), ("assistant", "a")]), (2, [("user", "q"), ("assistant", "a")])], MESSAGES)
    kept = convert_messages(df, on_error="quarantine").select("id", F.col("_error").isNull()).collect()
    assert {tuple(r) for r in kept} == {(1, False), (2, True)}
    with pytest.raises(PySparkException, match="renderer"):
        convert_messages(df).collect()

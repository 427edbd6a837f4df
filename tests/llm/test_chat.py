import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string, block int, key string"
PIECES = st.lists(st.sampled_from(["</s>", "[INST]", "[/INST]", "[SYS] ", "\\", "<", "[", "/", "a", " ", "\n", "<turn ", ">", "</turn>", "\\/s>", "é"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "tool", "a>b\\", "</turn>"]), PIECES), max_size=5))
def test_formatting_can_be_read_back(turns):
    writer = chat.Writer(chat.INST)
    parts = [writer.segments(r, t) for r, t in turns]
    assert writer.read("".join(s for turn in parts for s, _ in turn)) == turns
    assert "".join(writer.restore(s) for turn in parts for s, loss in turn if loss) == "".join(t for r, t in turns if r == "assistant")


def accepted(roles):
    state = "start"
    for r in roles:
        state = chat.INST.step(state, r)
    return state == "assistant"


@pytest.mark.parametrize("most", [256, 3])
def test_conversations(table, monkeypatch, most):
    monkeypatch.setattr(chat, "BLOCK_TURNS", most)
    hard = "</s>[INST] ok [/INST]"
    talks = {1: ["user", "assistant"] * 20, 2: ["system", "user", "assistant"], 3: ["user"], 4: ["assistant", "user"], 5: ["user", "user", "assistant"],
             6: ["user", "assistant", "system", "assistant"], 7: ["tool", "user", "assistant"], 8: ["user", "broken", "assistant"], None: ["user", "assistant"]}
    rows = [(k, i, r, f"{hard} {k} {i}" if i % 2 else None, 1, "k") for k, roles in talks.items() for i, r in enumerate(roles)]
    made = chat.format_conversations(table(rows, SCHEMA))
    blocks = sorted(made.collect(), key=lambda r: (r["conv_id"] or -1, r["block"]))
    writer = chat.Writer(chat.INST)
    for k, roles in talks.items():
        own = [b for b in blocks if b["conv_id"] == k]
        assert [b["block"] for b in own] == list(range(len(own))) and max(b["n_turns"] for b in own) <= most
        assert {b["valid"] for b in own} == {accepted(roles)}
        whole = "".join(s["text"] for b in own for s in b["segments"])
        assert writer.read(whole) == [(r, t or "") for _, _, r, t, *_ in sorted((x for x in rows if x[0] == k), key=lambda x: x[1])]
    read = {(r["conv_id"], r["block"]): r for r in chat.read_back(made).collect()}
    for b in blocks:
        r = read[b["conv_id"], b["block"]]
        assert r["n_turns"] == b["n_turns"] and r["chars"] == sum(len(s["text"]) for s in b["segments"])


def test_ties_nulls_and_empty_tables(table):
    rows = [(1, None, "user", "b", 1, ""), (1, None, "user", "a", 1, ""), (1, None, "assistant", "z", 1, ""), (1, 0, None, None, 1, ""), (1, 0, None, None, 1, "")]
    (block,) = chat.format_conversations(table(rows, SCHEMA)).collect()
    turns = chat.Writer(chat.INST).read("".join(s["text"] for s in block["segments"]))
    assert turns[0] == ("assistant", "z") and sorted(turns[1:3]) == [("user", "a"), ("user", "b")] and turns[3:] == [("", "")] * 2 and not block["valid"]
    assert chat.format_conversations(table([], SCHEMA)).collect() == []

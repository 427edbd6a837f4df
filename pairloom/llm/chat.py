"""Chat formatting by a finite-state machine over roles and a declarative template.

A template names, for each role, what stands before and after a text, and whether the text counts for the loss. Its marks
are control strings; where a text holds one, an escape makes it ordinary, and reading back undoes that.

Turns are range-sorted, so a conversation of any length spreads over tasks. A task cuts its turns into blocks and works out
for each block where every state of the machine would end; the states that blocks begin in follow from these small maps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.llm.scratch import Scratch

BLOCK_TURNS, BLOCK_CHARS = 256, 1 << 20  # a block ends beyond either


@dataclass(frozen=True)
class Template:
    """Marks by role, the roles under the loss, and the machine: allowed roles by state; a role's state is its name."""

    marks: dict[str, tuple[str, str]]
    loss: frozenset[str] = frozenset({"assistant"})
    other: tuple[str, str, str] = ("<turn ", ">", "</turn>")  # a role without marks of its own is named in the text
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {
        "start": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}),
        "assistant": frozenset({"user"})})
    ends: frozenset[str] = frozenset({"assistant"})

    @property
    def controls(self) -> list[str]:
        found = {m.strip() for pair in self.marks.values() for m in pair} | {m.strip() for m in self.other if len(m.strip()) > 1}
        return sorted(found - {""}, key=lambda m: (-len(m), m))

    @property
    def states(self) -> list[str]:
        return sorted({*self.follows, "broken"})

    def step(self, state: str, role: str) -> str:
        return role if role in self.follows.get(state, ()) and role in self.states else "broken"


INST = Template({"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("[SYS] ", " [/SYS]")})


class Writer:
    """Texts to segments and back."""

    def __init__(self, template: Template):
        self.template = template
        self.control = re.compile("|".join(re.escape(c) for c in template.controls))
        self.opened = [(pair, role) for role, pair in template.marks.items()]

    def escape(self, text: str) -> str:
        """Double every backslash, then put one behind the first character of each control string."""
        return self.control.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))

    @staticmethod
    def restore(text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.S)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """What a turn becomes: (text, under the loss)."""
        own = self.template.marks.get(role)
        if own:
            before, after = own
        else:
            a, b, after = self.template.other
            before = a + self.escape(role).replace(">", "\\>") + b
        return [(before, False), (self.escape(text), role in self.template.loss), (after, False)]

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) turns of a formatted text: the marks alone say where turns begin and end."""
        turns, at = [], 0
        while at < len(formatted):
            for (before, after), role in sorted(self.opened, key=lambda x: -len(x[0][0])):
                if formatted.startswith(before, at):
                    begin = at + len(before)
                    break
            else:
                a, b, after = self.template.other
                if not formatted.startswith(a, at):
                    raise ValueError(f"no turn begins at {at}")
                name = re.compile(r"(?:[^\\>]|\\.)*", re.S).match(formatted, at + len(a))
                role, begin = self.restore(name[0]), name.end() + len(b)
            end = formatted.index(after, begin)
            turns.append((role, self.restore(formatted[begin:end])))
            at = end + len(after)
        return turns


def blocks(turns: DataFrame, template: Template, key: str, turn: str, role: str, text: str) -> DataFrame:
    """(key, part, block, n_turns, segments, leads): blocks in order of (part, block); leads[i] is where state i ends."""
    kind = turns.schema[key].dataType.simpleString()
    rows = turns.select(F.col(key).alias("key"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # Ties of a turn go by role and text; the hash stands before the text so that range bounds stay short.
    order = [F.col("key"), F.col("turn"), F.col("role"), F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())
    states = template.states

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(template)
        names = ["key", "part", "block", "n_turns", "segments", "leads"]
        types = [None, pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])), pa.list_(pa.int32())]
        done: list[list] = [[] for _ in names]
        number, current = 0, None

        def close():
            nonlocal number
            for column, value in zip(done, (current["key"], current["part"], number, current["n"], current["segments"], current["leads"])):
                column.append(value)
            number += 1

        for batch in batches:
            types[0] = batch.schema.field("key").type
            for k, r, t, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if current is None or current["key"] != k or current["n"] >= BLOCK_TURNS or current["chars"] >= BLOCK_CHARS:
                    if current:
                        close()
                    current = {"key": k, "part": part, "n": 0, "chars": 0, "segments": [], "leads": list(range(len(states)))}
                current["n"] += 1
                current["chars"] += len(t)
                current["segments"] += [{"text": s, "loss": loss} for s, loss in writer.segments(r, t)]
                current["leads"] = [states.index(template.step(states[s], r)) for s in current["leads"]]
            if len(done[0]) >= 64:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, types)], names)
                done = [[] for _ in names]
        if current:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, types)], names)

    return placed.mapInArrow(run, f"key {kind}, part int, block long, n_turns long, segments array<struct<text:string,loss:boolean>>, leads array<int>")


def format_conversations(turns: DataFrame, template: Template = INST, key: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """Formatted conversations in blocks: (key, block, n_turns, segments, valid).

    `block` numbers a conversation's blocks from 0, in the order of `turn` (nulls first; ties by role and text). `segments` is
    an array of (text, loss) whose texts, joined over all blocks, are the formatted conversation; loss marks the texts of
    the template's loss roles. `valid` says whether the machine accepts the whole conversation. Null texts and roles are
    empty; a role without marks is written with its name and makes a conversation invalid, as a wrong order does; invalid
    conversations are formatted all the same. Repeated rows are turns of their own. Rows with a null key form one
    conversation. An empty table gives an empty table; other columns are not read.
    """
    states = template.states
    start = states.index("start")
    scratch = Scratch(turns.sparkSession, "chat")
    made = scratch.table(blocks(turns, template, key, turn, role, text), "blocks")
    # The blocks of one conversation are few: hundreds of turns each.
    order = Window.partitionBy("key").orderBy("part", "block")
    maps = made.select("key", "part", "block", (F.row_number().over(order) - 1).cast("long").alias("place"), "leads")
    whole = maps.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "leads"))).alias("maps"))
    last = F.aggregate("maps", F.lit(start), lambda s, m: F.element_at(m["leads"], s + 1))
    good = F.array(*[F.lit(states.index(s)) for s in sorted(template.ends)])
    whole = whole.select(F.col("key").alias("_key"), F.array_contains(good, last).alias("valid"))
    numbered = made.join(maps.select(F.col("key").alias("_k"), F.col("part").alias("_p"), F.col("block").alias("_b"), "place"),
                         F.col("key").eqNullSafe(F.col("_k")) & (F.col("part") == F.col("_p")) & (F.col("block") == F.col("_b")))
    joined = numbered.join(whole, F.col("key").eqNullSafe(F.col("_key")))
    return joined.select(F.col("key").alias(key), F.col("place").alias("block"), "n_turns", "segments", "valid")


def read_back(formatted: DataFrame, template: Template = INST, key: str = "conv_id") -> DataFrame:
    """What the formatted text of each block says: (key, block, n_turns, turns, loss, chars).

    `turns` joins role, line feed, text and line feed of every turn, found by the marks; `loss` joins the unescaped texts
    under the loss; `chars` counts the code points of the formatted text.
    """
    kind = formatted.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(template)
        for batch in batches:
            out = []
            for segments in batch.column(2).to_pylist():
                whole = "".join(s["text"] for s in segments)
                turns = writer.read(whole)
                out.append((len(turns), "".join(f"{r}\n{t}\n" for r, t in turns),
                            "".join(writer.restore(s["text"]) for s in segments if s["loss"]), len(whole)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64())))],
                ["key", "block", "n_turns", "turns", "loss", "chars"])

    rows = formatted.select(F.col(key).alias("key"), "block", "segments")
    return rows.mapInArrow(run, f"key {kind}, block long, n_turns long, turns string, loss string, chars long").withColumnRenamed("key", key)

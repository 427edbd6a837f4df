import json

import pytest
from pyspark.sql import functions as F

from pairloom.operators.columns import SchemaError
from pairloom.plans.prepare import Loaded, Preparation

PREF = "_ord long, system string, prompt string, chosen string, rejected string"


def pref(spark, n=50):
    return spark.createDataFrame([(i, None if i % 2 else "s", f"p{i % 40}", f"c{i % 40}", f"r{i}") for i in range(n)], PREF).repartition(3)


def plan(df, extra=(), evaluation=None, **spec):
    return Preparation(Loaded(df), {"format": {"format_type": "raw"}, **spec}, [Loaded(*e) for e in extra], evaluation)


def test_whole_preparation(spark):
    df = pref(spark)
    train, held = plan(df, deduplicate=True, max_samples=30, test_size=0.1, system_prompt="S").prepare()
    prompts = [r["prompt"] for r in train.unionByName(held).orderBy("_ord").collect()]
    assert (train.count(), held.count()) == (27, 3) and prompts == [f"p{i}" for i in range(30)]
    assert {r["system"] for r in train.collect()} == {"S", "s"}
    staged = plan(df, deduplicate=True, max_samples=30, test_size=0.1, system_prompt="S").prepare(staged=True)
    assert sorted(map(tuple, staged[1].collect())) == sorted(map(tuple, held.collect()))


@pytest.mark.parametrize("staged", [True, False])
def test_a_large_cap_is_cut_by_ordinal(spark, staged, monkeypatch):
    from pairloom.plans import prepare

    monkeypatch.setattr(prepare, "WIDE", 5)
    train, held = plan(pref(spark), deduplicate=True, dedupe_strategy="prompt", max_samples=20, test_size=0.25).prepare(staged)
    assert sorted(r["_ord"] for r in train.unionByName(held).collect()) == list(range(20)) and held.count() == 5
    assert plan(pref(spark), max_samples=400, test_size=0).prepare(staged)[0].count() == 50


def test_evaluation_off(spark):
    train, held = plan(pref(spark), test_size=0).prepare()
    assert held is None and train.count() == 50


def test_explicit_evaluation_set_is_left_alone(spark):
    held_rows = spark.createDataFrame([(0, "q", "a", "b"), (1, "q", "a", "b")], "_ord long, question string, chosen string, rejected string")
    train, held = plan(pref(spark), evaluation=Loaded(held_rows, {"question": "prompt"}), deduplicate=True, max_samples=1, system_prompt="S").prepare()
    assert train.count() == 1 and held.count() == 2
    assert {r["system"] for r in held.collect()} == {"S"}


def test_sources_with_their_own_mapping(spark):
    extra = spark.createDataFrame([(0, "i", "o", "b")], "_ord long, input string, output string, bad string")
    prep = plan(pref(spark, 3), [(extra, {"input": "prompt", "output": "chosen", "bad": "rejected"})], test_size=0)
    train, _ = prep.prepare()
    assert [r["prompt"] for r in train.orderBy("_ord").collect()] == ["p0", "p1", "p2", "i"]
    page = prep.preview(2, 2)
    assert page.total == 4 and [r["prompt"] for r in page.rows.collect()] == ["p2", "i"]


def test_missing_columns_are_reported_before_any_job(spark):
    with pytest.raises(SchemaError):
        plan(pref(spark).drop("rejected")).prepare()
    with pytest.raises(SchemaError):
        plan(pref(spark).drop("chosen")).preview_formatted()
    plan(pref(spark).drop("rejected"), training_mode="sft").prepare()


def test_messages_source(spark):
    df = spark.createDataFrame([(0, [("user", "q"), ("assistant", "a")]), (1, [("user", "x"), ("assistant", "y")])],
                               "_ord long, messages array<struct<role:string,content:string>>")
    train, _ = plan(df, training_mode="sft", test_size=0).prepare()
    assert [(r["prompt"], r["chosen"], r["rejected"]) for r in train.orderBy("_ord").collect()] == [("q", "a", ""), ("x", "y", "")]
    with pytest.raises(SchemaError):
        Preparation(Loaded(df, convert=False), {"training_mode": "sft"}).prepare()


def test_mapping_onto_messages_is_not_converted(spark):
    df = spark.createDataFrame([(0, "p", "c", [("user", "q")])], "_ord long, prompt string, chosen string, talk array<struct<role:string,content:string>>")
    prep = Preparation(Loaded(df, {"talk": "messages"}), {"training_mode": "sft", "test_size": 0})
    assert "messages" in prep.prepare()[0].columns


def test_formatted_page(spark):
    prep = plan(pref(spark), format={"format_type": "mistral"})
    page = prep.preview_formatted(3, 10)
    assert page.total == 50 and [r["prompt"] for r in page.rows.orderBy("_ord").collect()] == ["[INST] s\n\np10 [/INST] ", "[INST] p11 [/INST] ", "[INST] s\n\np12 [/INST] "]


def test_unpaired(spark):
    df = pref(spark, 20).withColumn("rejected", F.when(F.col("_ord") < 5, F.lit(" ")).otherwise(F.col("rejected")))
    chat = {"format": {"format_type": "chatml"}, "training_mode": "kto", "test_size": 0.1}
    train, held = Preparation(Loaded(df), chat).prepare_unpaired()
    assert train.count() + held.count() == 40 and train.columns == ["prompt", "response", "label"]
    train, held = Preparation(Loaded(df), chat).prepare_unpaired(raw_negatives=True)
    assert train.unionByName(held).where(~F.col("label")).count() == 15
    train, held = Preparation(Loaded(df.drop("rejected")), chat).prepare_unpaired(raw_negatives=True)
    assert train.unionByName(held).where(~F.col("label")).count() == 0


def test_stats(spark):
    stats = plan(pref(spark), training_mode="dpo").stats()
    assert set(stats) == {"overview", "fields", "tokens", "balance"}
    assert stats["overview"].first()["columns"] == ["system", "prompt", "chosen", "rejected"]
    assert "balance" not in plan(pref(spark).drop("rejected"), training_mode="sft").stats()


def test_from_files(spark, tmp_path):
    rows = [{"instruction": f"i{n}", "output": f"o{n}"} for n in range(12)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "b.json").write_text(json.dumps([{"prompt": "p", "chosen": "c"}], indent=1))
    spec = {"source": {"source_type": "local_file", "file_path": str(tmp_path / "a.jsonl")}, "column_mapping": {"instruction": "prompt", "output": "chosen"},
            "additional_sources": [{"source_type": "local_file", "file_path": str(tmp_path / "b.json")}],
            "training_mode": "sft", "test_size": 0, "format": {"format_type": "raw"}}
    train, _ = Preparation.from_spec(spark, spec).prepare()
    assert [r["prompt"] for r in train.orderBy("_ord").collect()] == [f"i{n}" for n in range(12)] + ["p"]
    spec |= {"eval_source": {"source_type": "local_file", "file_path": str(tmp_path / "a.jsonl")}}
    _, held = Preparation.from_spec(spark, spec).prepare()
    assert held.count() == 12 and held.where("prompt LIKE 'i%'").count() == 12
    with pytest.raises(ValueError):
        Preparation.from_spec(spark, {})

import pytest
from pyspark.sql import functions as F

from pairloom.operators import columns as C
from pairloom.operators.reshape import MAX_SOURCES, concat_sources, kto_explode, label_counts, place_source
from tests.conftest import EDGE_TEXTS


def frame(spark, *names):
    return spark.createDataFrame([tuple(names)], ", ".join(f"`{n}` string" for n in names))


def test_synonyms():
    assert C.suggest_mapping(["Instruction", "response", "output", "Thought"]) == {
        "Instruction": "prompt", "output": "chosen", "Thought": "reasoning"}
    assert C.suggest_mapping(["prompt", "question", "chosen"]) == {}
    assert C.suggest_mapping(["PROMPT"]) == {"PROMPT": "prompt"}


def test_rename(spark):
    df = frame(spark, "a", "b", "d")
    assert C.rename(df, {"a": "c", "absent": "x", "b": "b", "c": "e"}).columns == ["e", "b", "d"]
    assert C.rename(df, None).columns == ["a", "b", "d"]
    with pytest.raises(C.SchemaError):
        C.rename(df, {"a": "b"})


@pytest.mark.parametrize("mode,needed", [("sft", 2), ("kto", 2), ("orpo", 3), ("dpo", 3), ("ipo", 3)])
def test_required_columns(spark, mode, needed):
    df = frame(spark, "prompt", "chosen", "rejected")
    assert len(C.required_columns(mode)) == needed
    assert C.check_columns(df, mode) is df
    if needed == 3:
        with pytest.raises(C.SchemaError, match="rejected"):
            C.check_columns(df.drop("rejected"), mode)
    else:
        C.check_columns(df.drop("rejected"), mode)


def test_system_prompt(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(EDGE_TEXTS)], "id int, system string")
    filled = [r[0] for r in C.set_system(df, "P").orderBy("id").select("system").collect()]
    assert filled == [v if v is not None and v.strip() else "P" for v in EDGE_TEXTS]
    assert {r[0] for r in C.set_system(df, "P", "replace_all").select("system").collect()} == {"P"}
    assert C.set_system(df, "") is df and C.set_system(df, None) is df
    assert C.set_system(df.drop("system"), "P").where("system = 'P'").count() == len(EDGE_TEXTS)


def test_concatenation(spark):
    a = spark.createDataFrame([(0, "p0", "c0"), (1, "p1", "c1")], "_ord long, prompt string, chosen string")
    b = spark.createDataFrame([(0, "p2", "r2")], "_ord long, prompt string, rejected string")
    out = concat_sources([a, b]).orderBy("_ord").collect()
    assert [(r["prompt"], r["chosen"], r["rejected"], r["_src"]) for r in out] == [
        ("p0", "c0", None, 0), ("p1", "c1", None, 0), ("p2", None, "r2", 1)]
    place_source(a, MAX_SOURCES - 1).orderBy("_ord").collect()
    with pytest.raises(ValueError):
        place_source(a, MAX_SOURCES)


def test_unpaired_rows(spark):
    df = spark.createDataFrame([(i, "p", "c", v) for i, v in enumerate(EDGE_TEXTS)], "id int, prompt string, chosen string, rejected string")
    got = kto_explode(df, keep=["id"])
    assert got.columns == ["id", "prompt", "response", "label"]
    negatives = [r["response"] for r in got.where(~F.col("label")).orderBy("id").collect()]
    assert negatives == [v for v in EDGE_TEXTS if v and v.strip()]
    assert {tuple(r) for r in label_counts(got).collect()} == {(True, len(EDGE_TEXTS)), (False, len(negatives))}
    assert kto_explode(df.drop("rejected")).columns == ["prompt", "response", "label"]
    assert kto_explode(df.drop("rejected")).count() == len(EDGE_TEXTS)

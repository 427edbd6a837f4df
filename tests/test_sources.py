import json

import pytest
from pyspark.sql import functions as F

from pairloom.operators.split import split
from pairloom.sources import read as S
from pairloom.sources.spec import PrepareSpec, SourceSpec, SpecError, infer_format
from pairloom.sources.write import write_splits, write_table

ROWS = [{"prompt": f"p{i}", "chosen": f"line\n\"{i}\", with comma", "rejected": None if i % 2 else ""} for i in range(6)]


def in_order(df):
    return [(r["prompt"], r["chosen"]) for r in df.orderBy("_ord").collect()]


WANT = [(r["prompt"], r["chosen"]) for r in ROWS]


def test_json_lines_document_and_object(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, ROWS)))
    (tmp_path / "b.JSON").write_text(json.dumps(ROWS, indent=2))
    (tmp_path / "c.json").write_text("\n".join(map(json.dumps, ROWS)))
    (tmp_path / "d.json").write_text(json.dumps(ROWS[0], indent=1))
    (tmp_path / "e.json").write_text(json.dumps(ROWS))
    for name in ("a.jsonl", "b.JSON", "c.json", "e.json"):
        assert in_order(S.read_file(spark, str(tmp_path / name))) == WANT, name
    assert in_order(S.read_file(spark, str(tmp_path / "d.json"))) == WANT[:1]
    assert S.is_json_lines(spark, str(tmp_path / "c.json")) and not S.is_json_lines(spark, str(tmp_path / "b.JSON"))
    explicit = S.read_file(spark, str(tmp_path / "a.jsonl"), "jsonl", "prompt string, chosen string")
    assert explicit.columns == ["prompt", "chosen", "_ord"] and in_order(explicit) == WANT


def test_csv_and_parquet(spark, tmp_path):
    import pandas as pd

    pd.DataFrame(ROWS).to_csv(tmp_path / "a.csv", index=False)
    pd.DataFrame(ROWS).to_parquet(tmp_path / "a.pq")
    assert in_order(S.read_file(spark, str(tmp_path / "a.csv"))) == WANT
    assert in_order(S.read_file(spark, str(tmp_path / "a.pq"))) == WANT
    renamed = tmp_path / "table.dat"
    renamed.write_bytes((tmp_path / "a.pq").read_bytes())
    assert in_order(S.read_file(spark, str(renamed), "parquet")) == WANT


def test_formats(spark, tmp_path):
    assert [infer_format(p) for p in ("x.JSON", "x.jsonl", "a/b.Csv", "x.parquet", "x.pq")] == ["json", "json", "csv", "parquet", "parquet"]
    assert infer_format("x.txt", "jsonl") == "jsonl"
    for path, kind in (("x.txt", None), ("x", None), ("x.json", "xml")):
        with pytest.raises(SpecError):
            infer_format(path, kind)
    with pytest.raises(FileNotFoundError):
        S.read_file(spark, str(tmp_path / "absent.parquet"))
    with pytest.raises(FileNotFoundError):
        S.read_file(spark, str(tmp_path / "absent.json"))


@pytest.mark.parametrize("kind", ["json", "csv", "parquet"])
def test_ordinals_follow_file_and_row_order(spark, tmp_path, kind):
    # The larger file comes second by name, and Spark would pack it first.
    for name, low, high in (("a", 0, 50), ("b", 50, 2000), ("c", 2000, 2100)):
        df = spark.range(low, high).coalesce(1).select(F.col("id").cast("string").alias("v"))
        getattr(df.write.options(header=True) if kind == "csv" else df.write, kind)(str(tmp_path / name))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = S.read_file(spark, f"{tmp_path}/*/part*", kind, "v string", **({"multiLine": False} if kind != "parquet" else {}))
        assert [int(r["v"]) for r in df.orderBy("_ord").collect()] == list(range(2100))
        assert df.select("_ord").distinct().count() == 2100
        spark.conf.set("spark.sql.files.maxPartitionBytes", "800")   # as if cores came or went
        assert [int(r["v"]) for r in df.orderBy("_ord").collect()] == list(range(2100))
        lineage = S.read_file(spark, f"{tmp_path}/*/part*", kind, "v string", lineage=True)
        assert lineage.select("_file").distinct().count() == 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.fixture
def hub(spark, tmp_path):
    for config, low in (("default", 0), ("hard", 100)):
        for part in range(2):
            path = tmp_path / "org/data" / config / f"train-{part}.parquet"
            spark.range(low + 10 * part, low + 10 * part + 10).coalesce(1).write.parquet(str(path))
    spark.range(0).coalesce(1).write.parquet(str(tmp_path / "org/data/default/empty-0.parquet"))
    return str(tmp_path)


def test_named_datasets(spark, hub):
    def ids(df):
        return [r["id"] for r in df.orderBy("_ord").collect()]

    for config in (None, ""):
        assert ids(S.read_named(spark, hub, "org/data", config_name=config)) == list(range(20))
    assert ids(S.read_bounded(spark, hub, "org/data", config_name="hard", max_samples=13)) == list(range(100, 113))
    assert ids(S.read_bounded(spark, hub, "org/data", max_samples=0)) == list(range(20))
    with pytest.raises(ValueError, match="no rows"):
        S.read_bounded(spark, hub, "org/data", "empty", schema="id long")
    assert S.read_named(spark, hub, "org/data", "empty", schema="id long").count() == 0
    with pytest.raises(FileNotFoundError):
        S.read_named(spark, hub, "org/data", "validation")


def test_dispatch(spark, hub, tmp_path):
    assert S.read_source(spark, {"source_type": "huggingface", "repo_id": "org/data"}, hub).count() == 20
    streaming = SourceSpec("huggingface", "org/data", streaming=True)
    assert S.read_source(spark, streaming, hub, max_samples=7).count() == 7
    (tmp_path / "up.jsonl").write_text('{"prompt": "p"}\n')
    upload = {"source_type": "upload", "dataset_id": "u"}
    assert S.read_source(spark, upload, uploads={"u": str(tmp_path / "up.jsonl")}).count() == 1
    for bad in ({"source_type": "huggingface"}, {"source_type": "local_file"}, {"source_type": "upload"}, {"source_type": "ftp"},
                {"source_type": "local_file", "file_path": "x.doc"}, {"source_type": "huggingface", "repo_id": "r", "streaming_batch_size": 5}):
        with pytest.raises(SpecError):
            S.read_source(spark, bad)
    with pytest.raises(SpecError, match="not found"):
        S.read_source(spark, upload, uploads={})


def test_descriptions():
    assert SourceSpec("huggingface", "r", config_name="").describe() == {
        "source_type": "huggingface", "repo_id": "r", "split": "train", "config_name": None}
    assert SourceSpec("huggingface", "r", streaming=True).describe()["batch_size"] == 10_000
    assert SourceSpec("local_file", file_path="a.jsonl").describe() == {"source_type": "local_file", "file_path": "a.jsonl", "file_format": "json"}
    assert SourceSpec("upload", dataset_id="u").describe()["dataset_id"] == "u"


def test_prepare_spec():
    spec = PrepareSpec.of({"source": {"source_type": "local_file", "file_path": "a.csv"}, "format": {"format_type": "llama3"}, "training_mode": "DPO"})
    assert spec.test_size == 0.01 and spec.format.format_type == "llama3" and spec.training_mode == "dpo"
    for bad in ({"training_mode": "ppo"}, {"test_size": 0.9}, {"system_prompt_mode": "append"}):
        with pytest.raises(SpecError):
            PrepareSpec.of(bad)


def test_inspection(spark, hub):
    info = S.inspect_columns(S.read_named(spark, hub, "org/data"))
    assert info == {"columns": ["id"], "samples": [{"id": 0}, {"id": 1}, {"id": 2}], "total_rows": 20}


def test_writing(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("_ord"), F.lit("p").alias("prompt"))
    paths = write_splits(*split(df, 0.1), str(tmp_path / "out"))
    assert spark.read.parquet(paths["train"]).count() == 36 and spark.read.parquet(paths["eval"]).columns == ["prompt"]
    assert set(write_splits(df, None, str(tmp_path / "one"), "json", keep_ord=True)) == {"train"}
    with pytest.raises(ValueError):
        write_table(df, str(tmp_path / "x"), "xlsx")

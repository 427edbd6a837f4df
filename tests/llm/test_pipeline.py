import os

import pytest

import corpus_pipeline
from pairloom.llm.queries import ORACLES, QUERIES

from .conftest import text

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaks int, score int"


def test_stages_keep_clean_documents(spark, tmp_path):
    passage, item = text(70, 60), text(71, 40) + "."
    clean = [(i, text(i, 60 + i)) for i in range(20)]
    near = [(30, text(0, 60)), (31, text(0, 59))]
    shared = [(40 + i, f"{text(200 + i, 40)}\n{passage}") for i in range(3)]
    leaked = [(50, f"{text(300, 30)} {item} {text(301, 30)}")]
    bad = [(60, None), (61, ""), (62, "12 34 !!")]
    rows = [(i, t, "en", "s", len(t or ""), 1, 2) for i, t in clean + near + shared + leaked + bad]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, str(tmp_path))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == docs.columns and [f.dataType for f in made.schema] == [f.dataType for f in docs.schema]
        made.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    every = {i for i, _ in clean + near + shared + leaked}
    assert set(kept["language_id"]) == every
    assert set(kept["near_dedup"]) == every - {30, 31}
    texts = {i: r["text"] for i, r in kept["substring_dedup"].items()}
    assert set(texts) == every - {30, 31} and {i: texts[i] for i, _ in clean} == dict(clean)
    assert passage in texts[40] and len(texts[41]) < len(dict(shared)[41]) - 150 and kept["substring_dedup"][41]["n_chars"] == len(texts[41])
    assert set(kept["decontaminate"]) == every - {30, 31, 50}
    assert set(kept["pack"]) == every - {30, 31, 50}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept["pack"])


@pytest.mark.parametrize("lang", [None, "und"])
def test_documents_without_a_learned_language_stay(spark, lang):
    rows = [(i, t, lang, None, None, 1, 2) for i, t in enumerate(["clean words here", "clean words here", "日本語", "12 !", "", None])]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables are not there")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    import glob

    import duckdb

    from scripts.check import rows_of
    con = duckdb.connect()
    for path in glob.glob("/root/testdata/sf0.001/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    result = con.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, result.fetchall())

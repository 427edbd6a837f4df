"""Tables that queries write out: the share of one file, and so of one task, does not grow with the table."""

import pytest
from pyspark.sql import functions as F

from catalog import corpora, telemetry, views


@pytest.fixture
def wide(spark, tmp_path, monkeypatch):
    """600 documents of 1,000 bytes, where a file takes 32 KB of text."""
    monkeypatch.setattr(views, "FILE_BYTES", 32 << 10)
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word\n \"a\" "), 100).alias("text"), F.lit("en").alias("lang"),
                                   F.lit("src1").alias("source"), F.lit(1000).cast("long").alias("n_chars"))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def files_of(df):
    return len(df.inputFiles())


def test_files_grow_in_number(spark, wide):
    docs = views.table(spark, wide, "documents")
    assert views.file_count(docs) >= 18 and views.file_count(docs.limit(1)) == 4 and views.file_count(docs.where("false")) == 4
    assert files_of(views.sharded(docs, "doc_id", "growth").rows()) >= 16
    assert files_of(spark.read.text(corpora._manifest(spark, wide))) >= 16
    assert files_of(spark.read.text(corpora._half_broken(spark, wide))) >= 16


def test_arrays_and_streams_grow_in_files(spark, wide):
    assert files_of(spark.read.text(corpora._arrays(spark, wide, "growth", "[", "]"))) >= 16
    assert corpora.read_json_document(spark, wide).count() == 600
    out = corpora.stream_formatted(spark, wide)
    assert out.count() == 600 and out.select("doc_id").distinct().count() == 600


def test_streams_take_lots_of_several_files_in_order(spark, tmp_path, monkeypatch):
    """Ids leave out most of the second lot and all of the third: their files are filled up, so batches keep to the lots."""
    monkeypatch.setattr(telemetry, "ROWS", 20)
    ids = [*range(200), 210, 211, *range(800, 1000)]
    rows = [(i, i % 3, '{"k": %d}' % (i * 7919 % 1000)) for i in ids] + [(399, 0, '{"k": 5000}')]
    events = spark.createDataFrame(rows, "event_id long, user_id long, props string").selectExpr(
        "event_id", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "user_id", "'click' AS event_type", "1.0D AS value", "props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    files = -(-len(rows) // 80)
    got = telemetry._stream(spark, str(tmp_path))
    assert got.isStreaming and files > 1
    want, best = set(), {}
    for i, run, props in sorted(rows):
        step = int(props[6:-1])
        if step > best.get(run, -1):
            want.add((run, i, step))
            best[run] = step
    out = telemetry.stream_monotone_steps(spark, str(tmp_path))
    assert {(r["job_id"], r["event_id"], r["step"]) for r in out.collect()} == want
    assert spark.read.parquet(got_path(spark, telemetry, tmp_path)).count() == len(rows)


def got_path(spark, module, folder):
    """The folder a stream of the folder's events reads; its files are four lots of the same number."""
    paths = []
    original = module.scratch_path
    module.scratch_path = lambda s, label: paths.append(original(s, label)) or paths[-1]
    try:
        module._stream(spark, str(folder))
    finally:
        module.scratch_path = original
    rows = spark.read.parquet(paths[0]).count()
    assert module._files(spark, paths[0]) == 4 * -(-rows // 80)
    return paths[0]

"""Readers, sinks, manifests, and the preparation of streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.registry import query
from catalog.views import ID, PAIRS, conv, file_count, table
from pairloom.functions.templates import describe_formats, formatter
from pairloom.operators.edits import apply_edits, delete_rows, edit_report, edit_values, rewrite_in_place, rewrite_manifest
from pairloom.operators.order import number_rows
from pairloom.operators.vision import (build_manifest, caption_messages, manifest_page, parse_object, prepare_captions,
                                       prepare_unified, preview_manifest, read_lines, read_manifest)
from pairloom.plans.prepare import Loaded, Preparation
from pairloom.operators.split import split
from pairloom.session import scratch_path
from pairloom.sources.read import inspect_columns, open_table, read_file, read_named, read_source, stream_named
from pairloom.sources.records import read_array, read_quoted_csv
from pairloom.sources.write import write_splits
from pairloom.streaming.progress import disk_state, drop_repeats

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
_ALL = "SELECT doc_id, text, lang, source, n_chars FROM documents"
_PLACED = "SELECT doc_id, doc_id AS position, text FROM documents"


def _documents(spark, d, parts=None):
    """Documents in doc_id order over several files."""
    docs = table(spark, d, "documents")
    return docs.repartitionByRange(parts or file_count(docs), ID).sortWithinPartitions(ID)


def _arrays(spark, d, label, opening, closing):
    """Documents as text files that each hold one JSON array."""
    path, docs = scratch_path(spark, label), table(spark, d, "documents")
    rows = F.to_json(F.struct(*[F.col(c) for c in ("doc_id", "text", "lang", "source", "n_chars")]), {"ignoreNullFields": "false"})
    parts = docs.groupBy((F.col(ID) % file_count(docs, 8)).alias("part")).agg(F.array_join(F.collect_list(rows), ",\n").alias("rows"))
    parts.select(F.concat(F.lit(opening), "rows", F.lit(closing))).write.option("maxRecordsPerFile", 1).text(path)
    return f"{path}/*.txt"


def _placed(df):
    return number_rows(df.select(F.col(ID).cast("long").alias(ID), "text", "_ord"), "_ord", into="position").select(ID, "position", "text")


@query("read_json_lines", _PLACED)
def read_json_lines(spark, d):
    path = scratch_path(spark, "lines")
    _documents(spark, d).write.json(path)
    return _placed(read_file(spark, f"{path}/*.json"))


@query("read_csv", _PLACED)
def read_csv(spark, d):
    path = scratch_path(spark, "csv")
    _documents(spark, d).write.csv(path, header=True, escape='"', quoteAll=True)
    return _placed(read_file(spark, f"{path}/*.csv"))


@query("read_parquet", _PLACED)
def read_parquet(spark, d):
    path = scratch_path(spark, "parquet")
    _documents(spark, d).write.parquet(path)
    return _placed(read_source(spark, {"source_type": "local_file", "file_path": path, "file_format": "parquet"}, schema=DOC))


@query("read_upload", _ALL)
def read_upload(spark, d):
    """A landed upload, found by its id."""
    landed = {"u1": f"{d}/documents.parquet"}
    df = read_source(spark, {"source_type": "upload", "dataset_id": "u1"}, uploads=landed)
    return df.select(ID, "text", "lang", "source", "n_chars")


def _config():
    """The config of a document in the exported dataset."""
    return F.coalesce("lang", F.lit("without-language"))


def _hub(spark, d):
    """Documents exported as a named dataset: one config per language and one without, splits by range of files."""
    root = scratch_path(spark, "hub")
    docs = _documents(spark, d)
    for lang in _languages(spark, d):
        docs.where(_config() == lang).write.parquet(f"{root}/docs/{lang}/train-0.parquet")
    return root


def _languages(spark, d):
    """The languages of the documents: a handful, each the name of a config."""
    return sorted(r[0] for r in table(spark, d, "documents").select(_config()).distinct().collect())


@query("read_named", "SELECT doc_id, lang, text FROM documents")
def read_named_split(spark, d):
    """Every config of the exported dataset, one after the other."""
    root = _hub(spark, d)
    parts = [read_named(spark, root, "docs", "train", lang).select(ID, "lang", "text") for lang in _languages(spark, d)]
    return reduce(DataFrame.unionByName, parts)


@query("read_named_bounded", "SELECT doc_id, text FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 150")
def read_named_bounded(spark, d):
    spec = {"source_type": "huggingface", "repo_id": "docs", "config_name": "en", "streaming": True}
    return read_source(spark, spec, hub_root=_hub(spark, d), max_samples=150).select(ID, "text")


@query("read_bounded_events", "SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 25000")
def read_bounded_events(spark, d):
    """The first 25,000 rows of a dataset of many shards."""
    root = scratch_path(spark, "shards")
    events = table(spark, d, "events").repartitionByRange(16, "event_id").sortWithinPartitions("event_id")
    events.write.parquet(f"{root}/events/default/train-0.parquet")
    spec = {"source_type": "huggingface", "repo_id": "events", "streaming": True}
    return read_source(spark, spec, hub_root=root, max_samples=25_000).select("event_id", "user_id", "value")


@query("source_lineage", "SELECT 'documents.parquet' AS file, count(*) AS rows FROM documents")
def source_lineage(spark, d):
    read = read_file(spark, f"{d}/documents.parquet", lineage=True)
    return read.groupBy(F.regexp_extract("_file", "[^/]+$", 0).alias("file")).agg(F.count("*").alias("rows"))


@query("write_splits", "SELECT doc_id, text FROM documents")
def written_splits(spark, d):
    train, held = split(table(spark, d, "documents").select(ID, "text"), 0.1, ord=ID)
    paths = write_splits(train, held, scratch_path(spark, "splits"), "json")
    schema = "doc_id bigint, text string"
    return spark.read.schema(schema).json(paths["train"]).unionByName(spark.read.schema(schema).json(paths["eval"]))


# ---- manifests -----------------------------------------------------------------------------------------

def _manifest(spark, d):
    """Documents as an image manifest in doc_id order, with a blank line after every row and some broken rows."""
    doc = F.to_json(F.struct(F.concat(F.lit("img/"), F.col(ID).cast("string"), F.lit(".png")).alias("image"),
                             F.col("text").alias("prompt"), "lang"))
    line = F.when(F.col("source") == "src3", F.concat(F.lit("{broken "), F.col(ID).cast("string"))).otherwise(doc)
    path = scratch_path(spark, "manifest")
    (_documents(spark, d).select(ID, F.posexplode(F.array(line, F.lit(" "))).alias("_i", "value"))
     .sortWithinPartitions(ID, "_i").select("value").write.text(path))
    return f"{path}/*.txt"


_LINES = """lines AS (SELECT doc_id, source = 'src3' AS broken, text AS prompt, lang FROM documents)"""


@query("manifest_lines", f"WITH {_LINES} SELECT doc_id AS row_index, broken, CASE WHEN NOT broken THEN prompt END AS prompt FROM lines")
def manifest_lines(spark, d):
    row = parse_object(F.col("line"))
    return read_lines(spark, _manifest(spark, d)).select(
        "row_index", row.isNull().alias("broken"), F.variant_get(row[F.lit("prompt")], "$", "string").alias("prompt"))


@query("preview_manifest", f"""
WITH {_LINES}
SELECT doc_id AS row_index, prompt, 'img/' || doc_id || '.png' AS image, 'image' AS image_field, 'prompt' AS caption_field
FROM lines WHERE NOT broken AND doc_id >= 30 ORDER BY doc_id LIMIT 24""")
def manifest_preview(spark, d):
    page = preview_manifest(read_lines(spark, _manifest(spark, d)), offset=30)
    return page.select("row_index", "prompt", F.regexp_extract("image_path", "img/.*$", 0).alias("image"), "image_field", "caption_field")


def _edits(spark, d):
    labels = table(spark, d, "labels")
    edits = labels.where("quality = 1").select(F.col(ID).alias("row_index"), F.concat(F.lit("caption of "), F.col(ID).cast("string")).alias("prompt"))
    return edits, labels.where("toxic = 1").select(F.col(ID).alias("row_index"))


_EDITED = f"""{_LINES}, e AS (
  SELECT l.*, coalesce(b.quality, 0) = 1 AS hit FROM lines l LEFT JOIN labels b USING (doc_id) WHERE coalesce(b.toxic, 0) <> 1)"""


@query("manifest_edits", f"""
WITH {_EDITED}
SELECT doc_id AS row_index, hit AND NOT broken AS edited, CASE WHEN broken THEN '{{broken ' || doc_id END AS broken_line,
       CASE WHEN broken THEN NULL WHEN hit THEN 'caption of ' || doc_id ELSE prompt END AS prompt,
       CASE WHEN NOT broken THEN lang END AS lang FROM e""")
def manifest_edits(spark, d):
    edits, deletes = _edits(spark, d)
    edited = apply_edits(read_lines(spark, _manifest(spark, d)), edits, deletes)
    row = parse_object(F.col("line"))
    return edited.select("row_index", "edited", F.when(row.isNull(), F.col("line")).alias("broken_line"),
                         *[F.variant_get(row[F.lit(k)], "$", "string").alias(k) for k in ("prompt", "lang")])


@query("manifest_edit_report", f"""
WITH {_EDITED}
SELECT (SELECT count(*) FROM documents) AS total_before, count(*) AS total_after, count(*) FILTER (WHERE hit AND NOT broken) AS edited,
       (SELECT count(DISTINCT doc_id) FROM labels WHERE toxic = 1) AS deleted FROM e""")
def manifest_edit_report(spark, d):
    edits, deletes = _edits(spark, d)
    lines = read_lines(spark, _manifest(spark, d))
    return edit_report(lines, edits, deletes)


@query("edit_rows", """
SELECT d.doc_id, coalesce('quality ' || l.quality, d.text) AS text FROM documents d LEFT JOIN labels l USING (doc_id)""")
def edit_rows(spark, d):
    edits = table(spark, d, "labels").select(ID, F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("prompt"))
    return edit_values(table(spark, d, "documents"), edits, "text", row=ID).select(ID, "text")


@query("remove_rows", "SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def remove_rows(spark, d):
    return delete_rows(table(spark, d, "documents"), table(spark, d, "labels").where("toxic = 1"), ID).select(ID, "text")


@query("image_manifest", f"""
WITH {_LINES} SELECT 'img/' || doc_id || '.png' AS image, prompt, lang FROM lines WHERE NOT broken""")
def image_manifest(spark, d):
    df = read_manifest(spark, _manifest(spark, d), "image string, prompt string, lang string", on_error="drop")
    kept = df.where(F.col("image").isNotNull())
    return kept.select(F.regexp_extract("chosen", "img/.*$", 0).alias("image"), "prompt", "lang")


@query("build_manifest", """
SELECT '/data/' || lang || '/' || source || '_pic-' || d.doc_id || '.png' AS image,
       coalesce('label ' || l.quality, source || ' pic ' || d.doc_id) AS prompt
FROM documents d LEFT JOIN labels l USING (doc_id)""")
def manifest(spark, d):
    name = F.concat("source", F.lit("_pic-"), F.col(ID).cast("string"), F.lit(".png"))
    docs = table(spark, d, "documents")
    files = docs.select(F.concat(F.lit("/data/"), "lang", F.lit("/"), name).alias("path"))
    captions = (docs.join(table(spark, d, "labels"), ID)
                .select(name.alias("name"), F.concat(F.lit("label "), F.col("quality").cast("string")).alias("caption")))
    return build_manifest(files, captions)


@query("caption_messages", """
SELECT doc_id, 1 AS images, 'user,assistant' AS roles, 'image,text' AS parts, 'Describe it.' AS asked, text AS caption FROM documents""")
def captions(spark, d):
    df = table(spark, d, "documents").select(ID, F.encode("source", "UTF-8").alias("image"), F.col("text").alias("caption"))
    m = F.col("messages")
    return caption_messages(df, "Describe it.").select(
        ID, F.size("images").alias("images"), F.array_join("messages.role", ",").alias("roles"),
        F.array_join(m[0]["parts"]["type"], ",").alias("parts"), m[0]["parts"][1]["text"].alias("asked"), m[1]["content"].alias("caption"))


@query("caption_corpus", """
SELECT doc_id, source AS image, 'Describe it.' AS asked, text AS caption,
       (SELECT CAST(ceil(0.02 * count(*)) AS BIGINT) FROM documents) AS eval_rows FROM documents""")
def caption_corpus(spark, d):
    """Every row of both sides, with the size of the evaluation side."""
    df = table(spark, d, "documents").select(ID, F.encode("source", "UTF-8").alias("image"), F.col("text").alias("caption"))
    train, held = prepare_captions(df, "Describe it.", test_size=0.02, ord=ID)
    m = F.col("messages")
    return train.unionAll(held).select(
        ID, F.decode(F.col("images")[0], "UTF-8").alias("image"), m[0]["parts"][1]["text"].alias("asked"),
        m[1]["content"].alias("caption"), F.lit(held.count()).cast("bigint").alias("eval_rows"))


@query("unified_corpus", """
SELECT doc_id, lang AS asked, text AS answer, 0 AS images FROM documents
WHERE length('[{"role":"user","content":"' || lang || '"},{"role":"assistant","content":' || CAST(to_json(text) AS VARCHAR) || '}]') <= 8192""")
def unified_corpus(spark, d):
    turns = F.array(F.struct(F.lit("user").alias("role"), F.col("lang").alias("content")),
                    F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")))
    df = table(spark, d, "documents").select(ID, F.to_json(turns).alias("messages"), F.lit(None).cast("binary").alias("image"))
    train, held = prepare_unified(df, max_seq_length=2048, test_size=0.05, ord=ID)
    said = lambda i: F.variant_get(F.col("messages")[i]["content"], "$", "string")
    return train.unionByName(held).select(ID, said(0).alias("asked"), said(1).alias("answer"), F.size("images").alias("images"))


@query("inspect_columns", """
SELECT doc_id, text, lang, source, n_chars, (SELECT count(*) FROM documents) AS total_rows FROM documents ORDER BY doc_id LIMIT 3""")
def inspected(spark, d):
    """The sampled rows and the number of all rows."""
    path = scratch_path(spark, "inspected")
    _documents(spark, d).write.parquet(path)
    info = inspect_columns(open_table(spark, path))
    rows = [(*(r[c] for c in info["columns"]), info["total_rows"]) for r in info["samples"]]
    return spark.createDataFrame(rows, f"{DOC}, total_rows bigint")


@query("read_json_document", _ALL)
def read_json_document(spark, d):
    """A file that is one JSON array: its rows are found however many lines it spans."""
    path = _arrays(spark, d, "document", "[\n", "\n]")
    return read_file(spark, path, "json", DOC).select(ID, "text", "lang", "source", "n_chars")


@query("read_json_array", _ALL)
def read_json_array(spark, d):
    """The same documents out of JSON arrays that are cut in splits, object by object."""
    path = _arrays(spark, d, "array", "[", "]")
    return read_array(spark, path, DOC, {"mode": "FAILFAST"}).select(ID, "text", "lang", "source", "n_chars")


@query("read_quoted_csv", _PLACED)
def read_csv_in_splits(spark, d):
    """Records over several lines, found by counting quotes."""
    path = scratch_path(spark, "quoted")
    _documents(spark, d).write.csv(path, header=True, escape='"', quoteAll=True)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("doc_id", "text", "lang", "source", "n_chars")])
    return _placed(read_quoted_csv(spark, f"{path}/*.csv", schema, {"header": True, "escape": '"', "mode": "FAILFAST"}))


def _half_broken(spark, d):
    """Documents as JSON lines, those of one source cut off in the middle."""
    path = scratch_path(spark, "broken")
    line = F.to_json(F.struct(ID, "text"))
    cut = F.when(F.col("source") == "src3", F.concat(F.lit('{"doc_id": '), F.col(ID).cast("string"))).otherwise(line)
    _documents(spark, d).select(cut).write.text(path)
    return f"{path}/*.txt"


@query("read_broken_dropped", "SELECT doc_id, text FROM documents WHERE source IS DISTINCT FROM 'src3'")
def read_broken_dropped(spark, d):
    return read_file(spark, _half_broken(spark, d), "jsonl", "doc_id bigint, text string", on_error="drop").select(ID, "text")


@query("read_broken_kept", """
SELECT CASE WHEN source IS DISTINCT FROM 'src3' THEN text END AS text,
       CASE WHEN source = 'src3' THEN '{"doc_id": ' || doc_id END AS error FROM documents""")
def read_broken_kept(spark, d):
    df = read_file(spark, _half_broken(spark, d), "jsonl", "doc_id bigint, text string", on_error="quarantine")
    return df.select("text", F.col("_error").alias("error"))


@query("prepare_messages", f"""
WITH {PAIRS} SELECT conv_id, prompt, chosen FROM pairs WHERE prompt <> '' AND chosen <> ''""")
def prepare_messages(spark, d):
    """A messages source in a preparation: told by its schema, though its first conversation is empty."""
    talks = conv(spark, d)
    empty = talks.limit(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.slice("messages", 1, 0).alias("messages"))
    rows = empty.unionByName(talks).withColumnRenamed("conv_id", "_ord")
    spec = {"training_mode": "sft", "test_size": 0, "on_error": "drop", "format": {"format_type": "raw"}}
    train, _ = Preparation(Loaded(rows, None, True), spec).prepare()
    return train.select(F.col("_ord").alias("conv_id"), "prompt", "chosen")


@query("describe_formats", """
SELECT f.name AS format, CAST(count(*) AS BIGINT) AS rows FROM documents,
       (VALUES ('chatml'), ('llama3'), ('mistral'), ('qwen3'), ('raw')) f(name) GROUP BY 1""")
def described(spark, d):
    """The descriptor of each format beside the rows it formats."""
    docs = table(spark, d, "documents").select(F.col("lang").alias("prompt"), F.col("text").alias("chosen"))
    named = [formatter(n)(docs).select(F.lit(info["format_type"]).alias("format")) for n, info in describe_formats().items()]
    return reduce(DataFrame.unionByName, named).groupBy("format").agg(F.count("*").alias("rows"))


_TURNS = "'<|im_start|>user' || chr(10) || lang || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)"
_HEADERS = ("'<|begin_of_text|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || lang || '<|eot_id|>'"
            " || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10)")


@query("format_descriptors", f"""
WITH f(name, thinking, description) AS (VALUES
  ('chatml', NULL, 'system, user and assistant turns between im_start and im_end markers'),
  ('llama3', NULL, 'turns under header markers, closed by eot_id'),
  ('mistral', NULL, 'instruction between INST markers, system text in front of the prompt'),
  ('qwen3', true, 'chatml turns with think tags (thinking on)'),
  ('raw', NULL, 'the columns as they are, without a chat template')),
made AS (SELECT f.*, CASE name WHEN 'llama3' THEN {_HEADERS} WHEN 'mistral' THEN '[INST] ' || lang || ' [/INST] '
                          WHEN 'raw' THEN lang ELSE {_TURNS} END AS prompt
         FROM documents, f WHERE lang IS NOT NULL)
SELECT name AS format, thinking, description, prompt, count(*) AS rows FROM made GROUP BY ALL""")
def descriptors(spark, d):
    """What every format says of itself, beside the prompts it makes."""
    docs = table(spark, d, "documents").where("lang IS NOT NULL").select(F.col("lang").alias("prompt"), F.col("text").alias("chosen"))
    named = [formatter(n)(docs).select(
        F.lit(info["format_type"]).alias("format"), F.lit(info.get("enable_thinking")).cast("boolean").alias("thinking"),
        F.lit(info["description"]).alias("description"), "prompt") for n, info in describe_formats().items()]
    return reduce(DataFrame.unionByName, named).groupBy("format", "thinking", "description", "prompt").agg(F.count("*").alias("rows"))


@query("rewrite_manifest", f"""
WITH {_EDITED}
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, CASE WHEN broken THEN NULL WHEN hit THEN 'caption of ' || doc_id ELSE prompt END AS prompt FROM e""")
def rewritten_manifest(spark, d):
    """The edited manifest written and read back; rows are edited twice, and the last edit counts."""
    edits, deletes = _edits(spark, d)
    out = scratch_path(spark, "rewritten")
    first = edits.select("row_index", F.lit("an earlier caption").alias("prompt"), F.lit(0).alias("edit"))
    rewrite_manifest(spark, _manifest(spark, d), out, edits.withColumn("edit", F.lit(1)).unionByName(first), deletes)
    prompt = F.variant_get(parse_object(F.col("line"))[F.lit("prompt")], "$", "string")
    return read_lines(spark, f"{out}/*.txt").select("row_index", prompt.alias("prompt"))


@query("rewrite_manifest_in_place", f"""
WITH {_EDITED}
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_index, CASE WHEN broken THEN NULL WHEN hit THEN 'caption of ' || doc_id ELSE prompt END AS prompt,
       (SELECT count(*) FROM documents) AS backup_lines FROM e""")
def manifest_in_place(spark, d):
    """The manifest at its own path after two edits, with the lines of the backup that the first one left."""
    edits, deletes = _edits(spark, d)
    path = _manifest(spark, d).removesuffix("/*.txt")
    nothing = deletes.where(F.lit(False))
    rewrite_in_place(spark, path, edits.withColumn("prompt", F.lit("an earlier caption")), nothing)
    rewrite_in_place(spark, path, edits, deletes)
    backup = read_lines(spark, f"{path}.bak/*.txt").count()
    prompt = F.variant_get(parse_object(F.col("line"))[F.lit("prompt")], "$", "string")
    return read_lines(spark, f"{path}/*.txt").select("row_index", prompt.alias("prompt"), F.lit(backup).cast("bigint").alias("backup_lines"))


@query("manifest_page", f"""
WITH {_LINES}
SELECT doc_id AS row_index, prompt, (SELECT count(*) FROM documents) AS total FROM lines WHERE NOT broken ORDER BY doc_id LIMIT 500""")
def paged_manifest(spark, d):
    """A page of more than two hundred rows, and the number of all rows."""
    page = manifest_page(read_lines(spark, _manifest(spark, d)), limit=500)
    return page.rows.select("row_index", "prompt", F.lit(page.total).cast("bigint").alias("total"))


@query("prepare_from_files", """
SELECT '[INST] ' || text || ' [/INST] ' AS prompt, text AS chosen FROM benchmark
UNION ALL SELECT '[INST] ' || lang || ' [/INST] ', text FROM documents""")
def prepare_from_files(spark, d):
    """A preparation described by a spec: two sources with their own mapping and format."""
    path = scratch_path(spark, "bench-lines")
    table(spark, d, "benchmark").select(F.col("text").alias("question"), F.col("text").alias("answer")).coalesce(1).write.json(path)
    spec = {"source": {"source_type": "local_file", "file_path": path, "file_format": "jsonl"},
            "column_mapping": {"question": "prompt", "answer": "chosen"},
            "additional_sources": [{"source_type": "local_file", "file_path": f"{d}/documents.parquet",
                                    "column_mapping": {"lang": "prompt", "text": "chosen"}}],
            "training_mode": "sft", "format": {"format_type": "mistral"}, "test_size": 0.1}
    train, held = Preparation.from_spec(spark, spec).prepare()
    return train.unionByName(held).select("prompt", "chosen")


# ---- preparing a stream --------------------------------------------------------------------------------

def _documents_stream(spark, d):
    """Documents arriving in files, a quarter of them for each micro-batch."""
    path, parts = scratch_path(spark, "arriving"), file_count(table(spark, d, "documents"))
    _documents(spark, d, parts).write.parquet(path)
    return spark.readStream.schema(DOC).option("maxFilesPerTrigger", -(-parts // 4)).parquet(path)


def _drain(stream, label):
    out = scratch_path(stream.sparkSession, label)
    with disk_state(stream.sparkSession):
        done = (stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint")
                .trigger(availableNow=True).start(f"{out}/table"))
    done.awaitTermination()
    return stream.sparkSession.read.parquet(f"{out}/table")


@query("stream_formatted", """
SELECT doc_id, '[INST] ' || source || chr(10) || chr(10) || lang || ' [/INST] ' AS prompt, text AS chosen FROM documents""")
def stream_formatted(spark, d):
    rows = _documents_stream(spark, d).select(ID, F.col("source").alias("system"), F.col("lang").alias("prompt"), F.col("text").alias("chosen"))
    return _drain(formatter("mistral")(rows), "formatted").select(ID, "prompt", "chosen")


@query("stream_dedup", "SELECT DISTINCT lang AS prompt, text AS chosen FROM documents")
def stream_dedup(spark, d):
    rows = _documents_stream(spark, d).select(F.col("lang").alias("prompt"), F.col("text").alias("chosen"))
    return _drain(drop_repeats(rows), "distinct")


@query("stream_named", "SELECT doc_id, text FROM documents")
def named_stream(spark, d):
    root = _hub(spark, d)
    parts = [_drain(stream_named(spark, root, "docs", DOC, "train", lang), "named") for lang in _languages(spark, d)]
    return reduce(DataFrame.unionByName, parts).select(ID, "text")

"""The registered queries of the operators, with production parameters, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import alignment, bottomk, chat, chunking, descent, langid, leaks, mainhtml, ngram, packing, quality, urls, whitening
from pairloom.llm.langid import fold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op9_best_fit_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(table(spark, sf_dir, "documents"))
    narrow = pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(narrow).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
items AS (SELECT doc_id, unnest(s) AS v FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM items a JOIN items b ON a.v = b.v AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
          WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS low FROM documents UNION SELECT s.b, r.low FROM reach r JOIN steps s ON s.a = r.node)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(low) AS component_id, sets.doc_id = min(low) AS kept
FROM sets JOIN reach ON node = sets.doc_id GROUP BY sets.doc_id, s"""


@query("op10_bottom_k_near_dedup", OP10)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op3_chunk_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "text", "spans")


RULES = (urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/es/"), urls.Rule("block", "example.org", "/en/1"),
         urls.Rule("allow", "com", "/fr/"), urls.Rule("block", "com", "/de/"))

OP6 = """WITH cut AS (SELECT page_id, instr(coalesce(url, ''), '://') AS pos, url FROM pages),
rest AS (SELECT page_id, CASE WHEN pos > 0 THEN substr(url, pos + 3) ELSE '' END AS rest FROM cut),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict
         FROM parts JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN fits USING (page_id)"""


@query("op6_url_filter", OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


@query("op7_chat_format")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], turns.schema)
    formatted = chat.format_conversations(turns.unionByName(more))
    read = chat.read_back(formatted)
    valid = F.first("valid").alias("valid")
    read = read.join(formatted.select(F.col("conv_id").alias("_id"), F.col("block").alias("_block"), "valid"),
                     F.col("conv_id").eqNullSafe(F.col("_id")) & (F.col("block") == F.col("_block")))
    in_order = lambda c: F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", c))), lambda b: b[c]))
    whole = read.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), in_order("turns").alias("turns"), in_order("loss").alias("loss"),
                                        F.sum("chars").alias("formatted_chars"), valid)
    return whole.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "valid")


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op8_quality_votes")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold("doc_id", 3) == 1
    model = quality.train(docs, labels.where(~held_out), label="quality")
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_interpolated_lm")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 7) == 2
    scored = ngram.interpolated(table(spark, sf_dir, "documents"), trained=~held_out, held_out=fold("doc_id", 7) == 4)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op2_decontaminate")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = leaks.search(docs, leaks.fit(docs, table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id", F.col("leak.item").alias("item_id"), F.col("leak.share").alias("share"), F.col("leak.answer").alias("answer"), F.col("leak.word").alias("word"))


@query("op5_nn_descent")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descent.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op11_tag_path_text")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")

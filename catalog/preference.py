"""Preference rows: formats, keys, system prompts, statistics, checks, splits."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import ID, PREF, blank, pref, sharded, table
from pairloom.functions.rendering import batch_formatter
from pairloom.functions.templates import formatter, from_columns, plain
from pairloom.functions.text import char_length, estimate_tokens, human_bytes, is_blank, round_half_even
from pairloom.operators import quality
from pairloom.operators.columns import check_columns, rename, set_system, suggest_mapping
from pairloom.operators.dedup import STRATEGIES, dedup_key, deduplicate, duplicate_counts, has_duplicates, keep_ordinals
from pairloom.operators.order import head, number_rows, page_rows
from pairloom.operators.reshape import concat_sources, kto_explode, label_counts
from pairloom.operators.split import sample_rows, split, split_if_large
from pairloom.plans.prepare import Loaded, Preparation

# ---- formats -------------------------------------------------------------------------------------------

_NL = "chr(10)"


def _sys(expr):
    return f"CASE WHEN NOT {blank('system')} THEN {expr} ELSE '' END"


_THINK = f"CASE WHEN NOT {blank('reasoning')} THEN '<think>' || {_NL} || reasoning || {_NL} || '</think>' || {_NL} || {_NL} ELSE '' END"
_CHATML_PROMPT = (_sys(f"'<|im_start|>system' || {_NL} || system || '<|im_end|>' || {_NL}")
                  + f" || '<|im_start|>user' || {_NL} || prompt || '<|im_end|>' || {_NL} || '<|im_start|>assistant' || {_NL}")
_HEAD = "'<|start_header_id|>{0}<|end_header_id|>' || chr(10) || chr(10)"


def _fmt(name, sql_prompt, sql_chosen, sql_rejected, make):
    @query(name, f"""
WITH {PREF}, p AS (SELECT * REPLACE (coalesce(rejected, '') AS rejected) FROM pref)
SELECT doc_id, {sql_prompt} AS prompt, {sql_chosen} AS chosen, {sql_rejected} AS rejected FROM p""")
    def run(spark, d):
        return make()(pref(spark, d)).select("doc_id", "prompt", "chosen", "rejected")


_END = f"|| '<|im_end|>' || {_NL}"
_fmt("fmt_chatml", _CHATML_PROMPT, f"chosen {_END}", f"rejected {_END}", lambda: formatter("chatml"))
_fmt("fmt_llama3",
     "'<|begin_of_text|>' || " + _sys(_HEAD.format("system") + " || system || '<|eot_id|>'") + " || "
     + _HEAD.format("user") + " || prompt || '<|eot_id|>' || " + _HEAD.format("assistant"),
     "chosen || '<|eot_id|>'", "rejected || '<|eot_id|>'", lambda: formatter("Llama3"))
_fmt("fmt_mistral", "'[INST] ' || " + _sys(f"system || {_NL} || {_NL}") + " || prompt || ' [/INST] '",
     "chosen", "rejected", lambda: formatter("mistral"))
_fmt("fmt_qwen3", _CHATML_PROMPT, f"{_THINK} || chosen {_END}", f"{_THINK} || rejected {_END}", lambda: formatter("qwen3"))
_fmt("fmt_qwen3_no_thinking", f"{_CHATML_PROMPT} || '<think>' || {_NL} || {_NL} || '</think>' || {_NL} || {_NL}",
     f"{_THINK} || chosen {_END}", f"{_THINK} || rejected {_END}", lambda: formatter("qwen3", enable_thinking=False))
_fmt("fmt_custom", "'{' || coalesce(system, '') || '} Q: ' || prompt", "'A: ' || chosen", "'B: ' || rejected",
     lambda: formatter("custom", custom_templates={
         "prompt_template": "{{{system}}} Q: {prompt}", "chosen_template": "A: {chosen}", "rejected_template": "B: {rejected}"}))
_fmt("fmt_raw", "prompt", "chosen", "rejected", lambda: formatter("none"))
_fmt("fmt_plain", _sys(f"system || {_NL} || {_NL}") + f" || prompt || {_NL}",
     f"{_THINK} || chosen", f"{_THINK} || rejected", lambda: from_columns("plain", plain))


def thinking_renderer(messages, tools=None, add_generation_prompt=False, enable_thinking=None):
    """A small chat template that closes an empty think block where thinking is off."""
    opening = "<assistant>" + ("" if enable_thinking else "<think></think>")
    out = "".join((opening if m["role"] == "assistant" else f"<{m['role']}>") + m["content"] + "\n" for m in messages)
    return out + (opening if add_generation_prompt else "")


_IN_TEXT = " OR ".join(f"(coalesce({c}, '') LIKE '%<think>%' AND coalesce({c}, '') LIKE '%</think>%')"
                       for c in ("prompt", "chosen", "rejected", "system"))
_OPEN = f"'<assistant>' || CASE WHEN NOT {blank('reasoning')} OR {_IN_TEXT} THEN '' ELSE '<think></think>' END"
_fmt("fmt_template", _sys(f"'<system>' || system || {_NL}") + f" || '<user>' || prompt || {_NL} || " + _OPEN,
     f"{_THINK} || chosen || {_NL}", f"{_THINK} || rejected || {_NL}",
     lambda: formatter("tokenizer", renderer=thinking_renderer))


def _shout(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"prompt": batch["prompt"] + "?", "chosen": batch["chosen"] + "!", "rejected": batch["rejected"] + "."})


_fmt("fmt_user_function", "prompt || '?'", "chosen || '!'", "rejected || '.'", lambda: batch_formatter("shout", _shout))


# ---- keys ----------------------------------------------------------------------------------------------

_KEYS = {"prompt": "prompt", "chosen": "chosen", "prompt_chosen": "prompt, chosen",
         "exact": "system, prompt, chosen, rejected, reasoning"}


def _dedup(strategy, keep):
    direction = "ASC" if keep == "first" else "DESC"

    @query(f"dedup_{strategy}_{keep}", f"""
WITH {PREF} SELECT * FROM pref
QUALIFY row_number() OVER (PARTITION BY {_KEYS[strategy]} ORDER BY doc_id {direction}) = 1""")
    def run(spark, d):
        return deduplicate(pref(spark, d), strategy, keep, ord=ID)


for _strategy in STRATEGIES:
    for _keep in ("first", "last"):
        _dedup(_strategy, _keep)


@query("dedup_many_repeats", f"""
WITH {PREF} SELECT * FROM pref QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY doc_id) = 1""")
def dedup_many_repeats(spark, d):
    """The plan for tables with too many repeated keys to broadcast."""
    return deduplicate(pref(spark, d), "prompt", ord=ID, broadcast_keys=0)


@query("dedup_null_order", f"""
WITH {PREF} SELECT count(DISTINCT prompt) AS rows, count(DISTINCT prompt) AS distinct_rows,
  (SELECT count(*) FROM (SELECT prompt FROM pref GROUP BY prompt HAVING bool_or(doc_id % 2 = 1))) AS without_ordinal FROM pref""")
def dedup_null_order(spark, d):
    """Every second row has no ordinal: one row of each key stays, one without an ordinal where there is any."""
    df = pref(spark, d).withColumn("_ord", F.when(F.col(ID) % 2 == 0, F.col(ID)))
    return deduplicate(df, "prompt").agg(F.count("*").alias("rows"), F.count_distinct("prompt").alias("distinct_rows"),
                                         F.count_if(F.col("_ord").isNull()).alias("without_ordinal"))


@query("dedup_keys", f"""
WITH {PREF}
SELECT doc_id, md5(prompt) AS by_prompt, md5(prompt || '|||' || chosen) AS by_pair,
       md5('chosen:' || chosen || '|||prompt:' || prompt || '|||reasoning:' || coalesce(reasoning, 'None') || '|||rejected:'
           || coalesce(rejected, 'None') || '|||system:' || coalesce(system, 'None')) AS by_row
FROM pref""")
def dedup_keys(spark, d):
    df = pref(spark, d)
    return df.select(ID, *[dedup_key(df, s, compat=True, ord=ID).alias(n) for n, s in
                           (("by_prompt", "prompt"), ("by_pair", "prompt_chosen"), ("by_row", "exact"))])


@query("dup_count", f"""
WITH {PREF}
SELECT 'prompt' AS strategy, count(*) - count(DISTINCT prompt) AS duplicates FROM pref
UNION ALL SELECT 'chosen', count(*) - count(DISTINCT chosen) FROM pref
UNION ALL SELECT 'prompt_chosen', count(*) - count(DISTINCT (prompt, chosen)) FROM pref
UNION ALL SELECT 'exact', count(*) - count(DISTINCT (system, prompt, chosen, rejected, reasoning)) FROM pref""")
def dup_count(spark, d):
    return duplicate_counts(pref(spark, d), STRATEGIES, ord=ID)


@query("has_dups", f"""
WITH {PREF} SELECT count(*) > count(DISTINCT prompt) AS has_duplicates FROM pref""")
def has_dups(spark, d):
    return has_duplicates(pref(spark, d), "prompt", ord=ID)


@query("keep_rows", "SELECT d.doc_id, d.text FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def keep_rows(spark, d):
    good = table(spark, d, "labels").where("quality = 1")
    return keep_ordinals(table(spark, d, "documents"), good, ID).select(ID, "text")


# ---- columns -------------------------------------------------------------------------------------------

@query("system_fill", f"""
WITH {PREF} SELECT doc_id, CASE WHEN {blank('system')} THEN 'Be brief.' ELSE system END AS system FROM pref""")
def system_fill(spark, d):
    return set_system(pref(spark, d), "Be brief.").select(ID, "system")


@query("system_replace", "SELECT doc_id, 'Be brief.' AS system FROM documents")
def system_replace(spark, d):
    return set_system(pref(spark, d), "Be brief.", "replace_all").select(ID, "system")


@query("concat_sources", f"""
WITH {PREF}
SELECT 0 AS source, doc_id AS place, prompt, chosen, rejected FROM pref
UNION ALL SELECT 1, item_id, text, text, NULL FROM benchmark""")
def concat(spark, d):
    extra = rename(table(spark, d, "benchmark").select(F.col("item_id").alias(ID), F.col("text").alias("question"),
                                                       F.col("text").alias("answer")),
                   {"question": "prompt", "answer": "chosen", "absent": "rejected"})
    both = concat_sources([pref(spark, d), extra], ord=ID)
    return both.select(F.col("_src").alias("source"), F.col(ID).bitwiseAND(F.lit(2**55 - 1)).alias("place"),
                       "prompt", "chosen", "rejected")


@query("auto_mapping", "SELECT doc_id, lang AS prompt, text AS chosen, source AS system FROM documents")
def auto_mapping(spark, d):
    df = table(spark, d, "documents").select(ID, F.col("lang").alias("Instruction"), F.col("text").alias("OUTPUT"),
                                             F.col("source").alias("system_prompt"))
    return check_columns(rename(df, suggest_mapping(df.columns)), "sft")


@query("blank_texts", f"""
WITH {PREF} SELECT doc_id, {blank('system')} AS no_system, {blank('rejected')} AS no_rejected FROM pref""")
def blank_texts(spark, d):
    return pref(spark, d).select(ID, is_blank(F.col("system")).alias("no_system"), is_blank(F.col("rejected")).alias("no_rejected"))


# ---- statistics and checks -----------------------------------------------------------------------------

def _measured(fields):
    return "\nUNION ALL ".join(
        f"SELECT '{f}' AS field, CASE WHEN {blank(f)} THEN 0 ELSE length({f}) END AS n, {blank(f)} AS e FROM pref" for f in fields)


_STATS = f"""
WITH {PREF}, m AS ({_measured(quality.STAT_FIELDS)})
SELECT field, count(*) AS rows, sum(n) / greatest(count(*) FILTER (WHERE NOT e), 1) AS avg_length,
       min(n) AS min_length, max(n) AS max_length,
       CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY n DESC) AS BIGINT) AS median_length,
       count(*) FILTER (WHERE e) AS empty_count,
       sum(n) / greatest(count(*) FILTER (WHERE NOT e), 1) / 4.0 AS est_avg_tokens
FROM m GROUP BY field"""


@query("field_stats", _STATS)
def field_stats(spark, d):
    return quality.field_stats(pref(spark, d))


@query("field_stats_rounded", f"""
SELECT * REPLACE (CAST(printf('%.1f', avg_length) AS DOUBLE) AS avg_length,
                  CAST(printf('%.0f', est_avg_tokens) AS DOUBLE) AS est_avg_tokens) FROM ({_STATS})""")
def field_stats_rounded(spark, d):
    return quality.field_stats(pref(spark, d), rounded=True)


@query("total_tokens", f"""
SELECT sum(CAST(printf('%.0f', est_avg_tokens) AS DOUBLE) * (rows - empty_count)) AS est_total_tokens
FROM ({_STATS}) WHERE field IN ('prompt', 'chosen')""")
def total_tokens(spark, d):
    return quality.total_tokens(pref(spark, d))


@query("length_balance", f"""
WITH {PREF}, s AS (
  SELECT coalesce(sum(length(chosen)) FILTER (WHERE chosen <> ''), 0) / greatest(count(*) FILTER (WHERE chosen <> ''), 1) AS ac,
         coalesce(sum(length(rejected)) FILTER (WHERE rejected <> ''), 0) / greatest(count(*) FILTER (WHERE rejected <> ''), 1) AS ar,
         count(*) FILTER (WHERE chosen <> '' AND rejected <> '' AND length(chosen) > length(rejected))
           / greatest(count(*) FILTER (WHERE chosen <> ''), 1) * 100 AS pct
  FROM pref)
SELECT ac AS avg_chosen_length, ar AS avg_rejected_length, ac / greatest(ar, 1) AS ratio, pct AS chosen_longer_pct FROM s""")
def length_balance(spark, d):
    return quality.length_balance(pref(spark, d))


@query("overview", """
SELECT count(*) AS total_rows, 'doc_id,system,prompt,chosen,rejected,reasoning' AS columns, 'dpo' AS training_mode FROM documents""")
def overview(spark, d):
    return quality.overview(pref(spark, d), "dpo").withColumn("columns", F.array_join("columns", ","))


def _printed(c):
    return f"coalesce({c}, 'None')"


@query("validate_counts", f"""
WITH {PREF}
SELECT count(*) AS total_samples, count(*) FILTER (WHERE {blank(_printed('prompt'))}) AS empty_prompts,
       count(*) FILTER (WHERE length({_printed('prompt')}) > 200) AS long_prompts,
       count(*) FILTER (WHERE {blank(_printed('chosen'))}) AS empty_chosen,
       count(*) FILTER (WHERE length({_printed('chosen')}) > 2000) AS long_chosen,
       count(*) FILTER (WHERE {blank(_printed('rejected'))}) AS empty_rejected,
       count(*) FILTER (WHERE length({_printed('rejected')}) > 1500) AS long_rejected
FROM pref""")
def validate_counts(spark, d):
    return quality.validation_counts(pref(spark, d), 200, 2000, 1500)


@query("validate_issues", f"""
WITH {PREF}
SELECT doc_id, 0 AS "check", 'Row ' || doc_id || ': Empty prompt' AS issue FROM pref WHERE {blank(_printed('prompt'))}
UNION ALL SELECT doc_id, 1, 'Row ' || doc_id || ': Empty chosen response' FROM pref WHERE {blank(_printed('chosen'))}
UNION ALL SELECT doc_id, 2, 'Row ' || doc_id || ': Empty rejected response' FROM pref WHERE {blank(_printed('rejected'))}""")
def validate_issues(spark, d):
    return quality.validation_issues(pref(spark, d), ord=ID)


@query("has_reasoning", f"""
WITH {PREF} SELECT doc_id, (NOT {blank('reasoning')} OR {_IN_TEXT}) AS has_reasoning FROM pref""")
def has_reasoning(spark, d):
    df = pref(spark, d)
    return df.select(ID, quality.row_has_reasoning(df.columns).alias("has_reasoning"))


@query("step_plan", """
SELECT s AS steps_per_epoch, s * 3 AS total_steps, greatest(1, CAST(floor(s * 3 * 0.2::DOUBLE) AS BIGINT)) AS eval_steps
FROM (SELECT CAST(ceil(count(*) / 16) AS BIGINT) AS s FROM documents)""")
def step_plan(spark, d):
    return quality.step_plan(table(spark, d, "documents"), 2, 4, 2, 3, 0.2)


@query("text_lengths", "SELECT doc_id, length(text) AS chars, length(text) / 4.0::DOUBLE AS tokens FROM documents")
def text_lengths(spark, d):
    return table(spark, d, "documents").select(ID, char_length(F.col("text")).cast("long").alias("chars"),
                                               estimate_tokens(F.col("text")).alias("tokens"))


@query("rounding", """
SELECT doc_id, CAST(printf('%.1f', n_chars / 40) AS DOUBLE) AS tenth, CAST(printf('%.2f', n_chars / 800) AS DOUBLE) AS cent,
       CAST(printf('%.0f', n_chars / 8) AS DOUBLE) AS whole FROM documents""")
def rounding(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").select(
        ID, *[round_half_even(n / by, digits).alias(name) for name, by, digits in (("tenth", 40, 1), ("cent", 800, 2), ("whole", 8, 0))])


@query("human_sizes", """
SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b / 1024 < 1024 THEN printf('%.1f KB', b / 1024)
                    WHEN b / 1048576 < 1024 THEN printf('%.1f MB', b / 1048576)
                    WHEN b / 1073741824 < 1024 THEN printf('%.1f GB', b / 1073741824)
                    ELSE printf('%.1f TB', b / 1099511627776) END AS size
FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) * n_chars * n_chars AS b FROM documents)""")
def human_sizes(spark, d):
    n = F.col("n_chars").cast("double")
    return table(spark, d, "documents").select(ID, human_bytes(n * n * n).alias("size"))


# ---- unpaired, heads, pages, splits --------------------------------------------------------------------

_NEGATIVE = f"rejected IS NOT NULL AND NOT {blank('rejected')}"


@query("kto_explode", f"""
WITH {PREF}
SELECT doc_id, prompt, chosen AS response, true AS label FROM pref
UNION ALL SELECT doc_id, prompt, rejected, false FROM pref WHERE {_NEGATIVE}""")
def kto(spark, d):
    return kto_explode(pref(spark, d), keep=[ID])


@query("kto_formatted", f"""
WITH {PREF}
SELECT doc_id, {_CHATML_PROMPT} AS prompt, chosen {_END} AS response, true AS label FROM pref
UNION ALL SELECT doc_id, {_CHATML_PROMPT}, coalesce(rejected, '') {_END}, false FROM pref""")
def kto_formatted(spark, d):
    return kto_explode(formatter("chatml")(pref(spark, d)), keep=[ID])


@query("kto_counts", f"""
WITH {PREF}
SELECT true AS label, count(*) AS rows FROM pref
UNION ALL SELECT false, count(*) FROM pref WHERE {_NEGATIVE}""")
def kto_counts(spark, d):
    return label_counts(kto_explode(pref(spark, d)))


@query("head_n", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 300")
def head_n(spark, d):
    return sharded(table(spark, d, "documents").select(ID, "text"), ID, "head").head(300).select(ID, "text")


@query("page", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 20 OFFSET 100")
def page(spark, d):
    return sharded(table(spark, d, "documents").select(ID, "text"), ID, "page").page(20, 100).rows.select(ID, "text")


@query("page_by_ordinal", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 20 OFFSET 100")
def page_by_ordinal(spark, d):
    """A page of a table that is not read from files: its edges are looked for among the ordinals."""
    return page_rows(table(spark, d, "documents").select(ID, "text"), 20, 100, ID)


@query("head_by_ordinal", "SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 3000")
def head_by_ordinal(spark, d):
    return head(table(spark, d, "events").select("event_id", "user_id"), 3000, "event_id")


@query("page_formatted", f"""
WITH {PREF} SELECT doc_id, {_CHATML_PROMPT} AS prompt FROM pref ORDER BY doc_id LIMIT 20 OFFSET 100""")
def page_formatted(spark, d):
    files = sharded(pref(spark, d), ID, "pref")
    plan = Preparation(Loaded(files.rows(), files=files), {"training_mode": "orpo"})
    return plan.preview_formatted(20, 100).rows.select(ID, "prompt")


@query("prepare_cap_wide", """
WITH e AS (SELECT count(*) AS n, count(*) FILTER (WHERE event_id % 2 = 1) AS without FROM events)
SELECT cap, least(cap, n) AS rows, least(cap, n) AS distinct_rows, least(cap, without) AS without_ordinal, CAST(ceil(0.1 * least(cap, n)) AS BIGINT) AS held
FROM e, (VALUES (900), (1001), (2000), (1000000000)) AS c(cap)""")
def prepare_cap_wide(spark, d):
    """Caps below and above a thousand rows, where every second row has no ordinal and the others share theirs by threes."""
    place = F.when(F.col("event_id") % 2 == 1, F.lit(None)).otherwise(F.floor(F.col("event_id") / 6))
    df = table(spark, d, "events").select(place.cast("long").alias("_ord"), F.col("event_id").cast("string").alias("prompt"), F.lit("c").alias("chosen"))
    parts = []
    for cap in (900, 1001, 2000, 1_000_000_000):
        spec = {"training_mode": "sft", "max_samples": cap, "test_size": 0.1, "format": {"format_type": "raw"}}
        train, held = Preparation(Loaded(df), spec).prepare(staged=True)
        sides = train.select("_ord", "prompt", F.lit(0).alias("h")).unionAll(held.select("_ord", "prompt", F.lit(1)))
        parts.append(sides.agg(F.lit(cap).alias("cap"), F.count("*").alias("rows"), F.count_distinct("prompt").alias("distinct_rows"),
                               F.count_if(F.col("_ord").isNull()).alias("without_ordinal"), F.sum("h").cast("long").alias("held")))
    return reduce(DataFrame.unionAll, parts)


@query("split_null_order", """
WITH n AS (SELECT count(*) AS n, CAST(ceil(0.3 * count(*)) AS BIGINT) AS k FROM documents)
SELECT how, n - k AS train_rows, k AS eval_rows, n AS distinct_rows, CASE WHEN how = 'last' THEN 0 END AS eval_without FROM n, (VALUES ('last'), ('shuffled')) AS h(how)""")
def split_null_order(spark, d):
    """Both sides of a table of which every second row has no ordinal: no row is lost, and rows without one are no last rows."""
    df = table(spark, d, "documents").select(F.when(F.col(ID) % 2 == 0, F.col(ID)).alias("_ord"), F.col(ID).alias("name"))
    parts = []
    for how in ("last", "shuffled"):
        train, held = split(df, 0.3, shuffle=how == "shuffled")
        sides = train.withColumn("h", F.lit(0)).unionAll(held.withColumn("h", F.lit(1)))
        without = F.count_if((F.col("h") == 1) & F.col("_ord").isNull()).cast("int")
        parts.append(sides.agg(F.lit(how).alias("how"), F.count_if(F.col("h") == 0).alias("train_rows"), F.count_if(F.col("h") == 1).alias("eval_rows"),
                               F.count_distinct("name").alias("distinct_rows"), (without if how == "last" else F.lit(None).cast("int")).alias("eval_without")))
    return reduce(DataFrame.unionAll, parts)


@query("row_numbers", "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS position FROM documents")
def row_numbers(spark, d):
    return number_rows(table(spark, d, "documents").select(ID, "n_chars"), F.col("n_chars").desc(), ID, into="position").select(ID, "position")


@query("split_sizes", """
SELECT k AS eval_rows, n - k AS train_rows, 0 AS shared, n AS distinct_rows
FROM (SELECT count(*) AS n, CAST(ceil(0.013 * count(*)) AS BIGINT) AS k FROM documents)""")
def split_sizes(spark, d):
    train, held = split(table(spark, d, "documents"), 0.013, seed=7, ord=ID)
    sides = train.select(ID, F.lit(0).alias("e")).unionAll(held.select(ID, F.lit(1)))
    each = sides.groupBy(ID).agg(F.count_if(F.col("e") == 1).alias("e"), F.count_if(F.col("e") == 0).alias("t"))
    return each.agg(F.sum("e").alias("eval_rows"), F.sum("t").alias("train_rows"),
                    F.count_if((F.col("e") > 0) & (F.col("t") > 0)).cast("int").alias("shared"), F.count("*").alias("distinct_rows"))


@query("split_tail", """
SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) <= ceil(0.1 * count(*) OVER ()) AS held FROM documents""")
def split_tail(spark, d):
    train, held = split(table(spark, d, "documents").select(ID), 0.1, shuffle=False, ord=ID)
    return train.withColumn("held", F.lit(False)).unionAll(held.withColumn("held", F.lit(True)))


@query("split_if_large", """
SELECT name, n - k AS train_rows, k AS eval_rows FROM (
  SELECT name, n, CASE WHEN n > 100 THEN CAST(ceil(0.1 * n) AS BIGINT) ELSE 0 END AS k FROM (
    SELECT 'benchmark' AS name, count(*) AS n FROM benchmark UNION ALL SELECT 'documents', count(*) FROM documents))""")
def split_large(spark, d):
    """Two tables, of which only the one with more than a hundred rows is split."""
    def sides(name, key):
        train, held = split_if_large(table(spark, d, name), 0.1, more_than=100, ord=key)
        rows = train.select(F.lit(0).alias("e"))
        rows = rows if held is None else rows.unionAll(held.select(F.lit(1)))
        return rows.agg(F.lit(name).alias("name"), F.count_if(F.col("e") == 0).alias("train_rows"), F.count_if(F.col("e") == 1).alias("eval_rows"))
    return sides("benchmark", "item_id").unionByName(sides("documents", ID))


@query("sample_size", """
SELECT count(*) AS rows, count(*) AS distinct_rows, count(*) AS whole_rows FROM (SELECT 1 FROM documents LIMIT 500)""")
def sample_size(spark, d):
    """The sample's rows, all different, and each with the text it has in the table."""
    docs = table(spark, d, "documents")
    sampled = sample_rows(docs, 500, seed=3, ord=ID)
    same = sampled.join(docs.select(ID, F.col("text").alias("_text")), ID).select(ID, F.col("text").eqNullSafe(F.col("_text")).alias("same"))
    return same.agg(F.count("*").alias("rows"), F.count_distinct(ID).alias("distinct_rows"), F.count_if("same").alias("whole_rows"))


@query("dedup_exact_internal", """
SELECT doc_id, _note FROM (SELECT doc_id, 'n' || (doc_id % 3) AS _note, lang FROM documents)
QUALIFY row_number() OVER (PARTITION BY lang, _note, doc_id % 10 ORDER BY doc_id) = 1""")
def dedup_exact_internal(spark, d):
    """Exact keys hold a column whose name begins with an underscore, and times inside a struct to the microsecond."""
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col(ID) % 10)
    df = table(spark, d, "documents").select(
        F.col(ID).alias("_ord"), "lang", F.concat(F.lit("n"), (F.col(ID) % 3).cast("string")).alias("_note"), F.struct(at.alias("at")).alias("nested"))
    return deduplicate(df, "exact").select(F.col("_ord").alias(ID), "_note")


# ---- whole preparations --------------------------------------------------------------------------------

@query("prepare_sft", f"""
WITH {PREF}, kept AS (
  SELECT * REPLACE (CASE WHEN {blank('system')} THEN 'Be brief.' ELSE system END AS system) FROM pref
  QUALIFY row_number() OVER (PARTITION BY chosen ORDER BY doc_id) = 1)
SELECT doc_id, {_CHATML_PROMPT} AS prompt, chosen {_END} AS chosen FROM kept""")
def prepare_sft(spark, d):
    spec = {"training_mode": "sft", "deduplicate": True, "dedupe_strategy": "chosen", "system_prompt": "Be brief.", "test_size": 0.05}
    train, held = Preparation(Loaded(pref(spark, d)), spec, ord=ID).prepare(staged=True)
    return train.unionByName(held).select(ID, "prompt", "chosen")


@query("prepare_with_eval", f"""
WITH {PREF}, s AS (SELECT prompt, chosen, coalesce(rejected, '') AS rejected FROM pref),
     e AS (SELECT text AS prompt, text AS chosen, text AS rejected FROM benchmark)
SELECT 'train' AS side, '[INST] ' || {_sys(f"system || {_NL} || {_NL}")} || prompt || ' [/INST] ' AS prompt,
       chosen, coalesce(rejected, '') AS rejected FROM pref
UNION ALL SELECT 'eval', '[INST] ' || prompt || ' [/INST] ', chosen, rejected FROM e""")
def prepare_with_eval(spark, d):
    held_out = table(spark, d, "benchmark").select(F.col("item_id").alias(ID), F.col("text").alias("prompt"),
                                                   F.col("text").alias("chosen"), F.col("text").alias("rejected"))
    plan = Preparation(Loaded(pref(spark, d)), {"format": {"format_type": "mistral"}}, evaluation=Loaded(held_out), ord=ID)
    train, held = plan.prepare()
    shape = ["prompt", "chosen", "rejected"]
    return train.select(F.lit("train").alias("side"), *shape).unionByName(held.select(F.lit("eval").alias("side"), *shape))


@query("prepare_unpaired", f"""
WITH {PREF}
SELECT {_CHATML_PROMPT} AS prompt, chosen {_END} AS response, true AS label FROM pref
UNION ALL SELECT {_CHATML_PROMPT}, rejected {_END}, false FROM pref WHERE {_NEGATIVE}""")
def prepare_unpaired(spark, d):
    train, held = Preparation(Loaded(pref(spark, d)), {"training_mode": "kto"}, ord=ID).prepare_unpaired(staged=True, raw_negatives=True)
    return train.unionByName(held)

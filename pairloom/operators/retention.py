"""Planning what to keep: checkpoints, caches, uploads, artifacts, queues, file names. Nothing is deleted."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.functions.text import (checkpoint_step, file_name, human_bytes, micros, round_half_even, seconds_between,
                                     ttl_remaining)
from pairloom.operators.order import ORD, number_rows, running_before
from pairloom.session import cut_lineage, scratch_path, small_side, stage

# Statuses of unfinished runs, statuses whose leftovers may go, and file name lists per category.
ACTIVE = ("queued", "initializing", "loading_model", "loading_dataset", "training", "running")
FINISHED_BADLY = ("failed", "stopped")
CATEGORY_NAMES = {
    "tokenizer": ("tokenizer.json", "tokenizer.model", "tokenizer_config.json", "special_tokens_map.json", "vocab.json",
                  "merges.txt", "added_tokens.json", "chat_template.jinja", "chat_template.json"),
    "processor": ("preprocessor_config.json", "processor_config.json", "image_processor.json"),
    "config": ("config.json", "generation_config.json"),
    "readme": ("README.md", "readme.md", "upload_state.json"),
    "adapter": ("adapter_config.json",),
}
WEIGHT_ENDINGS = (".bin", ".safetensors", ".pt", ".safetensors.index.json", ".bin.index.json")
PROTECTED = ("config.json", "adapter_config.json", "tokenizer.json", "tokenizer_config.json", "tokenizer.model",
             "special_tokens_map.json")
UPLOAD_TTL_HOURS, ARTIFACT_TTL_HOURS, STALE_DAYS = 24, 72, 90


def with_status(df: DataFrame, statuses: DataFrame, key: str = "job_id") -> DataFrame:
    """Add the status of each row's run; `unknown` when there is none. `statuses` has one row per run."""
    known = statuses.select(key, F.col("status").alias("_status"))
    return (df.join(known, key, "left")
            .withColumn("status", F.coalesce(F.col("_status"), F.lit("unknown"))).drop("_status"))


def newest_checkpoints(checkpoints: DataFrame, keep: int, key: str = "job_id") -> DataFrame:
    """Per run: the step of the oldest checkpoint kept, the kept names oldest first, and their bytes.

    The rank limit is applied per task before the shuffle, so a run holding most of the table
    sends `keep` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col("step").desc()))
    newest = checkpoints.where(F.col("step").isNotNull()).withColumn("_rank", rank).where(F.col("_rank") <= keep)
    names = F.transform(F.array_sort(F.collect_list(F.struct("step", "checkpoint"))), lambda c: c["checkpoint"])
    return newest.groupBy(key).agg(F.min("step").alias("edge"), F.array_join(names, ", ").alias("kept"),
                                   F.sum("bytes").alias("kept_bytes"))


def _job_totals(checkpoints: DataFrame, statuses: DataFrame, key: str) -> DataFrame:
    totals = checkpoints.groupBy(key).agg(F.count("step").alias("checkpoints"),
                                          F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))
    return with_status(totals, statuses, key).withColumn("active", F.col("status").isin(*ACTIVE))


def with_steps(inventory: DataFrame) -> DataFrame:
    """Add `step`, read from the checkpoint name; null for entries that are no checkpoint."""
    return inventory.withColumn("step", checkpoint_step(F.col("checkpoint")))


def plan_cleanup(inventory: DataFrame, statuses: DataFrame, keep: int = 1, purge_failed: bool = False,
                 key: str = "job_id") -> tuple[DataFrame, DataFrame]:
    """(deletions, skipped) for an inventory of (run, checkpoint, bytes).

    The newest `keep` checkpoints of each finished run stay. Unfinished runs are skipped; with
    `purge_failed`, failed runs go as a whole (a deletion without checkpoint).
    """
    if keep < 1:
        raise ValueError("keep at least one checkpoint")
    checkpoints = inventory if "step" in inventory.columns else with_steps(inventory)
    jobs = _job_totals(checkpoints, statuses, key)
    whole = (F.col("status") == "failed") & ~F.col("active") if purge_failed else F.lit(False)
    few = F.col("checkpoints") <= keep
    skipped = jobs.where(F.col("active") | (~whole & few)).select(
        key, F.when(F.col("active"), F.concat(F.lit("unfinished: "), "status"))
        .otherwise(F.concat(F.lit("has "), F.col("checkpoints").cast("string"), F.lit(f" of {keep} to keep"))).alias("reason"))
    purged = jobs.where(whole).select(
        key, F.lit(None).cast("string").alias("checkpoint"), F.col("total_bytes").alias("bytes"),
        F.lit("failed job, nothing of it is needed").alias("reason"))
    pruned = (jobs.where(~F.col("active") & ~whole & ~few).select(key)
              .join(newest_checkpoints(checkpoints, keep, key), key))
    old = (checkpoints.join(pruned, key).where(F.col("step") < F.col("edge"))
           .select(key, "checkpoint", "bytes", F.concat(F.lit("older than "), "kept").alias("reason")))
    return old.unionByName(purged), skipped


def disk_usage(inventory: DataFrame, statuses: DataFrame, keep: int = 1, key: str = "job_id") -> DataFrame:
    """Bytes per run and how many of them a cleanup would free; sort by total_bytes to see the largest."""
    checkpoints = inventory if "step" in inventory.columns else with_steps(inventory)
    # Runs without any checkpoint are listed too, with nothing to free.
    jobs = _job_totals(checkpoints.withColumn("bytes", F.when(F.col("step").isNotNull(), F.col("bytes"))), statuses, key)
    kept = newest_checkpoints(checkpoints, keep, key).select(key, "kept_bytes")
    free = F.when(~F.col("active") & (F.col("checkpoints") > keep), F.col("total_bytes") - F.col("kept_bytes"))
    return (jobs.join(kept, key, "left").withColumn("reclaimable_bytes", F.coalesce(free, F.lit(0))).drop("kept_bytes"))


def size_rollup(files: DataFrame, *keys: str) -> DataFrame:
    """Files and bytes per group."""
    return files.groupBy(*keys).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def size_totals(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the sum of each byte column, plain and readable."""
    sums = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
    return sums.withColumns({f"{c}_human": human_bytes(F.col(c)) for c in columns})


def largest_first(df: DataFrame, column: str = "bytes", *ties: str) -> DataFrame:
    return df.orderBy(F.col(column).desc(), *ties)


def mark_stale(repos: DataFrame, now: Column, stale_days: float = STALE_DAYS) -> DataFrame:
    """Flag cached repositories not accessed for longer than `stale_days`; an unknown access time is not stale."""
    age = seconds_between(now, F.col("last_accessed"))
    return repos.withColumn("stale", F.coalesce(age > stale_days * 86_400, F.lit(False)))


def stale_totals(repos: DataFrame, now: Column, stale_days: float = STALE_DAYS) -> DataFrame:
    """One row: repositories, bytes, and the bytes of stale ones."""
    return mark_stale(repos, now, stale_days).agg(
        F.count("*").alias("repos"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"),
        F.coalesce(F.sum(F.when(F.col("stale"), F.col("bytes"))), F.lit(0)).alias("stale_bytes"))


def list_uploads(uploads: DataFrame, now: Column, ttl_hours: float = UPLOAD_TTL_HOURS) -> DataFrame:
    """Uploads with the time they expire and the whole seconds left."""
    uploaded = F.col("uploaded_at").cast("timestamp")
    expires = F.timestamp_micros(micros(uploaded) + F.lit(int(ttl_hours * 3_600_000_000)))
    return uploads.withColumns({"expires_at": expires, "ttl_remaining_seconds": ttl_remaining(uploaded, now, ttl_hours)})


def expired_uploads(uploads: DataFrame, now: Column, ttl_hours: float = UPLOAD_TTL_HOURS) -> DataFrame:
    """Uploads older than their time to live, with their age in hours."""
    age = seconds_between(now, F.col("uploaded_at"))
    return (uploads.where(age > ttl_hours * 3600)
            .withColumn("age_hours", round_half_even(age / F.lit(3600.0), 1)))


def expired_artifacts(runs: DataFrame, now: Column, max_age_hours: float = ARTIFACT_TTL_HOURS) -> DataFrame:
    """Failed and stopped runs that are at least `max_age_hours` old; an unknown creation time counts as old."""
    age = seconds_between(now, F.col("created_at"))
    return runs.where(F.col("status").isin(*FINISHED_BADLY) & F.coalesce(age >= max_age_hours * 3600, F.lit(True)))


def freed(df: DataFrame) -> DataFrame:
    """One row: how many entries would go and how much they hold."""
    return (df.agg(F.count("*").alias("count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("freed_bytes"))
            .withColumn("freed_mb", round_half_even(F.col("freed_bytes") / F.lit(float(1024 * 1024)), 2)))


def quant_tag(name: Column) -> Column:
    """The quantisation part of `{model}.{quant}.gguf`; null when there is none."""
    return F.nullif(F.regexp_extract(name, r"^.*\.([^.]*)\.gguf$", 1), F.lit(""))


def file_category(path: Column) -> Column:
    """The kind of a model file, from its path relative to the model folder."""
    name = file_name(path)
    out = F.when(path.startswith("gguf/"), "gguf")
    for category, names in CATEGORY_NAMES.items():
        out = out.when(name.isin(*names), category)
    weights = reduce(lambda a, b: a | b, [name.endswith(e) for e in WEIGHT_ENDINGS])
    return out.when(weights & F.lower(name).contains("adapter"), "adapter").when(weights, "merged").otherwise("other")


def artifact_inventory(files: DataFrame, path: str = "path") -> DataFrame:
    """Model files with their category, quantisation tag and whether they must not be deleted."""
    p = F.col(path)
    tagged = files.withColumn("category", file_category(p))
    tag = F.when((F.col("category") == "gguf") & file_name(p).endswith(".gguf"), F.upper(quant_tag(file_name(p))))
    return tagged.withColumns({"quant_type": tag, "protected": file_name(p).isin(*PROTECTED)})


def model_summary(files: DataFrame, model: str = "model", path: str = "path") -> DataFrame:
    """Per model: bytes, and whether it is an adapter, has merged weights, has quantised exports."""
    kinds, p = artifact_inventory(files, path), F.col(path)
    return kinds.groupBy(model).agg(
        F.sum("bytes").alias("total_bytes"),
        F.max(p == "adapter_config.json").alias("is_lora"),
        F.max(F.col("category") == "merged").alias("has_merged"),
        F.max((F.col("category") == "gguf") & p.endswith(".gguf")).alias("has_gguf"))


def queue_positions(backlog: DataFrame, priority: str = "priority", queued: str = "queued_at",
                    id: str = "job_id") -> DataFrame:
    """Waiting jobs with their position from 0: higher priority first, then the earlier one."""
    return number_rows(backlog, F.col(priority).desc(), F.col(queued), F.col(id), into="position")


# ---- unique file names -------------------------------------------------------------------------------

SETTLED = 100_000   # numbered names settled in one piece
NUMBERED = r"^(.*[^/])_([2-9]|[1-9][0-9]{1,8})(\.[^.]*)?$"   # a name as the numbering itself would make it


def _numbered(name: Column, number: Column) -> Column:
    stem = F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)
    plain = stem == ""
    ending = F.when(plain, F.lit("")).otherwise(F.substring(name, F.length(stem) + 1, F.length(name)))
    return F.concat(F.when(plain, name).otherwise(stem), F.lit("_"), number.cast("string"), ending)


def _claims(limits: list[int], claimed: int) -> tuple[list[bool], int]:
    """Which numbered names of one base, by rising number, were there before their number was given away; and how many so far.

    `limits` holds for each how many smaller numbers may be claimed for that to be so.
    """
    own = []
    for limit in limits:
        own.append(claimed < limit)
        claimed += own[-1]
    return own, claimed


def _settle_block(block: pd.DataFrame) -> pd.DataFrame:
    """One block of numbered names in order of (base, number). The first base goes on from the block before: `claimed` says how many it has."""
    own, claimed = [], 0
    for i, (_, base) in enumerate(block.sort_values("_pos").groupby("parent", sort=False)):
        found, claimed = _claims(base["limit"].tolist(), int(block["claimed"].iloc[0]) if i == 0 else 0)
        own += found
    out = block.sort_values("_pos")[["_block", "name", "parent", "number"]]
    return out.assign(own=own, last=claimed)


def _settle_level(kids: DataFrame, block: int) -> DataFrame:
    """(name, parent, number, own, claimed before) of numbered names of which the bases are settled: parent, number, limit.

    Names lie in blocks by (base, number). Every block starts from a guess of how many numbers its first base has claimed
    in the blocks before, and all are repeated until no guess changes: a wrong guess is soon forgotten within a block,
    since a claim too many makes a later one fail, so a few rounds do, and never more than there are blocks.
    """
    spark = kids.sparkSession
    rows = number_rows(kids, "parent", "number").withColumn("_block", F.expr(f"_pos div {block}L"))
    ends = rows.groupBy("_block").agg(F.min_by("parent", "_pos").alias("first"), F.max_by("parent", "_pos").alias("end"))
    by_block = Window.orderBy("_block")   # one row for each block
    guess = cut_lineage(ends.select("_block", (F.col("first") == F.lag("end").over(by_block)).alias("goes_on"), F.lit(0).cast("long").alias("claimed")))
    while True:
        settled = stage(rows.join(F.broadcast(guess.select("_block", "claimed")), "_block").groupBy("_block").applyInPandas(
            _settle_block, "_block long, name string, parent string, number long, own boolean, last long"), scratch_path(spark, "settled"))
        lasts = settled.groupBy("_block").agg(F.first("last").alias("last"))
        reached = F.when(F.col("goes_on"), F.lag("last").over(by_block)).otherwise(0)
        after = cut_lineage(guess.join(lasts, "_block").select("_block", "goes_on", "claimed", F.coalesce(reached, F.lit(0)).alias("reached")))
        if after.where("claimed <> reached").isEmpty():
            return settled.drop("_block", "last")
        guess = after.select("_block", "goes_on", F.col("reached").alias("claimed"))


def _settle(contested: DataFrame, ahead: DataFrame, block: int) -> DataFrame:
    """(name, parent, number, own) of all contested names, level by level: a base has to be settled before the names numbered after it."""
    kids = cut_lineage(contested.join(ahead, "name", "left").select("name", "parent", "number", F.coalesce("ahead", F.lit(0)).alias("ahead")))
    level = kids.join(kids.select(F.col("name").alias("parent")), "parent", "left_anti").withColumn("kept", F.lit(True))
    done = []
    while not level.isEmpty():
        asked = F.col("ahead") - F.when(F.col("kept") & (F.col("ahead") > 0), 1).otherwise(0)
        settled = _settle_level(level.select("name", "parent", "number", (F.col("number") - 1 - asked).alias("limit")), block)
        done.append(settled)
        level = kids.join(settled.select(F.col("name").alias("parent"), F.col("own").alias("kept")), "parent")
    return reduce(DataFrame.unionByName, done)


def unique_names(files: DataFrame, name: str = "name", ord: str = ORD, into: str = "unique_name",
                 block: int = 1_000_000) -> DataFrame:
    """Distinct names: the first `a.png` stays, later ones become `a_2.png`, `a_3.png`, ... past names in use.

    A row's number follows from how many equal names come before it, counted in blocks so that a
    name shared by most rows is spread over tasks. Names that look like numbered copies of a repeated one are settled in
    blocks of (base, number), and how many numbers in use a copy has to skip is counted the same way, so neither a base
    with very many copies nor one with very many numbered names meets in one task.
    """
    rows = running_before(files, F.lit(1), [name], ord, "_copies", F.sum, block)   # 0 keeps the name
    contested = _contested_names(files, name, ord)
    if contested.isEmpty():
        return rows.withColumn(into, F.when(F.col("_copies") == 0, F.col(name))
                               .otherwise(_numbered(F.col(name), F.col("_copies") + 1))).drop("_copies")
    ahead = _rows_ahead(files.select(F.col(name).alias("parent"), F.col(ord).alias("at")), contested, block)
    settled = cut_lineage(_settle(contested, ahead, min(block, SETTLED)))
    lost = settled.where("NOT own").select(F.col("name").alias(name), F.lit(1).alias("_lost"))
    bases = settled.select(F.col("parent").alias(name), F.lit(True).alias("_base")).distinct()
    rows = (rows.join(small_side(lost), name, "left").join(small_side(bases), name, "left")
            .withColumn("_copies", F.col("_copies") + F.coalesce("_lost", F.lit(0))).drop("_lost"))
    # The j-th claimed number r (j from 0) has r - j - 2 free ones in front of it; a copy skips those with fewer than it asks for.
    claims = _ranked_claims(settled.where("own"), block).select(
        F.col("parent").alias(name), (2 * (F.col("number") - F.col("rank") - 2) + 1).alias("_at"), F.lit(1).alias("_claim"))
    asking = rows.where("_base").withColumns({"_at": 2 * F.col("_copies"), "_claim": F.lit(0)})
    counted = running_before(asking.unionByName(claims, allowMissingColumns=True), F.col("_claim"), [name], "_at", "_skipped", F.sum, block)
    asked = counted.where("_claim = 0").drop("_at", "_claim")
    free = rows.where("_base IS NULL").withColumn("_skipped", F.lit(0).cast("long"))
    return (asked.unionByName(free)
            .withColumn(into, F.when(F.col("_copies") == 0, F.col(name))
                        .otherwise(_numbered(F.col(name), F.col("_copies") + 1 + F.col("_skipped"))))
            .drop("_copies", "_base", "_skipped"))


def _ranked_claims(claims: DataFrame, block: int) -> DataFrame:
    """Claimed numbers with `rank`, how many smaller ones their base has claimed."""
    return running_before(claims, F.lit(1), ["parent"], "number", "rank", F.sum, block)


def _contested_names(files: DataFrame, name: str, ord: str) -> DataFrame:
    """Numbered names with the given name they derive from: (root, name, first, parent, number).

    A family shares a name up to numbers at its end. It matters only when it has such a pair and a
    name that occurs more than once; in all others every row's number is already free.
    """
    root = F.regexp_replace("name", r"(_([2-9]|[1-9][0-9]{1,8}))+(?=(\.[^.]*)?$)", "")
    names = cut_lineage(files.groupBy(F.col(name).alias("name"))
                        .agg(F.count("*").alias("n"), F.min(ord).alias("first")).withColumn("root", root))
    stem, number, ending = (F.regexp_extract("name", NUMBERED, i) for i in (1, 2, 3))
    numbered = names.where(number != "").select("root", "name", "first", F.concat(stem, ending).alias("parent"),
                                                number.cast("long").alias("number"))
    pairs = numbered.join(names.select(F.col("name").alias("parent")), "parent")
    repeated = names.where("n > 1").select("root").distinct()
    return cut_lineage(pairs.join(repeated, "root", "left_semi"))


def _rows_ahead(rows: DataFrame, contested: DataFrame, block: int) -> DataFrame:
    """For every numbered name: how many rows of its parent name come before its own first row."""
    parents = rows.join(contested.select("parent").distinct(), "parent", "left_semi")
    marks = (parents.withColumns({"one": F.lit(1), "child": F.lit(None).cast("string")})
             .unionByName(contested.select("parent", F.col("first").alias("at"), F.lit(0).alias("one"), F.col("name").alias("child"))))
    return (running_before(marks, F.col("one"), ["parent"], "at", "ahead", F.sum, block)
            .where(F.col("child").isNotNull()).select(F.col("child").alias("name"), "ahead"))

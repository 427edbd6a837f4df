"""URL rules in a sorted digest array.

The rules are a bounded list (`MOST_BYTES`). Their 64-bit xxhash keys are sorted into one array, with the rule strings
behind it for confirmation. The file is written once to the shared folder and handed to every executor, where tasks
memory-map it: workers of one machine share its pages. Probes are vectorised binary searches; a hit counts only if the
stored string equals the probed one, so collisions change nothing.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.scratch import put_file

MOST_BYTES = 1 << 30
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str  # fits this host and all its subdomains
    path: str  # fits paths that start so


def host_of(url: Column) -> Column:
    """Between the first `://` and the next `/`, `?`, `#` or the end, A-Z in lower case; empty without `://` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestIndex:
    """The rules as a file: header, sorted keys, then the offsets and bytes of what confirms them.

    `shapes` are the distinct (labels in the host, length of the path) of the rules, longest text first where one URL can
    fit several: they say which parts of a URL can be a rule at all.
    """

    def __init__(self, rules: Iterable[Rule]):
        entries: dict[str, tuple[str, str]] = {}
        shapes = set()
        for rule in rules:
            host = rule.host.translate(str.maketrans(UPPER, LOWER))
            if rule.verdict not in ("allow", "block"):
                raise ValueError(f"verdict {rule.verdict!r}")
            name, old = f"{host}\n{rule.path}", entries.get(f"{host}\n{rule.path}")
            if old and old[0] != rule.verdict:
                raise ValueError(f"two verdicts for {host}{rule.path}")
            entries[name] = (rule.verdict, host + rule.path)
            shapes.add((host.count(".") + 1, len(rule.path)))
        self.shapes = sorted(shapes)
        keys = np.array([xxhash.xxh64_intdigest(x) for x in entries], np.uint64)
        order = np.argsort(keys, kind="stable")
        names = list(entries)
        texts = [f"{entries[names[i]][0]}\t{names[i]}".encode() for i in order]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.uint64)
        self.content = np.array([len(keys)], np.uint64).tobytes() + keys[order].tobytes() + ends.tobytes() + b"".join(texts)
        if len(self.content) > MOST_BYTES:
            raise ValueError(f"the rules take {len(self.content)} bytes; at most {MOST_BYTES} are handed to every executor")


class Probe:
    """A memory-mapped index."""

    def __init__(self, path: str):
        whole = np.memmap(path, np.uint8, "r")
        n = int(whole[:8].view(np.uint64)[0])
        self.keys = whole[8:8 + 8 * n].view(np.uint64)
        self.ends = whole[8 + 8 * n:16 + 16 * n].view(np.uint64)
        self.texts = whole[16 + 16 * n:]

    def find(self, names: list[str]) -> list[str | None]:
        """The verdict of each name that is a rule."""
        out: list[str | None] = [None] * len(names)
        if not len(self.keys):
            return out
        keys = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))
        low = np.searchsorted(self.keys, keys)
        for i in np.flatnonzero(self.keys[np.minimum(low, len(self.keys) - 1)] == keys):
            at = int(low[i])
            while at < len(self.keys) and self.keys[at] == keys[i]:  # equal keys stand together
                verdict, name = bytes(self.texts[int(self.ends[at]):int(self.ends[at + 1])]).decode().split("\t", 1)
                if name == names[i]:
                    out[i] = verdict
                at += 1
        return out


def judge(urls: DataFrame, rules: Iterable[Rule], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(key, host, path, rule, verdict) for each row, repeated rows included.

    Of the rules that fit, the one with the longest text (host and path) wins, the longer host on a tie; without one, `rule`
    is null and the verdict `default`. Null URLs and URLs without `://` have an empty host and path; an empty host is matched
    by no rule. Other columns are not read.
    """
    spark: SparkSession = urls.sparkSession
    index = DigestIndex(rules)
    path = put_file(spark, "url-rules", index.content)
    spark.sparkContext.addFile(path)
    name, shapes = os.path.basename(path), index.shapes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            best: list[tuple] = [(0, 0, None, default)] * len(batch)
            labels = [h.split(".") for h in hosts]
            for many, length in shapes:
                rows = [i for i in range(len(batch)) if len(labels[i]) >= many and len(paths[i]) >= length and hosts[i]]
                ends = [".".join(labels[i][-many:]) for i in rows]
                starts = [paths[i][:length] for i in rows]
                for i, host, start, verdict in zip(rows, ends, starts, probe.find([f"{h}\n{p}" for h, p in zip(ends, starts)])):
                    if verdict:
                        best[i] = max(best[i], (len(host) + len(start), len(host), host + start, verdict), key=lambda x: x[:2])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([b[2] for b in best], pa.string()), pa.array([b[3] for b in best], pa.string())],
                ["key", "host", "path", "rule", "verdict"])

    kind = urls.schema[key].dataType.simpleString()
    parts = urls.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    parts = parts.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return parts.mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string").withColumnRenamed("key", key)

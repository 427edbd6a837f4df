"""Files that grow, followed by byte offset."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from pairloom.streaming import tail as L


@pytest.mark.parametrize("size", [1, 3, 7, 50, 10_000])
def test_ranges_share_out_every_line_once(tmp_path, size, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 5)
    rng = random.Random(size)
    for _ in range(30):
        lines = [("x" * rng.choice([0, 0, 1, 4, 5, 6, 30]) + rng.choice(["", "é", "😀"])).encode() for _ in range(rng.randint(0, 20))]
        whole = b"".join(x + b"\n" for x in lines)
        path = tmp_path / "f"
        path.write_bytes(whole + b"unfinished")
        reader = L.GrowingReader({"path": str(tmp_path), "rangebytes": str(size)})
        end = reader.latestOffset()
        assert json.loads(end["ends"]).get(str(path), 0) == len(whole)
        # Any earlier line end may be where the batch begins.
        first = sum(len(x) + 1 for x in lines[:rng.randint(0, len(lines))])
        start = {"ends": json.dumps({str(path): first} if first else {})}
        got = [(r["offset"], r["value"]) for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]
        assert got == [(at, x.decode()) for at, x in zip([sum(len(y) + 1 for y in lines[:i]) for i in range(len(lines))], lines) if at >= first]


def test_a_file_written_anew_is_read_from_its_start(tmp_path):
    path = tmp_path / "f.jsonl"
    reader = L.GrowingReader({"path": str(tmp_path), "suffix": ".jsonl"})
    path.write_text("one\ntwo\n")
    (tmp_path / "_hidden.jsonl").write_text("no\n")
    before = reader.latestOffset()
    path.write_text("new\n")
    after = reader.latestOffset()
    assert [r["value"] for p in reader.partitions(before, after) for b in reader.read(p) for r in b.to_pylist()] == ["new"]
    os.remove(path)
    assert reader.partitions(after, reader.latestOffset()) == []
    with pytest.raises(ValueError, match="growing files"):
        path.write_text("x\n")
        L.GrowingReader({"path": str(tmp_path), "maxfiles": "0"}).latestOffset()


def events(job, low, high):
    return "".join(json.dumps({"type": "metrics", "loss": float(i), "current_step": i}) + "\n" for i in range(low, high))


def test_a_stream_goes_on_behind_the_last_whole_line(spark, tmp_path):
    logs, out = tmp_path / "logs", tmp_path / "out"
    for job in ("j1", "j 2"):
        (logs / job).mkdir(parents=True)

    def run():
        stream = L.tail_growing_events(spark, str(logs)).select("job_id", "_at", "current_step")
        query = (stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(out)))
        query.awaitTermination()
        assert query.exception() is None
        rows = spark.read.parquet(str(out)).orderBy("job_id", "_at").collect()
        return [(r["job_id"], r["current_step"]) for r in rows]

    (logs / "j1/p.jsonl").write_text(events("j1", 1, 4) + '{"type": "metrics", "loss": 4.0, "curr')
    (logs / "j 2/p.jsonl").write_text("")
    assert run() == [("j1", 1), ("j1", 2), ("j1", 3)]
    assert run() == [("j1", 1), ("j1", 2), ("j1", 3)]
    with open(logs / "j1/p.jsonl", "a") as f:   # the same file grows: the rest of the line, and more
        f.write('ent_step": 4}\n\nbroken\n' + events("j1", 5, 7))
    with open(logs / "j 2/p.jsonl", "a") as f:
        f.write(events("j 2", 1, 2))
    assert run() == [("j 2", 1)] + [("j1", i) for i in range(1, 7)]


def test_large_files_are_read_in_ranges(spark, tmp_path):
    (tmp_path / "big.log").write_text("".join(f"line {i}\n" for i in range(20_000)))
    stream = L.tail_lines(spark, str(tmp_path), ".log", range_bytes=10_000)
    query = stream.withColumn("part", F.spark_partition_id()).writeStream.format("memory").queryName("big_tail").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.sql("SELECT * FROM big_tail ORDER BY offset").collect()
    assert [r["value"] for r in got] == [f"line {i}" for i in range(20_000)] and len({r["part"] for r in got}) > 10

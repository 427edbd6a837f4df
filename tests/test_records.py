"""Records over several lines, read in splits."""

import csv
import json
import random
import re

import pytest

from pairloom.sources import read as S
from pairloom.sources import records as R

FIELDS = ["plain", "", "a,b", 'say "hi"', "two\nlines", "three\n\nlines\n", "cr\r\nlf", "\n", '"', '""', '",\n"', " pad ", "naïve 日本", "x" * 50]


def written(path, rows, header=("a", "b", "c"), **kw):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, **{"lineterminator": "\n", **kw}).writerows([header, *rows])


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "600")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def some_rows(seed, n):
    rng = random.Random(seed)
    return [(str(i), rng.choice(FIELDS), rng.choice(FIELDS)) for i in range(n)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("quoting", [csv.QUOTE_MINIMAL, csv.QUOTE_ALL])
def test_records_equal_those_of_one_task(spark, tmp_path, small_splits, end, quoting, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 500)
    want = []
    for name in ("a", "b"):
        rows = some_rows(ord(name), 150)
        written(tmp_path / f"{name}.csv", rows, lineterminator=end, quoting=quoting)
        want += rows
    path = f"{tmp_path}/*.csv"
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 8   # several tasks for one file
    assert R.quoted_records(spark, path) is not None
    got = S.read_file(spark, path, "csv", lineage=True)
    rows = [tuple(r[c] or "" for c in "abc") for r in got.orderBy("_ord").collect()]
    assert rows == want
    one = S.read_file(spark, path, "csv", multiLine=True)
    key = lambda r: (r["_ord"])
    feeds = lambda r: tuple((x or "").replace("\r\n", "\n") for x in tuple(r)[:3])  # noqa: E731  one task's parser may normalise them
    assert [feeds(r) for r in sorted(got.collect(), key=key)] == [feeds(r) for r in sorted(one.collect(), key=key)]
    assert got.select("_file").distinct().count() == 2 and got.columns == ["a", "b", "c", "_file", "_ord"]


@pytest.fixture
def always(spark, monkeypatch):
    """Files of any size are read in splits."""
    monkeypatch.setattr(S, "_can_be_split", lambda *_: True)


def test_small_files_are_one_task_s(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text('a\n"x\ny"\n')
    monkeypatch.setattr(S, "spans_lines", None)   # not even looked for
    assert S.read_file(spark, str(tmp_path / "a.csv")).first()["a"] == "x\ny"
    try:
        for size, split in (("1b", True), ("1k", False), ("2", True), ("1g", False)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert S._can_be_split(spark, str(tmp_path / "a.csv")) is split
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_other_uses_of_quotes_take_the_old_way(spark, tmp_path, always):
    (tmp_path / "q.csv").write_text('a,b\n5" pipe,x\n6,"y\nz"\n7,w\n')
    assert R.spans_lines(spark, str(tmp_path / "q.csv")) and R.quoted_records(spark, str(tmp_path / "q.csv")) is None
    want = [tuple(r)[:2] for r in S.read_file(spark, str(tmp_path / "q.csv"), multiLine=True).orderBy("_ord").collect()]
    assert [tuple(r)[:2] for r in S.read_file(spark, str(tmp_path / "q.csv")).orderBy("_ord").collect()] == want
    semicolons = tmp_path / "s.csv"
    semicolons.write_text('a;b\n1;"x\ny;z"\n')
    assert [tuple(r)[:2] for r in S.read_file(spark, str(semicolons), sep=";").collect()] == [("1", "x\ny;z")]


def test_broken_records(spark, tmp_path, always):
    (tmp_path / "b.csv").write_text('a,b\n1,"x\ny"\ntwo,z\n3,w\n')
    read = lambda how: S.read_file(spark, str(tmp_path / "b.csv"), schema="a int, b string", on_error=how)
    assert sorted(tuple(r)[:2] for r in read("drop").collect()) == [(1, "x\ny"), (3, "w")]
    kept = {r["b"]: r["_error"] for r in read("quarantine").collect()}
    assert kept == {"x\ny": None, "z": "two,z", "w": None}
    with pytest.raises(Exception):
        read("fail").collect()


def test_no_header_and_schema(spark, tmp_path, always):
    (tmp_path / "n.csv").write_text('1,"x\ny"\n\n2,z\n')
    got = S.read_file(spark, str(tmp_path / "n.csv"), schema="n long, t string", header=False)
    assert [tuple(r)[:2] for r in got.orderBy("_ord").collect()] == [(1, "x\ny"), (2, "z")]
    assert dict(got.dtypes)["n"] == "bigint"


# ---- JSON arrays --------------------------------------------------------------------------------------------

TEXTS = ["plain", "", 'say "hi"', "brace } in text", "{[", "}, {", "back\\slash", 'end\\"', "two\nlines", "naïve 日本", "]", "\\"]


def some_objects(seed, n):
    rng = random.Random(seed)
    return [{"n": i, "t": rng.choice(TEXTS), **({"in": {"a": [rng.choice(TEXTS), {"b": rng.choice(TEXTS)}]}} if rng.random() < 0.6 else {})} for i in range(n)]


@pytest.mark.parametrize("style", [{"indent": 2}, {}, {"separators": (",", ":")}, {"ensure_ascii": False, "indent": 1}])
def test_arrays_are_read_in_splits(spark, tmp_path, small_splits, style, monkeypatch):
    monkeypatch.setattr(R, "BLOCK", 700)
    want = []
    for name in ("a", "b"):
        objects = some_objects(ord(name), 80)
        (tmp_path / f"{name}.json").write_text(json.dumps(objects, **style) + "\n", encoding="utf-8")
        want += objects
    path = f"{tmp_path}/*.json"
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 8
    found = R.array_elements(spark, path)
    assert [json.loads(r["value"]) for r in found.orderBy("_ord").collect()] == want
    schema = "n long, t string, `in` struct<a:array<string>>"
    got = S.read_file(spark, path, "json", schema, lineage=True).orderBy("_ord").collect()
    one = S.read_file(spark, path, "json", schema, multiLine=True).orderBy("_ord").collect()
    plain = lambda rows: [re.sub(r"(\\n|\s)+", " ", repr(tuple(r)[:3])) for r in rows]  # noqa: E731  objects taken over as text: blanks for line ends
    assert plain(got) == plain(one) and [r["t"] for r in got] == [r["t"] for r in one] and len({r["_file"] for r in got}) == 2
    inferred = S.read_file(spark, path, "json")
    assert inferred.columns == ["in", "n", "t", "_ord"] and inferred.count() == 160


def test_other_documents_take_the_old_way(spark, tmp_path, always):
    for i, (text, rows) in enumerate([('{"a": 1,\n "b": {"c": 2}}', 1), ("[]", 0), ("[\n]", 0), ('[{}, {"a": 1}\n]', 2), ('[{"a": 1}\n, {"a": 2}', None)]):
        path = tmp_path / f"{i}.json"
        path.write_text(text)
        if rows is None:
            assert R.array_elements(spark, str(path)) is None   # never closed
            continue
        got = S.read_file(spark, str(path), schema="a long")
        assert got.count() == S.read_file(spark, str(path), schema="a long", multiLine=True).count() == rows, text


def test_broken_objects(spark, tmp_path, always):
    (tmp_path / "b.json").write_text('[{"a": 1},\n {"a": },\n {"a": 3}]')
    kept = S.read_file(spark, str(tmp_path / "b.json"), schema="a long", on_error="quarantine").orderBy("_ord").collect()
    assert [(r["a"], r["_error"]) for r in kept] == [(1, None), (None, '{"a": }'), (3, None)]
    dropped = S.read_file(spark, str(tmp_path / "b.json"), schema="a long", on_error="drop")
    assert sorted(r["a"] for r in dropped.collect()) == [1, 3]
    with pytest.raises(Exception):
        S.read_file(spark, str(tmp_path / "b.json"), schema="a long").collect()

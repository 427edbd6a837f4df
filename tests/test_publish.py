"""Replacing a manifest by its edited version."""

import json
import os

import pytest

from pairloom.operators import edits as E
from pairloom.operators.vision import read_lines
from pairloom.sources import publish as P


def rows(n):
    return "".join(json.dumps({"image": f"{i}.png", "prompt": f"caption {i}"}) + "\n" for i in range(n)) + "{broken\n"


def prompts(spark, path):
    found = [r["line"] for r in read_lines(spark, str(path)).orderBy("row_index").collect()]
    return [json.loads(x)["prompt"] if x != "{broken" else None for x in found]


@pytest.fixture
def change(spark):
    edits = spark.createDataFrame([(1, "new"), (0, "lost")], "row_index long, prompt string")
    return edits, spark.createDataFrame([(0,)], "row_index long")


@pytest.mark.parametrize("kind", ["file", "folder"])
def test_the_original_path_holds_the_edited_rows(spark, tmp_path, change, kind):
    path = tmp_path / "m.jsonl"
    if kind == "file":
        path.write_text(rows(4))
    else:
        spark.createDataFrame([(x,) for x in rows(4).splitlines()], "value string").coalesce(1).write.text(str(path))
    report = E.rewrite_in_place(spark, str(path), *change)
    assert tuple(report.first()) == (5, 4, 1, 1)
    assert prompts(spark, path) == ["new", "caption 2", "caption 3", None] and path.is_file() == (kind == "file")
    assert prompts(spark, f"{path}.bak") == [f"caption {i}" for i in range(4)] + [None]
    E.rewrite_in_place(spark, str(path), *change)   # the backup keeps the first version
    assert prompts(spark, path) == ["new", "caption 3", None]
    assert prompts(spark, f"{path}.bak")[0] == "caption 0"
    assert sorted(os.listdir(tmp_path)) in (["m.jsonl", "m.jsonl.bak"], [".m.jsonl.bak.crc", ".m.jsonl.crc", "m.jsonl", "m.jsonl.bak"])


def test_large_files_become_folders(spark, tmp_path, change, monkeypatch):
    monkeypatch.setattr(P, "ONE_FILE", 10)
    path = tmp_path / "m.jsonl"
    path.write_text(rows(300))
    E.rewrite_in_place(spark, str(path), *change)
    assert path.is_dir() and (tmp_path / "m.jsonl.bak").is_file()
    assert prompts(spark, path) == ["new"] + [f"caption {i}" for i in range(2, 300)] + [None]


@pytest.mark.parametrize("kind", ["file", "folder"])
@pytest.mark.parametrize("stage", ["write", "check", "move"])
def test_a_failure_leaves_the_original(spark, tmp_path, monkeypatch, kind, stage):
    path = tmp_path / "m.jsonl"
    if kind == "file":
        path.write_text("old\n")
    else:
        spark.createDataFrame([("old",)], "value string").coalesce(1).write.text(str(path))

    def write(to, one):
        spark.createDataFrame([("new",)], "value string").coalesce(1).write.text(to)
        if stage == "write":
            raise RuntimeError("stopped")

    def check(_):
        if stage == "check":
            raise RuntimeError("stopped")

    if stage == "move":
        real = P.Place.move

        def move(self, to):
            if ".tmp-" in self.name:
                raise RuntimeError("stopped")
            real(self, to)

        def replace(self, file):
            raise RuntimeError("stopped")
        monkeypatch.setattr(P.Place, "move", move)
        monkeypatch.setattr(P.Place, "replace", replace)
    with pytest.raises(RuntimeError, match="stopped"):
        P.replace_path(spark, str(path), write, check)
    assert [r[0] for r in spark.read.text(str(path)).collect()] == ["old"]
    assert not [n for n in os.listdir(tmp_path) if ".tmp-" in n]


def test_a_driver_that_died_between_moves(spark, tmp_path):
    path = tmp_path / "m"
    spark.createDataFrame([("old",)], "value string").coalesce(1).write.text(str(path))
    os.rename(path, f"{path}.old-123")
    assert P.recover(spark, str(path)) and not P.recover(spark, str(path))
    assert [r[0] for r in spark.read.text(str(path)).collect()] == ["old"]
    with pytest.raises(FileNotFoundError):
        P.replace_path(spark, str(tmp_path / "absent"), lambda to, one: None)


def test_a_wrong_number_of_lines_stops_the_commit(spark, tmp_path, change, monkeypatch):
    path = tmp_path / "m.jsonl"
    path.write_text(rows(4))
    monkeypatch.setattr(E, "apply_edits", lambda lines, *a: lines.limit(2))
    with pytest.raises(ValueError, match="lines were written"):
        E.rewrite_in_place(spark, str(path), *change)
    assert path.read_text() == rows(4)

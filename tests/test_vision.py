import json

import pytest
from pyspark.sql import functions as F

from pairloom.operators import edits as E
from pairloom.operators import vision as V


def write(path, lines):
    path.write_text("".join(f"{line}\n" for line in lines))
    return str(path)


@pytest.fixture
def manifest(tmp_path):
    rows = [json.dumps({"prompt": f"caption {i}", "image": f"img/{i}.png", "seed": i}) for i in range(4)]
    return write(tmp_path / "train.jsonl", [rows[0], "", rows[1], "{broken", "   ", rows[2], rows[3]])


def test_lines_are_numbered_without_blank_ones(spark, manifest, tmp_path):
    got = V.read_lines(spark, manifest).orderBy("row_index").collect()
    assert [r["row_index"] for r in got] == list(range(5))
    assert got[2]["line"] == "{broken" and {r["base"] for r in got} == {str(tmp_path)}


def test_lines_of_many_splits(spark, tmp_path):
    for part in range(3):
        write(tmp_path / f"{part}.jsonl", [f"{part}-{i:04}" if i % 3 else " " for i in range(2000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        lines = V.read_lines(spark, f"{tmp_path}/*.jsonl")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")   # as if cores came or went
        got = lines.orderBy("row_index").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want = [f"{part}-{i:04}" for part in range(3) for i in range(2000) if i % 3]
    assert [r["line"] for r in got] == want and [r["row_index"] for r in got] == list(range(len(want)))


def test_preview(spark, manifest, tmp_path):
    lines = V.read_lines(spark, manifest)
    got = V.preview_manifest(lines, limit=2, offset=1).collect()
    assert [(r["row_index"], r["prompt"], r["image_path"]) for r in got] == [
        (1, "caption 1", f"{tmp_path}/img/1.png"), (3, "caption 2", f"{tmp_path}/img/2.png")]
    assert V.preview_manifest(lines, limit=0).count() == 1
    assert V.preview_manifest(lines, caption_column="absent").first()["prompt"] == ""


def test_preview_probes_keys_in_order(spark, tmp_path):
    rows = [{"chosen": "/abs/c.png", "caption": "cap"}, {"image": 5, "rejected": "../r.png", "prompt": None, "caption": "unused"},
            {"image": 7}, {"image": "./i.png", "prompt": "p", "caption": "c"}, [1]]
    path = write(tmp_path / "m.jsonl", [json.dumps(r) for r in rows])
    got = [tuple(r) for r in V.preview_manifest(V.read_lines(spark, path)).collect()]
    assert got == [(0, "cap", "/abs/c.png", "chosen", "caption"),
                   (1, "", f"{tmp_path.parent}/r.png", "rejected", "prompt"),
                   (3, "p", f"{tmp_path}/i.png", "image", "prompt")]


def test_manifest_paths_and_canonical_columns(spark, tmp_path):
    rows = [{"caption": "c", "image": "a/../b.png"}, {"prompt": "p", "image": "/x/y.png", "chosen": "z.png"}, {"caption": "u", "image": "s3://bucket/k.png"}]
    path = write(tmp_path / "m.jsonl", [json.dumps(r) for r in rows])
    got = V.read_manifest(spark, path).orderBy("_ord").select("prompt", "image", "chosen").collect()
    assert [tuple(r) for r in got] == [("c", f"{tmp_path}/b.png", f"{tmp_path}/b.png"), ("p", "/x/y.png", f"{tmp_path}/z.png"),
                                       ("u", "s3://bucket/k.png", "s3://bucket/k.png")]


def test_image_folder(spark, tmp_path):
    for name in ("b.PNG", "a.jpeg", "notes.pdf", "c d.webp"):
        (tmp_path / name).write_bytes(b"\x00" + name.encode())
    (tmp_path / "a.txt").write_text("  a caption \n")
    got = V.read_image_dir(spark, str(tmp_path)).orderBy("image").collect()
    assert [tuple(r) for r in got] == [(f"{tmp_path}/a.jpeg", "a caption"), (f"{tmp_path}/b.PNG", ""), (f"{tmp_path}/c d.webp", "")]
    with_bytes = V.read_image_dir(spark, str(tmp_path), with_bytes=True).where("image LIKE '%.PNG'").first()
    assert bytes(with_bytes["content"]) == b"\x00b.PNG"


def test_building_a_manifest(spark, rows):
    files = spark.createDataFrame([("up/red_fox-1.png",), ("up/b.png",), ("up/c.png",), ("d.png",)], "path string")
    captions = spark.createDataFrame([("b.png", "by base"), ("up/c.png", "by path"), ("c.png", "unused"), ("d.png", "")], "name string, caption string")
    assert rows(V.build_manifest(files, captions)) == [("d.png", "d"), ("up/b.png", "by base"), ("up/c.png", "by path"), ("up/red_fox-1.png", "red fox 1")]
    assert V.build_manifest(files).where("image = 'up/b.png'").first()["prompt"] == "b"


def test_edits(spark, manifest, tmp_path):
    edits = spark.createDataFrame([(1, 'EDITED "caption"'), (2, "broken stays"), (4, "lost")], "row_index long, prompt string")
    deletes = spark.createDataFrame([(4,), (99,)], "row_index long")
    report = E.rewrite_manifest(spark, manifest, str(tmp_path / "out"), edits, deletes).first()
    assert tuple(report) == (5, 4, 1, 2)
    lines = V.read_lines(spark, str(tmp_path / "out" / "*.txt")).orderBy("row_index").collect()
    assert [json.loads(r["line"]) if r["line"] != "{broken" else None for r in lines] == [
        {"prompt": "caption 0", "image": "img/0.png", "seed": 0}, {"prompt": 'EDITED "caption"', "image": "img/1.png", "seed": 1},
        None, {"prompt": "caption 2", "image": "img/2.png", "seed": 2}]
    other = E.apply_edits(V.read_lines(spark, manifest), edits, deletes, "caption").where("row_index = 1").first()
    assert json.loads(other["line"])["caption"] == 'EDITED "caption"' and json.loads(other["line"])["prompt"] == "caption 1"


def test_caption_messages(spark):
    df = spark.createDataFrame([(1, bytearray(b"i"), "cap")], "id int, image binary, caption string")
    row = V.caption_messages(df, "Describe.").first()
    assert [bytes(i) for i in row["images"]] == [b"i"] and row["id"] == 1
    user, assistant = row["messages"]
    assert [tuple(p) for p in user["parts"]] == [("image", None), ("text", "Describe.")] and assistant["content"] == "cap"


def test_unified_rows(spark):
    doc = json.dumps([{"role": "user", "content": [{"type": "image"}]}, {"role": "assistant", "content": "a"}])
    df = spark.createDataFrame([(0, doc, bytearray(b"x")), (1, '[{"role":"user","content":"t"}]', None)], "_ord long, messages string, image binary")
    out = V.unified_messages(df).orderBy("_ord").select(F.size("images"), F.size("messages"), F.to_json("messages")).collect()
    assert [tuple(r)[:2] for r in out] == [(1, 2), (0, 1)]
    assert json.loads(out[0][2]) == json.loads(doc)


def test_corpora_are_bounded_filtered_and_split(spark):
    df = spark.createDataFrame([(i, bytearray(b"x"), f"c{i}") for i in range(150)], "_ord long, image binary, caption string")
    train, held = V.prepare_captions(df, "Describe.", max_samples=120, test_size=0.05)
    assert (train.count(), held.count()) == (114, 6)
    assert V.prepare_captions(df, "Describe.", max_samples=100)[1].count() == 1
    assert V.prepare_captions(df, "Describe.", max_samples=100, more_than=100)[1] is None
    docs = spark.createDataFrame([(i, json.dumps([{"role": "user", "content": "x" * (i % 50)}]), None) for i in range(400)],
                                 "_ord long, messages string, image binary")
    train, held = V.prepare_unified(docs, max_seq_length=15, max_samples=110)
    assert train.count() + held.count() == 110 and held.count() == 2
    assert train.where(F.length(F.to_json("messages")) > 60).count() == 0

"""Exact text files and JSON documents."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import files, io

NAMES = ["plain.txt", "Poe, E_[The Raven]: 1.txt", "a b%3A=?*.txt", "sub/folder:x/é.txt", "file=x", "_hidden", ".dot"]


def test_text_files_are_exact(spark, tmp_path):
    texts = ["a\nb", "", None, "no end", "\r\n\n", "ünï \U0001f600", "x" * 3_000_000]
    folder = str(tmp_path / "out")
    df = spark.createDataFrame(list(zip(NAMES, texts, strict=True)), "filename string, text string").repartition(3)
    io.write_texts(df, folder)
    for name, text in zip(NAMES, texts, strict=True):
        assert (tmp_path / "out" / name).read_bytes() == (text or "").encode()
    meta = spark.createDataFrame([(i, n) for i, n in enumerate([*NAMES, "none.txt"])], "id long, filename string")
    assert {r.id: r.text for r in io.read_texts(spark, meta, folder).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert [r.id for r in io.missing_files(spark, meta, "file://" + folder).collect()] == [len(NAMES)]
    assert sum(p.is_file() for p in (tmp_path / "out").rglob("*")) == len(NAMES) and not list((tmp_path / "out").glob("_staging-*"))
    io.write_texts(df.limit(1), folder)  # overwrites
    assert sum(p.is_file() for p in (tmp_path / "out").rglob("*")) == 1


@pytest.mark.parametrize("name", ["../up.txt", "/abs.txt", "", None])
def test_names_stay_below_the_folder(spark, tmp_path, name):
    df = spark.createDataFrame([("ok.txt", "x"), (name, "y")], "filename string, text string").coalesce(1)
    with pytest.raises(Exception, match="not a file name"):
        io.write_texts(df, str(tmp_path / "out"))
    assert not [p for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith(".") and p.name != "ok.txt"]


def test_an_aborted_write_leaves_nothing(tmp_path):
    writer = files._Writer(str(tmp_path / "out"), False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a.txt", "b/c.txt"]), pa.array(["1", "2"])], ["filename", "text"])
    message = writer.write(iter([batch]))
    assert (tmp_path / "out" / "b" / "c.txt").read_text() == "2"
    writer.abort([message, None])
    assert not [p for p in tmp_path.rglob("*") if p.is_file()]


def test_reading_is_split(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "TASK_BYTES", 10)
    for i in range(6):
        (tmp_path / f"{i}.txt").write_text("x" * 4)
    reader = files._Reader(str(tmp_path), True)
    parts = reader.partitions()
    assert [len(p.names) for p in parts] == [2, 2, 2]
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 6
    assert files._Reader(str(tmp_path), False).partitions()[0].names == [f"{i}.txt" for i in range(6)]


def test_documents(spark, tmp_path):
    rows = [(i, f'quote " and\nline {i}', ["a", "é"], None if i % 2 else 1.5) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, title string, subjects array<string>, score double").repartition(7, "id")
    path = str(tmp_path / "doc.json")
    io.write_metadata(df, path, {"source": "part é", "n": 500})
    whole = json.loads((tmp_path / "doc.json").read_text())
    assert whole["summary"] == {"source": "part é", "n": 500} and len(whole["books"]) == 500
    want = sorted((i, t, s, x) for i, t, s, x in rows)
    assert sorted((r.id, r.title, r.subjects, r.score) for r in io.read_metadata(spark, path).collect()) == want
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        own = io.read_metadata(spark, path)
        assert own.select(F.spark_partition_id()).distinct().count() > 3 and own.count() == 500
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    io.write_list(df.select("id", "title"), path)
    assert sorted(x["id"] for x in json.loads((tmp_path / "doc.json").read_text())) == list(range(500))
    assert io.read_metadata(spark, path).count() == 500
    io.write_metadata(df.limit(0), path, {"n": 0})
    assert json.loads((tmp_path / "doc.json").read_text()) == {"summary": {"n": 0}, "books": []}
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["doc.json"]


def test_documents_of_another_layout(spark, tmp_path):
    books = [{"id": i, "title": f"t{i}"} for i in range(5)]
    for n, text in enumerate([json.dumps({"summary": {}, "books": books}, indent=2), json.dumps(books, indent=2), json.dumps(books)]):
        (tmp_path / f"{n}.json").write_text(text)
        assert sorted(r.id for r in io.read_metadata(spark, str(tmp_path / f"{n}.json")).collect()) == list(range(5))

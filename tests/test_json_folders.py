"""Directories of JSON files read by tasks: the same rows as Spark's own reader, and no file names in the driver."""

import pytest
from pyspark.sql import functions as F

from trailmark.sinks import writers
from trailmark.sources import documents

ODD = ["a b.json", "p%20q.json", "ä# 　.json", "x+y=(z)&$,;@!~'*.json", "[b]{c}|^`<\">?.json", "_k=1.json", "A.JSON", ".h.json", "_h.json", "t.txt", "a.json._COPYING_"]
TEXTS = [b'{"x": 1}', b'{"x": "\xc3\xa4\n"}', b"", b" \n", b"{", b"[1]", b'{"x": 1}}', b'{"x": "\xff"}']


def lay(folder, files):
    for name, text in files.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(text)
    return str(folder)


def found(df):
    return sorted((r.file_name, r.problem or "", r.value) for r in df.select("file_name", "problem", F.hex(F.col("value").cast("binary")).alias("value")).collect())


def by_spark(spark, directory):
    text = spark.read.text(directory, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file_name"), "value")
    return found(documents.parse_objects(text, strict_mode=False))


@pytest.mark.parametrize("files", [
    {name: TEXTS[0] for name in ODD},
    {f"{i}.json": text for i, text in enumerate(TEXTS)},
    {f"part={i % 3}/{i}.json": text for i, text in enumerate(TEXTS)} | {"_hidden/a.json": b"{}", "_SUCCESS": b""},
    {"k=%zz/a.json": b"{}", "k=__HIVE_DEFAULT_PARTITION__/a.json": b"{}"},
    {"a.json": b"{}", "sub/b.json": b"{}"}, {"sub/b.json": b"{}"}, {"k=1/j=1/a.json": b"{}", "k=2/j=1/a.json": b"{}"}, {"k=1/sub/a.json": b"{}", "k=2/b.json": b"{}"},
    {"a.json": b"{}", "k=1/b.json": b"{}"}, {"a.json/b.json": b"{}", "c.json": b"{}"},
])
def test_the_rows_are_those_of_sparks_reader(spark, tmp_path, monkeypatch, files):
    monkeypatch.setattr(documents, "BATCH_FILES", 2)
    directory = lay(tmp_path / "files", files)
    for path in (directory, f"file://{directory}/"):
        assert found(documents.read_json_files(spark, path, strict_mode=False)) == by_spark(spark, directory)


def test_the_driver_lists_no_receipts(spark, tmp_path):
    path = str(tmp_path / "records")
    writers.write_json_files(spark.range(500).coalesce(2), path)
    assert {len(list(folder.iterdir())) for folder in (tmp_path / "records").iterdir()} <= {6, 7, 8, 9}  # dealt in turn
    read = documents.read_json_files(spark, path)
    assert not [f for f in read.inputFiles() if "records" in f]
    assert read.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    (tmp_path / "records" / "part=0" / "late.json").write_text("{}")
    assert read.count() == 500 and documents.read_json_files(spark, path).count() == 501


def test_tasks_follow_files_and_bytes(spark, tmp_path, monkeypatch):
    directory = lay(tmp_path / "files", {f"{i}.json": b'{"x": "%s"}' % (b"y" * 50) for i in range(300)})
    monkeypatch.setattr(documents, "FILES", 10)
    assert documents.read_json_files(spark, directory).rdd.getNumPartitions() == 30
    monkeypatch.setattr(documents, "FILES", 10_000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900b")
    try:
        read = documents.read_json_files(spark, directory)
        assert read.rdd.getNumPartitions() == 300 * 59 // 900 + 1 and read.count() == 300
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)

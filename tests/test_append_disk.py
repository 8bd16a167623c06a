"""What an append leaves on disk, and that its parts give the same store."""

import os
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import keyed
from trailmark.session import SHUFFLE_CLEANUP, kept, scratch_path, shared_folder
from trailmark.sinks import writers


def scratch(spark):
    folder = shared_folder(spark).removeprefix("file:") + "/trailmark"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def records(spark, low, high):
    return spark.range(low, high).select("id", F.concat(F.lit("payload "), "id").alias("payload"))


@pytest.mark.parametrize("slice_bytes", [1, 64 << 20])
@pytest.mark.parametrize("stored", [False, True])
def test_an_append_leaves_nothing_but_its_store(spark, tmp_path, monkeypatch, stored, slice_bytes):
    monkeypatch.setattr(writers, "SLICE", slice_bytes)
    path, before, setting = str(tmp_path / "store"), scratch(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    writers.append_once(records(spark, 0, 300), path, "id", stored=stored)
    mixed = records(spark, 250, 400).unionByName(records(spark, 390, 410)).unionByName(records(spark, 0, 5))  # old, new and twice
    for _ in range(2):
        writers.append_once(mixed, path, "id", stored=stored)
        assert keyed(writers.read_store(spark, path), "id", "payload") == {i: f"payload {i}" for i in range(410)}
        assert writers.read_store(spark, path).count() == 410
    with pytest.raises(writers.ConflictError):
        writers.append_once(records(spark, 405, 420).withColumn("payload", F.lit("other")), path, "id", stored=stored)
    writers.append_once(records(spark, 0, 0), str(tmp_path / "none"), "id", stored=stored)
    assert spark.read.schema("id long").parquet(str(tmp_path / "none")).count() == 0
    assert scratch(spark) == before and spark.conf.get(SHUFFLE_CLEANUP, None) == setting


def test_a_kept_table_goes_with_its_block_and_its_shuffle_files_before(spark):
    before = scratch(spark)
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    written = lambda: {f for d in local for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}
    files = written()
    with kept(records(spark, 0, 5000).repartition(7, "id"), "block") as table:
        until = time.time() + 20
        while written() - files and time.time() < until:  # executors delete them in the background
            time.sleep(0.1)
        assert not written() - files
        assert table.count() == 5000 and len(scratch(spark) - before) == 1
    assert scratch(spark) == before and scratch_path(spark, "block")


def test_tables_of_a_block_that_fails_go_too(spark):
    before = scratch(spark)
    with pytest.raises(ZeroDivisionError), kept(records(spark, 0, 5), "block"):
        raise ZeroDivisionError
    with pytest.raises(Exception, match="no such row"), kept(spark.range(5).select(F.raise_error(F.lit("no such row")).alias("x")), "block"):
        pass
    assert scratch(spark) == before

"""One file for each record, written by the tasks themselves."""

import json

from pyspark.sql import functions as F

from trailmark.sinks import writers
from trailmark.sources import receipts


def test_one_file_for_each_record_in_many_folders(spark, tmp_path):
    made = spark.range(200).select(F.col("id"), F.concat(F.lit("a\n\u00e4"), "id").alias("text"), F.lit(None).cast("string").alias("none"))
    made = made.unionByName(made.where("id < 3"))
    path = str(tmp_path / "records")
    writers.write_json_files(made, path)
    found = [json.loads(p.read_text()) for p in (tmp_path / "records").rglob("*.json")]
    key = lambda r: (r["id"], r["text"])
    assert sorted(found, key=key) == sorted(({"id": r.id, "text": r.text} for r in made.collect()), key=key)
    assert len(list((tmp_path / "records").iterdir())) == writers.FOLDERS
    assert receipts.read_receipts(spark, path).count() == 203
    writers.write_json_files(made.limit(0), str(tmp_path / "none"))
    assert receipts.read_receipts(spark, str(tmp_path / "none")).count() == 0

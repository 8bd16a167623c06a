"""Fractions of any length, and landings that delete nothing."""

import pytest
from pyspark.sql import functions as F

from trailmark.operators import grading
from trailmark.sources import receipts

LONG = "7" * 5000
PAIRS = [
    ("1/2", "0.5000000", True), ("1234567890123/2", "2469135780246/4", True), ("1234567890123/2", "2469135780247/4", False),
    (f"{LONG}/3", f"\\frac{{{LONG}0}}{{30}}", True), (f"{LONG}/3", f"{LONG}1/3", False), ("-1/3", "1/-3.0000000", True),
    ("1/0", "1/0", True), ("1/0", "2/0", False), ("x/2", "x/2", True), ("1/3", "0.3333333333333333", False), ("0/5", "-0.00000000", True),
    ("1e5/2", "50000", False), (".5000000/1", "1/2", True),
]


def test_fractions_of_any_length(spark):
    graded = grading.evaluate_pairs(spark.createDataFrame([p[:2] for p in PAIRS], "r string, c string").coalesce(1), "r", "c")
    assert [r.evaluation.correct for r in graded.collect()] == [p[2] for p in PAIRS]


def test_landing_other_receipts_fails(spark, tmp_path):
    path = str(tmp_path / "landed")
    rows = spark.createDataFrame([("a", 1), ("b", None), ("b", None)], "rollout_id string, n long")
    receipts.land_receipts(rows, path)
    receipts.land_receipts(rows.repartition(3), path)
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError, match="holds other receipts"):
        receipts.land_receipts(rows.where(F.col("n") == 1), path)
    assert spark.read.parquet(path).count() == 3
    receipts.land_receipts(rows.limit(0), str(tmp_path / "none"))
    receipts.land_receipts(rows, str(tmp_path / "none"))
    assert spark.read.parquet(str(tmp_path / "none")).count() == 3

"""Sums of doubles against exact fractions."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.operators import stages
from trailmark.operators.exact import exact_totals, totals_with


def total_of(spark, values, copies=1, parts=3):
    rows = spark.createDataFrame([("m", v, copies) for v in values], "metric string, value double, copies long").repartition(parts)
    found = exact_totals(rows, ["metric"], "value", "copies").collect()
    return found[0].total if found else None


@pytest.mark.parametrize("seed", range(3))
def test_any_sizes(spark, seed):
    random = np.random.default_rng(seed)
    values = (random.normal(size=400) * 10.0 ** random.integers(-300, 300, 400)).tolist()
    values += [5e-324, -5e-324, 2.2e-308, 1.7e308, -1.7e308, 0.0, -0.0, 1.0, 2.0**-1022, 2.0**1023, -(2.0**1023)]
    wanted = float(sum(map(Fraction, values)))
    assert total_of(spark, values) == wanted == math.fsum(values)


@pytest.mark.parametrize("value", [1e16, 3e-12, 1e300, 0.1, 2.0**52 - 0.5, 5e-324])
def test_copies(spark, value):
    assert total_of(spark, [value] * 3, copies=1_000_003) == float(Fraction(value) * 3_000_009)


def test_cancelling_terms(spark):
    assert total_of(spark, [1e300, 0.5, -1e300] * 7 + [1e16, 1.0, -1e16]) == 4.5
    assert total_of(spark, [0.1] * 10) == math.fsum([0.1] * 10)


def test_odd_values(spark):
    assert total_of(spark, []) is None and total_of(spark, [None, None]) is None
    assert total_of(spark, [None, 0.0]) == 0.0
    assert total_of(spark, [1.0, float("inf")]) == float("inf")
    assert math.isnan(total_of(spark, [float("inf"), float("-inf")])) and math.isnan(total_of(spark, [1.0, float("nan")]))
    assert total_of(spark, [1.7e308, 1.7e308]) == float("inf") and total_of(spark, [-1.7e308] * 2) == float("-inf")


def test_totals_beside_other_aggregates(spark):
    values = [1e300, 0.5, -1e300, None, 3e-12, 1e16, float("nan"), 0.25, 1.0]
    rows = spark.createDataFrame([(v, i % 3, i) for i, v in enumerate(values)], "value double, kind int, n long").repartition(4)
    totals = {"all_but_nan": ~F.isnan("value"), "every": F.lit(True), "kind_one": F.col("kind") == 1, "none": F.col("kind") == 7}
    found = totals_with(rows, "value", totals, [F.sum("n").alias("n"), F.count("value").alias("known")], [F.max("n").alias("top")]).collect()
    assert len(found) == 1 and (found[0].n, found[0].known, found[0].top) == (36, 8, 8)
    finite = [v for v in values if v is not None and not math.isnan(v)]
    assert found[0].all_but_nan == math.fsum(finite) and math.isnan(found[0].every)
    assert found[0].kind_one == math.fsum([0.5, 3e-12, 0.25]) and found[0].none is None


def test_totals_of_an_empty_table(spark):
    rows = spark.createDataFrame([], "value double, n long")
    found = totals_with(rows, "value", {"total": F.lit(True)}, [F.count("*").alias("rows")], [F.max("n").alias("top")]).collect()
    assert [tuple(r) for r in found] == [(0, None, None)]


def test_generation_times_of_any_size(spark):
    schema = "status string, generation_recorded boolean, generated_token_count long, elapsed_seconds double"
    times = [1e16, 3e-12, 1.0, -1e16, 1e300, -1e300]
    receipts = spark.createDataFrame([("COMPLETED", True, 2, t) for t in times], schema).repartition(3)
    found = stages.generation_performance(receipts).collect()[0]
    assert found.elapsed_total == math.fsum(times) and found.tokens_per_second == 12 / math.fsum(times)

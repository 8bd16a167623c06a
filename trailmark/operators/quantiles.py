"""Exact order statistics without collecting a metric into one task.

Input rows are (metric, value); metrics are the few names a report declares, so every
table keyed by metric alone is tiny and can be broadcast whatever the data size.
Values are first reduced to distinct (metric, value, count) rows, so copies and hot
values collapse before the shuffle. Approximate cut points only split the distinct
values into bins of similar size; ranks are then counted exactly, over bin totals
first and inside the few bins that hold a wanted rank afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 256  # a power of two


def value_counts(df: DataFrame) -> DataFrame:
    """Distinct values with their number of copies.

    The always-true filter keeps the count in every later branch, even one that needs
    only the values, so that all branches read the same exchange and scan once.
    """
    counts = df.where(F.col("value").isNotNull()).groupBy("metric", "value").agg(
        F.count("*").alias("copies")
    )
    return counts.where("copies > 0")


def _bin(cuts: Column, value: Column) -> Column:
    """Number of the ``BINS - 1`` sorted cuts below ``value``, by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(BINS.bit_length() - 1))])
    return F.aggregate(
        steps,
        F.lit(0),
        lambda low, step: low + F.when(F.get(cuts, low + step - 1) < value, step).otherwise(0),
    )


def values_at_ranks(counts: DataFrame, ranks: dict[str, Column]) -> DataFrame:
    """One row per metric with the value at each requested 1-based rank.

    ``counts`` comes from :func:`value_counts`; ``ranks`` maps an output name to an
    expression over ``n``, the number of values of the metric.
    """
    grid = ", ".join(f"{i / BINS}D" for i in range(1, BINS))
    cuts = counts.groupBy("metric").agg(
        F.expr(f"percentile_approx(value, array({grid}), {10 * BINS})").alias("cuts"),
        F.sum("copies").alias("n"),
    )
    wanted = F.array(
        *[
            F.struct(F.lit(name).alias("name"), rank.cast("bigint").alias("rank"))
            for name, rank in ranks.items()
        ]
    )
    cuts = cuts.withColumn("wanted", wanted)
    binned = counts.join(F.broadcast(cuts.select("metric", "cuts")), "metric").select(
        "metric", _bin(F.col("cuts"), F.col("value")).alias("bin"), "value", "copies"
    )
    before = Window.partitionBy("metric").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        binned.groupBy("metric", "bin")
        .agg(F.sum("copies").alias("in_bin"))
        .withColumn("base", F.coalesce(F.sum("in_bin").over(before), F.lit(0)))
    )
    targets = (
        totals.join(F.broadcast(cuts.select("metric", F.explode("wanted").alias("w"))), "metric")
        .where((F.col("w.rank") > F.col("base")) & (F.col("w.rank") <= F.col("base") + F.col("in_bin")))
        .select("metric", "bin", "w.name", (F.col("w.rank") - F.col("base")).alias("rank_in_bin"))
    )
    wanted_bins = targets.groupBy("metric", "bin").agg(
        F.collect_list(F.struct("name", "rank_in_bin")).alias("targets")
    )
    running = (
        Window.partitionBy("metric", "bin")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    hits = (
        binned.join(F.broadcast(wanted_bins), ["metric", "bin"])
        .withColumn("upto", F.sum("copies").over(running))
        .select("metric", "value", "copies", "upto", F.explode("targets").alias("t"))
        .where(
            (F.col("t.rank_in_bin") <= F.col("upto"))
            & (F.col("t.rank_in_bin") > F.col("upto") - F.col("copies"))
        )
    )
    picks = [
        F.max(F.when(F.col("t.name") == name, F.col("value"))).alias(name) for name in ranks
    ]
    return hits.groupBy("metric").agg(*picks)


def nearest_rank(p: float) -> Column:
    """Rank of the nearest-rank quantile: ceil(p * n), at least 1."""
    return F.greatest(F.ceil(F.lit(float(p)) * F.col("n")), F.lit(1))


def nearest_rank_quantiles() -> dict[str, Column]:
    return {f"p{int(p * 100)}": nearest_rank(p) for p in (0.25, 0.50, 0.75, 0.90)}


def median_ranks() -> dict[str, Column]:
    """The two middle ranks whose mean is the interpolated median."""
    return {
        "low_middle": F.floor((F.col("n") + 1) / 2),
        "high_middle": F.floor(F.col("n") / 2) + 1,
    }

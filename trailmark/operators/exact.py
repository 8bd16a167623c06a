"""Sums of doubles without rounding on the way, whatever their sizes.

A finite double is a whole number times a power of two. Whole numbers of one power are summed as decimals, in
any order and with partial sums before the shuffle; a group has at most some 2,100 powers, and those few sums are
put together as whole numbers of any length and rounded once, to the nearest double.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from fractions import Fraction

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ship the helper with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_HALF = 28  # bits


def _power(value: Column) -> Column:
    """A power of two that the double is a whole multiple of; the multiple has 55 bits at most."""
    return F.when(value == 0, F.lit(0)).otherwise(F.floor(F.log2(F.abs(value))).cast("int") - 53)


def _multiple(value: Column, power: Column) -> Column:
    """``value`` divided by 2 ** power, a whole number, in two steps that neither overflow nor round."""
    half = F.floor(power / 2).cast("int")
    two = F.lit(2.0)
    return value * F.pow(two, -half) * F.pow(two, half - power)


def rounded_sum(parts: list) -> float:
    """The double nearest to the sum of multiple * 2 ** power."""
    if not parts:
        return 0.0
    least = min(p["power"] for p in parts)
    total = sum(int(p["multiple"]) << (p["power"] - least) for p in parts)
    try:
        return float(Fraction(total) * Fraction(2) ** least)
    except OverflowError:
        return float("inf") if total > 0 else float("-inf")


def _rounded(parts: pd.Series) -> pd.Series:
    return pd.Series([None if p is None else rounded_sum(list(p)) for p in parts], dtype="Float64")


def exact_totals(df: DataFrame, keys: Sequence[str], value: str, copies: str) -> DataFrame:
    """``keys`` and ``total``, the sum of ``value`` times ``copies``; NULL values are left out.

    NaN and infinite values give what their plain sum gives. A group without values has no row.
    """
    v = F.col(value)
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    known = df.where(v.isNotNull()).select(*keys, v.alias("_v"), F.col(copies).cast("decimal(12,0)").alias("_n"), finite.alias("_finite"))
    power = F.when(F.col("_finite"), _power(F.col("_v")))
    split = known.withColumn("_power", power).withColumn("_multiple", F.when(F.col("_finite"), _multiple(F.col("_v"), F.col("_power")).cast("decimal(17,0)")))
    sums = split.groupBy(*keys, "_power").agg(
        F.sum(F.col("_multiple") * F.col("_n")).alias("multiple"), F.sum(F.when(~F.col("_finite"), F.col("_v"))).alias("_odd")
    )
    part = F.when(F.col("_power").isNotNull(), F.struct(F.col("_power").alias("power"), "multiple"))
    gathered = sums.groupBy(*keys).agg(F.collect_list(part).alias("_parts"), F.sum("_odd").alias("_odd"))  # 2,100 parts at most
    total = F.coalesce("_odd", F.pandas_udf(_rounded, "double")("_parts"))
    return gathered.select(*keys, total.alias("total"))


def totals_with(df: DataFrame, value: str, totals: dict[str, Column], sums: Sequence[Column], maxima: Sequence[Column] = ()) -> DataFrame:
    """One row: the exact sum of ``value`` over the rows of each condition in ``totals``, beside other aggregates.

    ``sums`` are named counts and sums, 0 without rows; ``maxima`` are named maxima. All come from one scan: it is reduced
    per power of two of the value first, to at most some 2,100 rows. A total without values is NULL; NaN and
    infinite values give what their plain sum gives.
    """
    v = F.col(value).cast("double")
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    powers = df.withColumn("_power", F.when(v.isNotNull() & finite, _power(v)))
    split = powers.withColumn("_multiple", _multiple(v, F.col("_power")).cast("bigint"))
    # Halves of the 55 bits, so that the sums of 2 ** 35 rows fit plain integers.
    high, low = F.shiftright("_multiple", _HALF), F.col("_multiple").bitwiseAND(F.lit((1 << _HALF) - 1))
    halves = [
        F.sum(F.when(c, half)).alias(f"_{i}_{name}") for i, c in enumerate(totals.values()) for name, half in (("high", high), ("low", low))
    ]
    odd = [F.sum(F.when(c & F.col("_power").isNull(), v)).alias(f"_{i}_odd") for i, c in enumerate(totals.values())]
    reduced = split.groupBy("_power").agg(*sums, *maxima, *halves, *odd)
    first = reduced.columns[1:]
    whole = lambda i: F.col(f"_{i}_high").cast("decimal(20,0)") * F.lit(1 << _HALF).cast("decimal(10,0)") + F.col(f"_{i}_low")
    summed, greatest = first[: len(sums)], first[len(sums) : len(sums) + len(maxima)]
    part = lambda i: F.when(F.col("_power").isNotNull() & F.col(f"_{i}_high").isNotNull(), F.struct(F.col("_power").alias("power"), whole(i).alias("multiple")))
    merged = reduced.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in summed], *[F.max(c).alias(c) for c in greatest],
        *[F.collect_list(part(i)).alias(f"_{i}_parts") for i in range(len(totals))], *[F.sum(f"_{i}_odd").alias(f"_{i}_odd") for i in range(len(totals))],
    )
    rounded = F.pandas_udf(_rounded, "double")
    total = lambda i: F.coalesce(f"_{i}_odd", F.when(F.size(f"_{i}_parts") > 0, rounded(f"_{i}_parts")))
    return merged.select(*summed, *greatest, *[total(i).alias(name) for i, name in enumerate(totals)])

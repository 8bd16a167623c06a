"""Equi-joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key with at least 1/256 of the rows is hot, so there can be at most 256 of them.
HOT_SHARE = 256
_TRACKED = 8192


def hot_keys(df: DataFrame, key: str) -> Column:
    """Hot values of ``key`` as a lazy scalar subquery (at most ``HOT_SHARE`` values).

    The sketch merges map-side; a key it might miss only costs balance, not rows.
    """
    counted = df.agg(
        F.expr(f"approx_top_k(`{key}`, {HOT_SHARE}, {_TRACKED})").alias("top"),
        F.count("*").alias("total"),
    )
    keys = F.expr(f"transform(filter(top, t -> t.count * {HOT_SHARE} >= total), t -> t.item)")
    return counted.select(keys.alias("keys")).scalar()


def salted_left_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, spread_by: list[str]
) -> DataFrame:
    """``left LEFT JOIN right`` where ``right`` is unique on ``right_key``.

    Rows of hot keys (and NULL keys, which match nothing) get a salt hashed from the
    few ``spread_by`` columns, and the matching right rows - at most ``HOT_SHARE`` of
    them - are repeated once per salt value. All other rows keep salt 0, so nothing
    else is replicated. The salt is a function of the row, so a recomputed task sends
    each row to the same place. The second join key also gives both sides a plain
    exchange, which lets AQE split a partition of copies that no hash can separate.
    Right rows are unique and evenly spread, so each task hashes its share of them
    instead of sorting both sides.
    """
    spark = left.sparkSession
    salts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    hot = hot_keys(left, left_key)
    spread = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    is_hot = lambda key: F.coalesce(F.array_contains(hot, F.col(key)), F.lit(False))
    salted = left.withColumn(
        "_salt", F.when(F.col(left_key).isNull() | is_hot(left_key), spread).otherwise(0)
    )
    copies = F.when(is_hot(right_key), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(
        F.array(F.lit(0))
    )
    repeated = right.withColumn("_right_salt", F.explode(copies))
    condition = (F.col(left_key) == F.col(right_key)) & (F.col("_salt") == F.col("_right_salt"))
    return salted.join(repeated.hint("shuffle_hash"), condition, "left").drop("_salt", "_right_salt")

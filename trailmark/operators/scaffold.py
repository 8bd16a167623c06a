"""Fixed report keys as rows, so that keys without data still appear."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_rows(spark: SparkSession, name: str, values: Sequence, kind: str) -> DataFrame:
    items = F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
    return spark.range(1).select(F.explode(items).alias(name))


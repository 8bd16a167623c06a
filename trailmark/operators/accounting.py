"""Planned against recorded checkpoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.receipts import count_where
from trailmark.operators.planning import checkpoint_plan
from trailmark.operators.transitions import declared_position_filter
from trailmark.params import declared_positions

TOTAL_METRICS = (
    "expected", "recorded", "recorded_unique_expected", "missing",
    "unexpected", "duplicate_logical", "malformed_identity",
)


def _identified(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.where(
        F.col("parent_rollout_id").isNotNull() & F.col("checkpoint_token").isNotNull()
    )


def checkpoint_accounting(
    checkpoints: DataFrame, planned: DataFrame, positions: Sequence[int]
) -> DataFrame:
    """Rows (scope, metric, n); scope is ``all`` or a declared position.

    One scan counts receipts per key and status, so a hot (or NULL) parent shrinks to a
    few rows before anything is shuffled to the plan. The plan is never multiplied out
    by position: expected = planned ids x positions. Planned ids are distinct, so a
    partition of them is small enough to hash, and nothing is sorted.
    """
    positions = declared_positions(positions)
    counted = checkpoints.groupBy(
        "parent_rollout_id",
        F.col("checkpoint_token").cast("bigint").alias("position"),
        F.coalesce("status", F.lit("UNKNOWN")).alias("status"),
        F.coalesce("availability_status", F.lit("UNKNOWN")).alias("availability"),
    ).agg(F.count("*").alias("n"))
    planned_ids = planned.select(F.col("rollout_id").alias("planned_id")).distinct()
    at_parent = F.col("parent_rollout_id") == F.col("planned_id")
    marked = counted.join(planned_ids.hint("shuffle_hash"), at_parent, "left")
    malformed = F.col("parent_rollout_id").isNull() | F.col("position").isNull()
    expected = F.col("planned_id").isNotNull() & F.col("position").isin(*positions)
    scope = F.when(malformed, "malformed").when(expected, F.col("position").cast("string")).otherwise("unexpected")
    scoped = marked.select(scope.alias("scope"), "parent_rollout_id", "position", "status", "availability", "n")
    slots = scoped.groupBy("scope", "status", "availability").agg(F.sum("n").alias("rows"))
    # The join already clusters by parent, so the distinct keys need no shuffle. The always-true
    # filter keeps the statuses in this branch too, so that both branches read the same exchanges.
    size_of_key = F.sum(F.col("n") + F.octet_length("status") + F.octet_length("availability")).alias("size")
    distinct_keys = scoped.groupBy("parent_rollout_id", "position", "scope").agg(size_of_key)
    key_counts = distinct_keys.where("size > 0").groupBy("scope").agg(F.count("*").alias("keys"))
    rows, keys, here = F.col("rows"), F.col("keys"), F.col("scope")
    entry = lambda where, metric, n: F.struct(
        (F.lit(where) if isinstance(where, str) else where).alias("scope"),
        (F.lit(metric) if isinstance(metric, str) else metric).alias("metric"),
        n.cast("bigint").alias("n"),
    )
    in_plan = [
        entry(here, F.concat(F.lit("receipt_status:"), "status"), rows),
        entry(here, F.concat(F.lit("availability_status:"), "availability"), rows),
        entry(here, "recorded_receipts", rows),
    ]
    identified = [entry("all", "duplicate_logical", rows)]
    recorded = [entry("all", "recorded", rows)]
    row_entries = (
        F.when(here == "malformed", F.array(*recorded, entry("all", "malformed_identity", rows)))
        .when(here == "unexpected", F.array(*recorded, *identified, entry("all", "unexpected", rows)))
        .otherwise(F.array(*recorded, *identified, *in_plan))
    )
    repeated = [entry("all", "duplicate_logical", -keys)]
    key_entries = F.when(here == "unexpected", F.array(*repeated)).otherwise(
        F.array(
            *repeated,
            entry(here, "recorded_unique_expected_receipts", keys),
            entry(here, "missing_expected_receipts", -keys),
            entry("all", "recorded_unique_expected", keys),
            entry("all", "missing", -keys),
        )
    )
    size = F.col("planned")
    zero = F.lit(0)
    constants = [entry("all", "expected", size * len(positions)), entry("all", "missing", size * len(positions))]
    constants += [entry("all", metric, zero) for metric in TOTAL_METRICS]
    for position in positions:
        constants += [
            entry(str(position), "expected_receipts", size),
            entry(str(position), "missing_expected_receipts", size),
            entry(str(position), "recorded_unique_expected_receipts", zero),
        ]
    declared = planned_ids.agg(F.count("*").alias("planned")).select(F.inline(F.array(*constants)))
    return (
        slots.select(F.inline(row_entries))
        .unionByName(key_counts.where(here != "malformed").select(F.inline(key_entries)))
        .unionByName(declared)
        .groupBy("scope", "metric")
        .agg(F.sum("n").cast("bigint").alias("n"))
    )


def availability_by_position(checkpoints: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Rows (checkpoint_token, metric, n), undeclared positions included.

    A declared position without a receipt has one row with a NULL metric and n = 0.
    """
    seen = checkpoints.where(F.col("checkpoint_token").isNotNull())
    counted = seen.groupBy(
        F.col("checkpoint_token").cast("bigint").alias("checkpoint_token"),
        F.coalesce("availability_status", F.lit("UNKNOWN")).alias("availability"),
        F.concat(F.lit("receipt_"), F.coalesce("status", F.lit("UNKNOWN"))).alias("receipt"),
    ).agg(F.count("*").alias("n"))
    metrics = (
        counted.select("checkpoint_token", F.explode(F.array("availability", "receipt")).alias("metric"), "n")
        .groupBy("checkpoint_token", "metric")
        .agg(F.sum("n").cast("bigint").alias("n"))
    )
    tokens = F.array(*[F.lit(p) for p in declared_positions(positions)]).cast("array<bigint>")
    declared = checkpoints.sparkSession.range(1).select(
        F.explode(tokens).alias("checkpoint_token"), F.lit(None).cast("string").alias("metric"), F.lit(0).cast("bigint").alias("n")
    )
    receipts = F.sum("n").over(Window.partitionBy("checkpoint_token"))
    every = metrics.unionByName(declared).withColumn("_receipts", receipts)
    return every.where(F.col("metric").isNotNull() | (F.col("_receipts") == 0)).drop("_receipts")


def report_position_keys(report: DataFrame, position: str = "checkpoint_token") -> DataFrame:
    """Positions as strings, ordered numerically (at the edge of a report only)."""
    return report.withColumn("position_key", F.col(position).cast("string")).orderBy(F.col(position).cast("int"))


def plan_reconciliation(
    checkpoints: DataFrame, planned: DataFrame, positions: Sequence[int]
) -> DataFrame:
    """Every planned or recorded (rollout, position) key with its state and counts."""
    observed = (
        _identified(checkpoints)
        .groupBy("parent_rollout_id", F.col("checkpoint_token").cast("bigint").alias("checkpoint_token"))
        .agg(F.count("*").alias("receipts"))
    )
    plan = checkpoint_plan(planned, positions).select(
        F.col("rollout_id").alias("parent_rollout_id"),
        "checkpoint_token",
        F.lit(True).alias("is_planned"),
    )
    both = plan.join(observed, ["parent_rollout_id", "checkpoint_token"], "full")
    state = (
        F.when(F.col("is_planned").isNull(), "UNEXPECTED")
        .when(F.col("receipts").isNull(), "MISSING")
        .otherwise("RECORDED")
    )
    return both.select(
        "parent_rollout_id", "checkpoint_token",
        state.alias("state"),
        F.coalesce("receipts", F.lit(0)).cast("bigint").alias("receipts"),
        F.greatest(F.coalesce("receipts", F.lit(0)) - 1, F.lit(0)).cast("bigint").alias("duplicates"),
    )


def missing_receipts(
    checkpoints: DataFrame, planned: DataFrame, positions: Sequence[int]
) -> DataFrame:
    """Planned keys without any receipt."""
    recorded = (
        _identified(checkpoints.where(declared_position_filter(positions)))
        .select("parent_rollout_id", F.col("checkpoint_token").cast("bigint").alias("checkpoint_token"))
        .distinct()
    )
    plan = checkpoint_plan(planned, positions).withColumnRenamed("rollout_id", "parent_rollout_id")
    return plan.join(recorded, ["parent_rollout_id", "checkpoint_token"], "left_anti").select(
        "parent_rollout_id", "checkpoint_token"
    )


def observed_expected_sets(
    checkpoints: DataFrame, planned: DataFrame, positions: Sequence[int]
) -> DataFrame:
    """Sizes of the set intersection and differences of recorded and planned keys."""
    states = plan_reconciliation(checkpoints, planned, positions)
    return states.agg(
        count_where(F.col("state") == "RECORDED").alias("observed_and_expected"),
        count_where(F.col("state") == "MISSING").alias("expected_only"),
        count_where(F.col("state") == "UNEXPECTED").alias("observed_only"),
    )

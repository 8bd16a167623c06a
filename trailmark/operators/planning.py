"""What should exist: rollouts per problem and seed, checkpoints per rollout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.identity import checkpoint_id, intent_id, rollout_id
from trailmark.params import declared_positions
from trailmark.vocab import STARTED_EVENT


def plan_validation(planned: DataFrame, id_column: str = "rollout_id") -> DataFrame:
    """Violations of a plan's id column: NULL/empty ids and repeated ids."""
    counted = planned.groupBy(F.coalesce(id_column, F.lit("")).alias("id")).agg(F.count("*").alias("rows"))
    violation = F.when(F.col("id") == "", "EMPTY_ID").when(F.col("rows") > 1, "DUPLICATE_ID")
    return counted.withColumn("violation", violation).where(F.col("violation").isNotNull())


def rollout_plan(problems: DataFrame, seeds: Sequence[int], manifest_hash: str | Column) -> DataFrame:
    """One row per problem and seed; the short seed list is exploded row-locally."""
    digest = F.lit(manifest_hash) if isinstance(manifest_hash, str) else manifest_hash
    seed_list = F.array(*[F.lit(int(s)) for s in seeds]).cast("array<bigint>")
    rows = problems.select("problem_id", F.explode(seed_list).alias("rollout_seed"))
    return rows.withColumn("rollout_id", rollout_id(digest, F.col("problem_id"), F.col("rollout_seed")))


def checkpoint_plan(rollouts: DataFrame, positions: Sequence[int]) -> DataFrame:
    """One row per rollout and declared position."""
    declared = F.array(*[F.lit(p) for p in declared_positions(positions)]).cast("array<bigint>")
    rows = rollouts.select("rollout_id", F.explode(declared).alias("checkpoint_token"))
    return rows.withColumn(
        "checkpoint_id", checkpoint_id(F.col("rollout_id"), F.col("checkpoint_token"))
    )


def pending_requests(planned: DataFrame, ledger: DataFrame, id_column: str = "rollout_id") -> DataFrame:
    """Planned units whose intent was never started: the only ones a later stage may run."""
    started = (
        ledger.where(F.col("event_type") == STARTED_EVENT)
        .select(F.col("intent_id").alias("started_intent"))
        .distinct()
    )
    return planned.join(
        started, intent_id(F.col(id_column)) == F.col("started_intent"), "left_anti"
    )


def unavailable_children(rollouts: DataFrame, positions: Sequence[int], keep: Sequence[str] = ()) -> DataFrame:
    """One UNAVAILABLE row per declared position of every parent that did not complete, with its columns ``keep``."""
    stopped = rollouts.where(~F.col("status").eqNullSafe("COMPLETED"))
    parent_status = F.when(F.col("status").eqNullSafe("FAILED"), "PARENT_BASE_FAILED").otherwise(
        "PARENT_BASE_INTERRUPTED_UNKNOWN"
    )
    declared = F.array(*[F.lit(p) for p in declared_positions(positions)]).cast("array<bigint>")
    rows = stopped.select(
        "rollout_id", "problem_id", "rollout_seed", *keep,
        F.explode(declared).alias("checkpoint_token"),
        F.lit("UNAVAILABLE").alias("status"),
        parent_status.alias("availability_status"),
    )
    return rows.select(
        checkpoint_id(F.col("rollout_id"), F.col("checkpoint_token")).alias("checkpoint_id"),
        F.col("rollout_id").alias("parent_rollout_id"),
        "problem_id", "rollout_seed", "checkpoint_token", "status", "availability_status",
        F.lit("no saved base trajectory is available for this child request").alias("reason"), *keep,
    )

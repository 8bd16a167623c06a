"""Run-level summaries, published ratios, the extension gate and input digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.receipts import count_where, is_completed, ratio
from trailmark.operators.exact import totals_with
from trailmark.operators.stages import runtime_mean_median
from trailmark.vocab import TRANSITION_LABELS


def _stack(parts: list[DataFrame]) -> DataFrame:
    """One-row tables as one wide row, by union and max instead of cross joins."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def operational_summary(
    rollouts: DataFrame, checkpoints: DataFrame, planned_problems: int | None = None,
    planned_rollouts: int | None = None, planned: DataFrame | None = None,
) -> DataFrame:
    """One row: attempts, completions, tokens, transitions, faults, runtime, peak memory.

    Token totals cover receipts of every status, as recorded. What was planned is given as two numbers, or as
    the plan itself (problem_id, rollout_id), whose distinct ids are counted.
    """
    done = is_completed()
    tokens = lambda: F.coalesce(F.sum("generated_token_count"), F.lit(0)).cast("bigint")
    base = rollouts.agg(
        F.count("*").alias("trajectories_recorded"),
        tokens().alias("base_generated_tokens"),
        count_where(F.col("final_status") == "NON_EVALUABLE").alias("base_non_evaluable"),
        count_where(F.col("final_status") == "ERROR").alias("base_errors"),
        count_where(F.col("status") == "FAILED").alias("base_failures"),
        count_where(F.col("status") == "INTERRUPTED_UNKNOWN").alias("base_interrupted"),
        F.max("peak_allocated_bytes").alias("base_peak_allocated"),
        F.max("peak_reserved_bytes").alias("base_peak_reserved"),
    )
    forced = checkpoints.agg(
        F.count("*").alias("checkpoints_recorded"),
        tokens().alias("forced_generated_tokens"),
        count_where(F.col("forced_status") == "NON_EVALUABLE").alias("forced_non_evaluable"),
        count_where(F.col("forced_status") == "ERROR").alias("forced_errors"),
        count_where(F.col("status") == "FAILED").alias("forced_failures"),
        count_where(F.col("status") == "INTERRUPTED_UNKNOWN").alias("forced_interrupted"),
        F.max("peak_allocated_bytes").alias("forced_peak_allocated"),
        F.max("peak_reserved_bytes").alias("forced_peak_reserved"),
        *[count_where(F.col("transition_label") == n).alias(n.lower()) for n in TRANSITION_LABELS],
    )
    # Distinct counts as two-level aggregates: no row expansion per distinct column.
    problems = rollouts.groupBy("problem_id").agg(F.max(done.cast("int")).alias("done")).agg(
        F.count("*").alias("problems_attempted"),
        count_where(F.col("done") == 1).alias("problems_completed"),
    )
    distinct = rollouts.where(done).groupBy("rollout_id").agg(F.lit(1).alias("one")).agg(
        F.count("*").alias("trajectories_completed")
    )
    scope = [] if planned is None else [
        distinct_count(planned, "problem_id").withColumnRenamed("n", "problems_planned"),
        distinct_count(planned, "rollout_id").withColumnRenamed("n", "trajectories_planned"),
    ]
    row = _stack([base, forced, problems, distinct, runtime_mean_median(rollouts), *scope])
    if planned is None:
        row = row.withColumns({
            "problems_planned": F.lit(planned_problems).cast("bigint"),
            "trajectories_planned": F.lit(planned_rollouts).cast("bigint"),
        })
    add = lambda name: F.col(f"base_{name}") + F.col(f"forced_{name}")
    return row.select(
        "problems_attempted", "problems_completed",
        "problems_planned", "trajectories_planned",
        "trajectories_recorded", "trajectories_completed", "checkpoints_recorded",
        "base_generated_tokens", "forced_generated_tokens",
        add("generated_tokens").alias("total_generated_tokens"),
        *[n.lower() for n in TRANSITION_LABELS],
        add("non_evaluable").alias("non_evaluable"),
        add("errors").alias("evaluation_errors"),
        add("failures").alias("failures"),
        add("interrupted").alias("interrupted_unknown"),
        "mean_seconds", "median_seconds",
        F.greatest("base_peak_allocated", "forced_peak_allocated").alias("peak_allocated_bytes"),
        F.greatest("base_peak_reserved", "forced_peak_reserved").alias("peak_reserved_bytes"),
    )


def distinct_count(rows: DataFrame, name: str) -> DataFrame:
    """One row, ``n``: the distinct values of a column that are not NULL, counted in two levels."""
    return rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.lit(1)).agg(F.count("*").alias("n"))


def campaign_rates(rollouts: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Published ratios: conditional accuracy, non-evaluable shares, throughput."""
    paired = F.col("generated_token_count").isNotNull() & F.col("elapsed_seconds").isNotNull()
    paired = paired & is_completed()
    tokens = F.sum(F.when(paired, F.col("generated_token_count")))
    right = (F.col("final_status") == "CORRECT") & F.col("final_correct")
    wrong = (F.col("final_status") == "INCORRECT") & ~F.col("final_correct")
    base = totals_with(rollouts, "elapsed_seconds", {"base_seconds": paired}, [
        count_where(is_completed()).alias("completed"),
        count_where(right).alias("correct"),
        count_where(right | wrong).alias("evaluable"),
        count_where(is_completed() & (F.col("final_status") == "NON_EVALUABLE")).alias("base_non_evaluable"),
        tokens.alias("base_tokens"),
    ])
    available = F.col("availability_status") == "AVAILABLE"
    forced = totals_with(checkpoints, "elapsed_seconds", {"forced_seconds": paired}, [
        count_where(available).alias("available"),
        count_where(available & (F.col("forced_status") == "NON_EVALUABLE")).alias("forced_non_evaluable"),
        tokens.alias("forced_tokens"),
    ])
    row = _stack([base, forced])
    nothing = F.lit(0)
    total = lambda name: F.coalesce(F.col(f"base_{name}"), nothing) + F.coalesce(F.col(f"forced_{name}"), nothing)
    return row.select(
        ratio(F.col("correct"), F.col("evaluable")).alias("conditional_accuracy"),
        ratio(F.col("base_non_evaluable"), F.col("completed")).alias("base_non_evaluable_rate"),
        ratio(F.col("forced_non_evaluable"), F.col("available")).alias("forced_non_evaluable_rate"),
        ratio(F.col("base_tokens"), F.col("base_seconds")).alias("base_tokens_per_second"),
        ratio(F.col("forced_tokens"), F.col("forced_seconds")).alias("forced_tokens_per_second"),
        ratio(total("tokens"), total("seconds")).alias("combined_tokens_per_second"),
    )


def stage_gate(
    rollouts: DataFrame,
    checkpoints: DataFrame,
    device_memory_bytes: int,
    remaining_rollouts: int,
    setup_failures: int = 0,
    max_failure_share: float = 0.05,
    min_headroom_bytes: int = 512 * 1024 * 1024,
    max_hours: float = 12.0,
) -> DataFrame:
    """The four extension criteria of a finished first stage, as one row of booleans."""
    faults = lambda: count_where(F.coalesce(F.col("cuda_oom"), F.lit(False)) | (F.col("status") == "INTERRUPTED_UNKNOWN"))
    base = totals_with(rollouts, "elapsed_seconds", {"base_seconds": is_completed()}, [
        F.count("*").alias("attempted"),
        faults().alias("base_faults"),
        count_where(F.col("status") == "FAILED").alias("base_failures"),
    ], [F.max("peak_reserved_bytes").alias("base_peak")])
    available = F.col("availability_status") == "AVAILABLE"
    forced = totals_with(checkpoints, "elapsed_seconds", {"forced_seconds": is_completed()}, [
        count_where(available).alias("available"),
        faults().alias("forced_faults"),
        count_where(available & (F.col("status") == "FAILED")).alias("forced_failures"),
    ], [F.max("peak_reserved_bytes").alias("forced_peak")])
    row = _stack([base, forced])
    spent = F.coalesce("base_seconds", F.lit(0.0)) + F.coalesce("forced_seconds", F.lit(0.0))
    share = F.coalesce(ratio(F.col("forced_failures"), F.col("available")), F.lit(0.0))
    measured = row.select(
        "base_failures",
        (F.col("base_faults") + F.col("forced_faults") + setup_failures).alias("faults"),
        share.alias("forced_failure_share"),
        (F.lit(device_memory_bytes) - F.greatest("base_peak", "forced_peak")).cast("bigint").alias("headroom_bytes"),
        (ratio(spent, F.col("attempted")) * remaining_rollouts / 3600).alias("projected_hours"),
    )
    sure = lambda condition: F.coalesce(condition, F.lit(False))
    gate = measured.withColumns(
        {
            "no_faults": F.col("faults") == 0,
            "failures_within_limit": (F.col("base_failures") == 0) & (F.col("forced_failure_share") <= max_failure_share),
            "memory_headroom": sure(F.col("headroom_bytes") >= min_headroom_bytes),
            "time_within_limit": sure(F.col("projected_hours") <= max_hours),
        }
    )
    passes = F.col("no_faults") & F.col("failures_within_limit") & F.col("memory_headroom") & F.col("time_within_limit")
    return gate.withColumn("extend", passes)


def batch_digest(records: DataFrame, name: str, content_hash: str) -> DataFrame:
    """One digest over all (name, content hash) pairs, independent of row order.

    A hash tree: equal pairs collapse to one leaf with a count, leaves fall into
    65,536 buckets by their own hash (a hot name cannot fill a bucket), buckets into
    256 nodes, nodes into the root.
    """
    pair = F.concat_ws("|", F.col(name), F.col(content_hash), F.col("copies").cast("string"))
    leaves = records.groupBy(name, content_hash).agg(F.count("*").alias("copies")).select(
        F.sha2(pair, 256).alias("node")
    )
    buckets = _fold(leaves.withColumn("at", F.substring("node", 1, 4)))
    nodes = _fold(buckets.withColumn("at", F.substring("at", 1, 2)))
    root = _fold(nodes.withColumn("at", F.lit("root"))).select(F.col("node").alias("digest"))
    return _stack([root, records.agg(F.count("*").alias("record_count"))])


def _fold(nodes: DataFrame) -> DataFrame:
    """One hash per ``at``: SHA-256 of its sorted child hashes."""
    children = F.array_join(F.array_sort(F.collect_list("node")), "")
    folded = nodes.groupBy("at").agg(children.alias("children"))
    return folded.select("at", F.sha2(F.concat(F.col("at"), F.lit(":"), F.col("children")), 256).alias("node"))

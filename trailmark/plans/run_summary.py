"""The operational summary of one run, bound to the receipts it was computed from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators import accounting, stages, summary
from trailmark.params import RunContext
from trailmark.sinks.writers import content_hash


def receipts_digest(receipts: DataFrame, key: str) -> DataFrame:
    """One row (digest, record_count) over every column of every receipt, whatever their order."""
    hashed = receipts.select(F.col(key), content_hash(receipts.columns).alias("content_hash"))
    return summary.batch_digest(hashed, key, "content_hash")


def run_identity_row(run: RunContext, like: DataFrame) -> DataFrame:
    """One row: what names the run."""
    names = ("run_id", "manifest_hash", "config_hash", "source_git_commit")
    return like.sparkSession.range(1).select(*[F.lit(getattr(run, n)).cast("string").alias(n) for n in names])


def run_summary_sections(
    rollouts: DataFrame,
    checkpoints: DataFrame,
    planned: DataFrame,
    positions: Sequence[int],
    run: RunContext,
    disk_usage: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The sections of a run summary, for :func:`trailmark.plans.analysis.report_rows`.

    ``planned`` has problem_id and rollout_id; receipts outside of it are counted all the same. The digests
    of both receipt tables cover all their columns, so a summary whose digests differ was made from other
    receipts. ``disk_usage`` is the one-row result of :func:`trailmark.sources.inputs.artifact_disk_usage`.
    """
    sections = {
        "run": run_identity_row(run, rollouts),
        "trajectory_inputs": receipts_digest(rollouts, "rollout_id"),
        "checkpoint_inputs": receipts_digest(checkpoints, "parent_rollout_id"),
        "totals": summary.operational_summary(rollouts, checkpoints, planned=planned),
        "trajectory_status_counts": stages.receipt_status_counts(rollouts),
        "checkpoint_receipt_status_counts": stages.receipt_status_counts(checkpoints),
        "final_evaluation_status_counts": stages.evaluation_status_counts(rollouts, "final_status"),
        "checkpoint_evaluation_status_counts": stages.evaluation_status_counts(checkpoints, "forced_status"),
        "failure_counts_by_kind": stages.failure_counts_by_kind(stages.all_receipts_union(
            rollouts.select("status", "error_type"), checkpoints.select("status", "error_type"))),
        "checkpoint_counts_by_position": accounting.availability_by_position(checkpoints, positions),
    }
    return sections if disk_usage is None else sections | {"artifact_disk_usage": disk_usage.select("bytes")}

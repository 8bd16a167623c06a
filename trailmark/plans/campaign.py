"""Preparing a campaign and grading what comes back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.identity import checkpoint_id
from trailmark.functions.tokens import termination_status
from trailmark.operators import grading, planning, selection, trajectory
from trailmark.params import CampaignPlan


def prepare_manifest(problems: DataFrame, plan: CampaignPlan, size: int) -> DataFrame:
    """Validated problems -> hash-ranked manifest rows; a bad row fails the job."""
    valid = selection.validate_problems(problems, strict=True).where(F.col("violation").isNull())
    return selection.selection_manifest(valid.drop("violation"), plan.selection_seed, size)


def base_requests(
    manifest: DataFrame, ledger: DataFrame, plan: CampaignPlan, manifest_hash: str
) -> DataFrame:
    """Rollouts still to be generated."""
    planned = planning.rollout_plan(manifest, plan.seeds, manifest_hash)
    return planning.pending_requests(planned, ledger)


def forced_requests(
    trajectories: DataFrame,
    plan: CampaignPlan,
    marker: Sequence[int],
    cue: Sequence[int],
    eos_ids: Sequence[int],
    ledger: DataFrame | None = None,
) -> DataFrame:
    """Forced-answer inputs for every available checkpoint of completed trajectories.

    Rollouts whose ``status``, if there is one, is not COMPLETED are left out. With a ``ledger`` only
    checkpoints whose intent was never started remain, and ``checkpoint_id`` is added.
    """
    if "status" in trajectories.columns:
        trajectories = trajectories.where(F.col("status") == "COMPLETED")
    cut = trajectory.fixed_checkpoints(trajectories, plan.positions, marker, eos_ids)
    if ledger is not None:
        named = cut.withColumn("checkpoint_id", checkpoint_id(F.col("rollout_id"), F.col("checkpoint_token")))
        cut = planning.pending_requests(named, ledger, "checkpoint_id")
    return trajectory.forced_input(cut, cue)


def grade_forced(
    returned: DataFrame, plan: CampaignPlan, eos_ids: Sequence[int], max_new_tokens: int
) -> DataFrame:
    """Returned forced completions -> evaluation, labels and censoring decision.

    ``returned`` carries generated_text, generated_token_ids, reference_answer,
    availability_status, base_termination, close_marker_start and the final evaluation.
    """
    graded = grading.grade_completions(returned).withColumns(
        {
            "forced_termination": termination_status(F.col("generated_token_ids"), eos_ids, max_new_tokens),
            "forced_status": F.col("evaluation.status"),
            "forced_correct": F.col("evaluation.correct"),
        }
    )
    return grading.label_transitions(graded, plan.policy)

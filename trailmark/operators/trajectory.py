"""Fixed-token checkpoints and forced-answer inputs from saved token arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.functions.identity import token_hash
from trailmark.functions.tokens import (
    all_subsequence_starts,
    find_subsequence,
    first_position_in,
    thinking_boundary,
    token_array,
)
from trailmark.params import declared_positions


def thinking_boundaries(trajectories: DataFrame, marker: Sequence[int]) -> DataFrame:
    boundary = trajectories.withColumn("_boundary", thinking_boundary(F.col("token_ids"), marker))
    return boundary.select(*trajectories.columns, "_boundary.*")


def fixed_checkpoints(
    trajectories: DataFrame,
    positions: Sequence[int],
    marker: Sequence[int],
    eos_ids: Sequence[int] = (),
) -> DataFrame:
    """One row per trajectory and position: availability and, if available, the prefix.

    The marker and EOS searches run once per trajectory, before positions are exploded.
    A prefix ending exactly at the marker start excludes it and is still available.
    """
    ids = F.col("token_ids")
    searched = trajectories.withColumns(
        {
            "_length": F.coalesce(F.size(ids), F.lit(0)),  # a missing trajectory has no tokens
            "_close_start": find_subsequence(ids, marker),
            "_first_eos": first_position_in(ids, eos_ids),
        }
    )
    declared = F.array(*[F.lit(p) for p in declared_positions(positions)]).cast("array<int>")
    requested = searched.select("*", F.explode(declared).alias("checkpoint_token"))
    position = F.col("checkpoint_token")
    status = (
        F.when(position > F.col("_length"), "TRAJECTORY_TOO_SHORT")
        .when(F.col("_close_start") < position, "AFTER_THINK_CLOSE")
        .when(F.col("_first_eos") <= position, "AFTER_TERMINAL_TOKEN")
        .otherwise("AVAILABLE")
    )
    marked = requested.withColumn("availability_status", status)
    prefix = F.when(F.col("availability_status") == "AVAILABLE", F.slice("token_ids", F.lit(1), position))
    reason = (
        F.when(
            F.col("availability_status") == "TRAJECTORY_TOO_SHORT",
            F.format_string("saved trajectory has %d generated tokens", "_length"),
        )
        .when(
            F.col("availability_status") == "AFTER_THINK_CLOSE",
            "requested prefix reaches the original final-answer phase",
        )
        .when(
            F.col("availability_status") == "AFTER_TERMINAL_TOKEN",
            "requested prefix contains a terminal token",
        )
    )
    cut = marked.withColumn("prefix_token_ids", prefix)
    return cut.select(
        *[c for c in trajectories.columns if c != "token_ids"],
        "checkpoint_token", "availability_status", reason.alias("reason"), "prefix_token_ids",
        F.when(F.col("prefix_token_ids").isNotNull(), token_hash(F.col("prefix_token_ids"))).alias("prefix_sha256"),
    )


def forced_input(checkpoints: DataFrame, cue: Sequence[int], prompt: str = "prompt_token_ids") -> DataFrame:
    """Prompt, saved prefix and cue concatenated for every available checkpoint."""
    if not cue:
        raise ValueError("the forced-answer cue cannot be empty")
    cue_ids = token_array(cue)
    ready = checkpoints.where(F.col("availability_status") == "AVAILABLE").withColumn(
        "input_token_ids", F.concat(F.col(prompt), F.col("prefix_token_ids"), cue_ids)
    )
    return ready.withColumns(
        {
            "prompt_token_count": F.size(prompt),
            "saved_prefix_token_count": F.size("prefix_token_ids"),
            "input_token_count": F.size("input_token_ids"),
            "prompt_sha256": token_hash(F.col(prompt)),
            "cue_sha256": token_hash(cue_ids),
            "input_sha256": token_hash(F.col("input_token_ids")),
        }
    )


def cue_violations(cues: DataFrame, marker: Sequence[int], eos_ids: Sequence[int]) -> DataFrame:
    """Check candidate cues (column ``token_ids``): adds ``violation``, NULL when usable."""
    ids = F.col("token_ids")
    starts = all_subsequence_starts(ids, marker)
    violation = (
        F.when(~F.coalesce(F.get(starts, F.lit(0)) == 0, F.lit(False)), "MARKER_NOT_AT_START")
        .when(F.exists(starts, lambda s: s >= len(marker)), "SECOND_MARKER")
        .when(F.arrays_overlap(ids, token_array(eos_ids)), "CONTAINS_EOS")
    )
    return cues.withColumn("violation", violation)

"""The full aggregate report of a campaign."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators import accounting, stages, transitions
from trailmark.session import materialise


# The columns of the transition facts that sections use.
FACTS = (
    "problem_id", "checkpoint_token", "stage", "primary_label", "observed_label",
    "observed_outcome", "effective_eligibility", "exclusion_reasons",
)


def analysis_sections(
    rollouts: DataFrame,
    checkpoints: DataFrame,
    planned: DataFrame,
    positions: Sequence[int],
    write_facts: bool = True,
) -> dict[str, DataFrame]:
    """Every report section as its own small DataFrame.

    The parent join runs once: the columns of its result that sections use are written to
    the shared folder, and so are the counts per problem and position which all transition
    sections read. Planned ids do not filter the data; they are used for accounting only.
    """
    facts = transitions.transition_facts(checkpoints, rollouts, positions).select(*FACTS)
    if write_facts:
        facts = materialise(facts, "facts")
    groups = transitions.transition_groups(facts)
    if write_facts:
        groups = materialise(groups, "groups")
    sections = {
        "final_answer_accuracy": stages.final_accuracy(rollouts),
        "accuracy_status_counts": stages.accuracy_status_counts(rollouts),
        "base_trajectory_length": stages.length_distribution(rollouts),
        "checkpoint_accounting": accounting.checkpoint_accounting(checkpoints, planned, positions),
        "transition_funnel": transitions.transition_funnel(checkpoints, rollouts, positions, facts),
    }
    for stage, receipts, prefix in (("base", rollouts, "final"), ("forced", checkpoints, "forced")):
        status, correct = f"{prefix}_status", f"{prefix}_correct"
        sections |= {
            f"{stage}_overview": stages.stage_overview(receipts, status, correct),
            f"{stage}_counters": stages.stage_counters(receipts, status),
            f"{stage}_generation_distributions": stages.generation_distributions(receipts),
        }
    for view in ("primary", "observed"):
        seen = transitions.groups_of_view(groups, view)
        cube = transitions.cube_of_groups(seen)
        sections |= {
            f"{view}_rates": transitions.transition_rates_by_checkpoint(seen, positions),
            f"{view}_contrasts": transitions.matched_contrasts(seen, positions),
            f"{view}_concentration": transitions.event_concentration(cube, positions),
            f"{view}_concentration_positions": transitions.concentration_positions(cube),
        }
    return sections


# Columns of the sections that name a row rather than measure it.
KEY_COLUMNS = (
    "status", "evaluation_status", "error_type", "termination_status", "metric", "scope",
    "counter", "key", "label", "checkpoint_token",
)


def report_rows(sections: dict[str, DataFrame]) -> DataFrame:
    """All sections as (section, key, metric, value) rows.

    Only the listed key columns and measures are carried, so no prompt, completion,
    token id, answer or path can reach a report.
    """
    parts = []
    for section, df in sections.items():
        keys = [c for c in df.columns if c in KEY_COLUMNS]
        measures = [c for c in df.columns if c not in keys]
        key = F.concat_ws("/", *[F.col(c).cast("string") for c in keys]) if keys else F.lit("")
        pairs = F.array(
            *[F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("string").alias("value")) for m in measures]
        )
        parts.append(df.select(F.lit(section).alias("section"), key.alias("key"), F.inline(pairs)))
    report = parts[0]
    for part in parts[1:]:
        report = report.union(part)
    return report

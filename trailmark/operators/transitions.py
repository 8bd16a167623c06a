"""Wrong/correct transitions between a checkpoint and the end of its rollout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.labels import (
    agreed_code,
    agreement_status,
    code_of_label,
    derived_code,
    label_of_code,
    verdict,
)
from trailmark.functions.receipts import count_where, is_completed, ratio
from trailmark.operators.scaffold import literal_rows
from trailmark.operators.skew import salted_left_join
from trailmark.params import declared_positions
from trailmark.vocab import NOT_RECORDED, TRANSITION_LABELS, WRONG_START_LABELS

UNDECLARED = "UNDECLARED_OR_MALFORMED_CHECKPOINT_POSITION"
NOT_COMPLETED = "CHECKPOINT_RECEIPT_NOT_COMPLETED"
NO_PARENT = "MISSING_OR_AMBIGUOUS_PARENT_BASE_RECEIPT"
BAD_PROBLEM = "MALFORMED_PROBLEM_ID"
EXCLUDED = "CHECKPOINT_ANALYTICALLY_EXCLUDED"
PARENT_EXCLUDED = "PARENT_BASE_ANALYTICALLY_EXCLUDED"
VALID_PRIMARY = "VALID_PRIMARY_ANALYTIC_TRANSITION"
VALID_OBSERVED = "VALID_OBSERVED_TRANSITION"


def declared_position_filter(positions: Sequence[int]) -> Column:
    return F.coalesce(F.col("checkpoint_token").isin(*declared_positions(positions)), F.lit(False))


def unique_base_index(rollouts: DataFrame) -> DataFrame:
    """Rollout ids with exactly one receipt; ambiguous ids drop out.

    The aggregates are per column, so a report that needs only the verdict and the
    eligibility flag prunes the string columns and keeps a plain hash aggregate.
    """
    named = {
        "parent_verdict": verdict(F.col("final_status"), F.col("final_correct")),
        "parent_final_status": F.coalesce("final_status", F.lit(NOT_RECORDED)),
        "parent_eligible": F.col("eligible"),
        "parent_eligibility_status": F.col("eligibility_status"),
        "parent_reason_codes": F.col("reason_codes"),
    }
    return (
        rollouts.where(F.col("rollout_id") != "")
        .groupBy(F.col("rollout_id").alias("base_id"))
        .agg(
            F.count("*").alias("receipts"),
            *[F.any_value(column).alias(name) for name, column in named.items()],
        )
        .where(F.col("receipts") == 1)
        .drop("receipts")
    )


def checkpoint_parent_join(checkpoints: DataFrame, rollouts: DataFrame) -> DataFrame:
    """Each checkpoint with its unambiguous parent; ``parent_found`` tells the others apart."""
    base = unique_base_index(rollouts)
    spread_by = [c for c in ("checkpoint_id", "problem_id", "checkpoint_token") if c in checkpoints.columns]
    joined = salted_left_join(checkpoints, base, "parent_rollout_id", "base_id", spread_by)
    return joined.withColumn("parent_found", F.col("base_id").isNotNull()).drop("base_id")


def final_reference_fallback(joined: DataFrame) -> DataFrame:
    """Adds ``final_verdict``: the checkpoint's own final reference, else the parent's."""
    own = F.coalesce("final_ref_status", F.lit(NOT_RECORDED)) != NOT_RECORDED
    own_verdict = verdict(F.col("final_ref_status"), F.col("final_ref_correct"))
    return joined.withColumn(
        "final_verdict", F.when(own, own_verdict).otherwise(F.col("parent_verdict"))
    )


def transition_facts(
    checkpoints: DataFrame, rollouts: DataFrame, positions: Sequence[int]
) -> DataFrame:
    """One row per completed checkpoint at a declared position, with its funnel stage.

    Rows that stop earlier in the funnel never need their parent, so they are
    filtered at the scan instead of being shuffled through the join.
    """
    wanted = checkpoints.where(declared_position_filter(positions) & is_completed())
    joined = final_reference_fallback(checkpoint_parent_join(wanted, rollouts))
    forced = verdict(F.col("forced_status"), F.col("forced_correct"))
    coded = joined.withColumns(
        {
            "derived": derived_code(forced, F.col("final_verdict")),
            "p_recorded": code_of_label(F.col("transition_label")),
            "o_raw": F.coalesce("observed_transition_label", "transition_label"),
            "o_name": F.when(
                F.col("observed_transition_label").isNotNull(), "OBSERVED_TRANSITION_LABEL"
            ).otherwise("TRANSITION_LABEL"),
        }
    ).withColumn("o_recorded", code_of_label(F.col("o_raw")))
    derived, p_recorded, o_recorded = F.col("derived"), F.col("p_recorded"), F.col("o_recorded")
    labelled = coded.withColumns(
        {
            "p_code": agreed_code(p_recorded, derived),
            "p_status": agreement_status(F.lit("TRANSITION_LABEL"), F.col("transition_label"), p_recorded, derived),
            "o_code": agreed_code(o_recorded, derived),
            "o_status": agreement_status(F.col("o_name"), F.col("o_raw"), o_recorded, derived),
        }
    )
    has_problem = F.coalesce(F.col("problem_id") != "", F.lit(False))
    checked = F.col("parent_found") & has_problem
    stage = (
        F.when(~F.col("parent_found"), NO_PARENT)
        .when(~has_problem, BAD_PROBLEM)
        .when(~F.col("eligible"), EXCLUDED)
        .when(~F.col("parent_eligible"), PARENT_EXCLUDED)
        .when(F.col("p_code").isNull(), F.concat(F.lit("PRIMARY:"), "p_status"))
        .otherwise(VALID_PRIMARY)
    )
    observed_outcome = F.when(
        checked,
        F.when(F.col("o_code").isNull(), F.concat(F.lit("OBSERVED:"), "o_status"))
        .otherwise(VALID_OBSERVED),
    )
    effective = (
        F.when(~F.col("parent_found"), "MISSING_PARENT_BASE_EXCLUDED")
        .when(~has_problem, F.lit(None))
        .when(~F.col("eligible"), F.col("eligibility_status"))
        .when(~F.col("parent_eligible"), F.col("parent_eligibility_status"))
        .otherwise("EFFECTIVELY_ELIGIBLE")
    )
    reasons = F.when(
        checked,
        F.when(~F.col("eligible"), F.col("reason_codes")).when(
            ~F.col("parent_eligible"), F.col("parent_reason_codes")
        ),
    )
    in_primary = checked & F.col("eligible") & F.col("parent_eligible")
    return labelled.select(
        "parent_rollout_id", "problem_id", "checkpoint_token",
        stage.alias("stage"),
        label_of_code(F.when(in_primary, F.col("p_code"))).alias("primary_label"),
        F.when(in_primary, F.col("p_status")).alias("primary_label_status"),
        label_of_code(F.when(checked, F.col("o_code"))).alias("observed_label"),
        F.when(checked, F.col("o_status")).alias("observed_label_status"),
        observed_outcome.alias("observed_outcome"),
        effective.alias("effective_eligibility"),
        reasons.alias("exclusion_reasons"),
    )


def _transitions(facts: DataFrame, label: str) -> DataFrame:
    return facts.where(F.col(label).isNotNull()).select(
        F.col(label).alias("label"), "problem_id", "checkpoint_token"
    )


def primary_transitions(facts: DataFrame) -> DataFrame:
    """Transitions that pass the censoring policy."""
    return _transitions(facts, "primary_label")


def observed_transitions(facts: DataFrame) -> DataFrame:
    """Transitions before censoring."""
    return _transitions(facts, "observed_label")


def transition_cube(transitions: DataFrame) -> DataFrame:
    """Counts, one row per (label, problem, position); every report below accepts it as input."""
    return transitions.groupBy("label", "problem_id", "checkpoint_token").agg(
        F.count("*").alias("n")
    )


def transition_groups(facts: DataFrame) -> DataFrame:
    """Both views in one shuffle: a row per (problem, position) with a count per view and label."""
    labels = {"primary": F.col("primary_label"), "observed": F.col("observed_label")}
    labelled = facts.where(F.coalesce(*labels.values()).isNotNull())
    return labelled.groupBy("problem_id", "checkpoint_token").agg(
        *[count_where(label == name).alias(f"{view}_{name.lower()}") for view, label in labels.items() for name in TRANSITION_LABELS]
    )


def groups_of_view(groups: DataFrame, view: str) -> DataFrame:
    """The groups with transitions of one view; rates and contrasts accept them as input."""
    counts = [F.col(f"{view}_{name.lower()}").alias(name.lower()) for name in TRANSITION_LABELS]
    return groups.select("problem_id", "checkpoint_token", *counts).where(F.greatest(*[n.lower() for n in TRANSITION_LABELS]) > 0)


def cube_of_groups(groups: DataFrame) -> DataFrame:
    """The :func:`transition_cube` of one view's groups, without a shuffle."""
    cells = F.array(*[F.struct(F.lit(name).alias("label"), F.col(name.lower()).alias("n")) for name in TRANSITION_LABELS])
    return groups.select(F.inline(cells), "problem_id", "checkpoint_token").where("n > 0")


def _weight(transitions: DataFrame) -> Column:
    return F.col("n") if "n" in transitions.columns else F.lit(1)


def _label_counts(transitions: DataFrame, labels: Sequence[str]) -> list[Column]:
    """Sums per label of transitions, of a cube or of groups."""
    weight = _weight(transitions)
    part = lambda name: F.when(F.col("label") == name, weight) if "label" in transitions.columns else F.col(name.lower())
    return [F.coalesce(F.sum(part(name)), F.lit(0)).cast("bigint").alias(name.lower()) for name in labels]


def transition_funnel(
    checkpoints: DataFrame, rollouts: DataFrame, positions: Sequence[int], facts: DataFrame | None = None
) -> DataFrame:
    """Rows (counter, key, n): primary stage, observed side counter, eligibility, reasons."""
    if facts is None:
        facts = transition_facts(checkpoints, rollouts, positions)
    declared = declared_position_filter(positions)
    early = (
        checkpoints.where(~declared | ~is_completed())
        .groupBy(F.when(~declared, UNDECLARED).otherwise(NOT_COMPLETED).alias("key"))
        .agg(F.count("*").alias("n"))
        .select(F.lit("stage").alias("counter"), "key", "n")
    )
    grouped = facts.groupBy(
        "stage", "observed_outcome", "effective_eligibility", "exclusion_reasons"
    ).agg(F.count("*").alias("n"))
    single = lambda counter, column: F.struct(F.lit(counter).alias("counter"), F.col(column).alias("key"))
    reasons = F.transform(
        F.coalesce("exclusion_reasons", F.array().cast("array<string>")),
        lambda code: F.struct(F.lit("exclusion_reason").alias("counter"), code.alias("key")),
    )
    counters = F.concat(
        F.array(
            single("stage", "stage"),
            single("observed", "observed_outcome"),
            single("effective_eligibility", "effective_eligibility"),
        ),
        reasons,
    )
    late = grouped.select("n", F.inline(counters)).select("counter", "key", "n")
    return (
        early.unionByName(late)
        .where(F.col("key").isNotNull())
        .groupBy("counter", "key")
        .agg(F.sum("n").cast("bigint").alias("n"))
    )


def transition_rates_by_checkpoint(transitions: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Counts and rates per declared position; positions without events keep zero rows."""
    positions = declared_positions(positions)
    counts = transitions.groupBy("checkpoint_token").agg(*_label_counts(transitions, TRANSITION_LABELS))
    keys = literal_rows(transitions.sparkSession, "checkpoint_token", positions, "bigint")
    empty = keys.select("checkpoint_token", *[F.lit(0).cast("bigint").alias(n.lower()) for n in TRANSITION_LABELS])
    filled = (
        counts.withColumn("checkpoint_token", F.col("checkpoint_token").cast("bigint"))
        .unionByName(empty)
        .groupBy("checkpoint_token")
        .agg(*[F.sum(n.lower()).cast("bigint").alias(n.lower()) for n in TRANSITION_LABELS])
    )
    evaluable = F.col("w_to_c") + F.col("w_to_w") + F.col("c_to_c") + F.col("c_to_w")
    wrong = F.col("w_to_c") + F.col("w_to_w")
    return filled.select(
        "checkpoint_token",
        evaluable.alias("evaluable_transitions"),
        *[n.lower() for n in TRANSITION_LABELS],
        *[ratio(F.col(n.lower()), evaluable).alias(f"{n.lower()}_rate") for n in TRANSITION_LABELS],
        wrong.alias("wrong_checkpoint_transitions"),
        ratio(F.col("w_to_c"), wrong).alias("recovery_rate"),
        ratio(F.col("w_to_w"), wrong).alias("non_recovery_rate"),
    )


CONTRAST_METRICS = (
    "groups_any", "groups_with_w_to_c", "groups_with_w_to_w", "groups_mixed",
    "groups_only_w_to_c", "groups_only_w_to_w", "w_to_c_in_mixed", "w_to_w_in_mixed",
)


def matched_contrasts(transitions: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Same problem and position across seeds: which groups recover, fail, or do both.

    Groups never span positions, so the overall row is the sum of the few
    per-position rows instead of a second pass over the groups.
    """
    positions = declared_positions(positions)
    c, w = F.col("w_to_c"), F.col("w_to_w")
    if "label" in transitions.columns:
        wrong = transitions.where(F.col("label").isin(*WRONG_START_LABELS))
        groups = wrong.groupBy("problem_id", "checkpoint_token").agg(*_label_counts(wrong, WRONG_START_LABELS))
    else:
        groups = transitions.where((c > 0) | (w > 0))
    mixed = (c > 0) & (w > 0)
    summary = groups.groupBy(F.col("checkpoint_token").cast("bigint").alias("checkpoint_token")).agg(
        F.count("*").alias("groups_any"),
        count_where(c > 0).alias("groups_with_w_to_c"),
        count_where(w > 0).alias("groups_with_w_to_w"),
        count_where(mixed).alias("groups_mixed"),
        count_where((c > 0) & (w == 0)).alias("groups_only_w_to_c"),
        count_where((w > 0) & (c == 0)).alias("groups_only_w_to_w"),
        F.sum(F.when(mixed, c).otherwise(0)).alias("w_to_c_in_mixed"),
        F.sum(F.when(mixed, w).otherwise(0)).alias("w_to_w_in_mixed"),
    )
    keys = literal_rows(transitions.sparkSession, "checkpoint_token", positions, "bigint")
    empty = keys.select("checkpoint_token", *[F.lit(0).cast("bigint").alias(m) for m in CONTRAST_METRICS])
    return (
        summary.unionByName(empty)
        .rollup("checkpoint_token")
        .agg(
            F.grouping("checkpoint_token").alias("is_total"),
            *[F.sum(m).cast("bigint").alias(m) for m in CONTRAST_METRICS],
        )
        .select(
            F.when(F.col("is_total") == 1, "all_declared_checkpoints")
            .otherwise(F.col("checkpoint_token").cast("string"))
            .alias("scope"),
            *CONTRAST_METRICS,
        )
    )


def event_concentration(transitions: DataFrame, positions: Sequence[int]) -> DataFrame:
    """How strongly each label's events pile up in single problems or groups."""
    positions = declared_positions(positions)
    exact = "decimal(38,0)"
    square = lambda column: (column.cast("decimal(19,0)") * column.cast("decimal(19,0)")).cast(exact)
    cells = transitions if "n" in transitions.columns else transition_cube(transitions)
    cells = cells.withColumnRenamed("n", "cell")
    seen = [f"at_{p}" for p in positions]
    problems = cells.groupBy("label", "problem_id").agg(
        F.sum("cell").alias("events"),
        F.count("*").alias("cells"),
        F.max("cell").alias("max_cell"),
        F.sum(square(F.col("cell"))).alias("cell_squares"),
        *[
            F.max(F.when(F.col("checkpoint_token") == p, 1).otherwise(0)).alias(name)
            for p, name in zip(positions, seen)
        ],
    )
    totals = problems.groupBy("label").agg(
        F.sum("events").alias("event_count"),
        F.count("*").alias("distinct_problems"),
        F.sum("cells").alias("distinct_groups"),
        F.max("events").alias("max_in_problem"),
        F.max("max_cell").alias("max_in_group"),
        F.sum(square(F.col("events"))).alias("problem_squares"),
        F.sum("cell_squares").alias("group_squares"),
        *[F.max(name).alias(name) for name in seen],
    )
    labels = literal_rows(transitions.sparkSession, "label", TRANSITION_LABELS, "string")
    # At most one row per label of the four.
    rows = labels.join(F.broadcast(totals), "label", "left")
    whole = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("bigint")
    events = F.col("event_count").cast("double")
    index = lambda name: F.col(name).cast("double") / (events * events)
    at_positions = sum((F.coalesce(F.col(name), F.lit(0)) for name in seen), F.lit(0))
    return rows.select(
        "label",
        whole("event_count").alias("event_count"),
        whole("distinct_problems").alias("distinct_problems"),
        whole("distinct_groups").alias("distinct_groups"),
        at_positions.cast("bigint").alias("distinct_positions"),
        whole("max_in_problem").alias("max_events_in_problem"),
        ratio(F.col("max_in_problem"), F.col("event_count")).alias("max_problem_share"),
        whole("max_in_group").alias("max_events_in_group"),
        ratio(F.col("max_in_group"), F.col("event_count")).alias("max_group_share"),
        index("problem_squares").alias("herfindahl_by_problem"),
        index("group_squares").alias("herfindahl_by_group"),
    )


def concentration_positions(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy("label", F.col("checkpoint_token").cast("bigint").alias("checkpoint_token")).agg(
        F.sum(_weight(transitions)).cast("bigint").alias("event_count")
    )

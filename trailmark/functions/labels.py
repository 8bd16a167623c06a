"""Transition labels and censoring decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions import strict
from trailmark.functions.receipts import is_evaluated
from trailmark.params import CensoringPolicy


def verdict(status: Column, correct: Column) -> Column:
    """Correctness of an evaluated answer; NULL for every other status."""
    return F.when(is_evaluated(status), correct)


# A label's code is 2 * correct_at_checkpoint + correct_at_end, so it follows from the
# two verdicts by arithmetic and is NULL if either verdict is.
_BY_CODE = ("W_TO_W", "W_TO_C", "C_TO_W", "C_TO_C")


def _labels() -> Column:
    return F.array(*[F.lit(label) for label in _BY_CODE])


def derived_code(forced_verdict: Column, final_verdict: Column) -> Column:
    return forced_verdict.cast("int") * 2 + final_verdict.cast("int")


def code_of_label(label: Column) -> Column:
    """Code of a recorded label; NULL if it is NULL or not one of the four labels."""
    return (F.nullif(F.array_position(_labels(), label), F.lit(0)) - 1).cast("int")


def label_of_code(code: Column) -> Column:
    return F.get(_labels(), code)


def classify_transition(
    forced_status: Column, forced_correct: Column, final_status: Column, final_correct: Column
) -> Column:
    """wrong/correct at the checkpoint -> wrong/correct at the end; NULL unless both evaluated."""
    code = derived_code(verdict(forced_status, forced_correct), verdict(final_status, final_correct))
    return label_of_code(code)


def agreed_code(recorded: Column, derived: Column) -> Column:
    """The recorded code if valid, else the derived one; NULL when they contradict."""
    return F.when(recorded.isNull(), derived).when(
        derived.isNull() | (recorded == derived), recorded
    )


def agreement_status(name: Column, raw_label: Column, recorded: Column, derived: Column) -> Column:
    """How :func:`agreed_code` was reached; ``name`` is the upper-cased source column."""
    return (
        F.when(recorded != derived, F.concat(name, F.lit("_AND_DERIVED_TRANSITION_MISMATCH")))
        .when(recorded == derived, F.concat(name, F.lit("_AND_DERIVED_TRANSITION")))
        .when(recorded.isNotNull(), F.concat(name, F.lit("_TRANSITION_ONLY")))
        .when(derived.isNotNull(), F.lit("DERIVED_TRANSITION"))
        .when(raw_label.isNotNull(), F.concat(F.lit("INVALID_"), name))
        .otherwise(F.lit("NON_EVALUABLE_OR_ERROR_TRANSITION"))
    )


def reason_codes(decision: Column) -> Column:
    """Sorted distinct non-empty string codes of ``reasons``; other entries are ignored."""
    entries = F.when(
        strict.is_array(decision, "$.reasons"),
        F.try_variant_get(decision, "$.reasons", "array<variant>"),
    )
    codes = F.transform(entries, lambda entry: strict.strict_string(entry, "$.code"))
    kept = F.filter(codes, lambda code: code.isNotNull() & (code != ""))
    return F.coalesce(F.array_sort(F.array_distinct(kept)), F.array().cast("array<string>"))


def apply_eligibility(
    availability: Column,
    base_termination: Column,
    close_marker_start: Column,
    forced_termination: Column,
    final_status: Column,
    forced_status: Column,
    policy: CensoringPolicy = CensoringPolicy(),
) -> Column:
    """Six censoring criteria; an unobserved status fails its criterion."""
    sure = lambda condition: F.coalesce(condition, F.lit(False))
    criteria = {
        "checkpoint_available": ("CHECKPOINT_NOT_AVAILABLE", sure(availability == "AVAILABLE")),
        "base_terminated_naturally": (
            "BASE_TERMINATION_NOT_NATURAL_EOS",
            sure(base_termination == policy.required_base_termination),
        ),
        "base_has_close_think_marker": (
            "BASE_CLOSE_THINK_MARKER_MISSING",
            sure(close_marker_start >= 0),
        ),
        "forced_terminated_naturally": (
            "FORCED_TERMINATION_NOT_NATURAL_EOS",
            sure(forced_termination == policy.required_forced_termination),
        ),
        "original_final_evaluable": (
            "ORIGINAL_FINAL_NOT_EVALUABLE",
            sure(final_status.isin(*policy.evaluable_statuses)),
        ),
        "forced_answer_evaluable": (
            "FORCED_ANSWER_NOT_EVALUABLE",
            sure(forced_status.isin(*policy.evaluable_statuses)),
        ),
    }
    reasons = F.array_compact(F.array(*[F.when(~ok, F.lit(code)) for code, ok in criteria.values()]))
    return F.struct(
        F.lit(policy.policy_id).alias("policy_id"),
        (F.size(reasons) == 0).alias("eligible"),
        F.struct(*[ok.alias(name) for name, (_, ok) in criteria.items()]).alias("criteria"),
        reasons.alias("reasons"),
    )

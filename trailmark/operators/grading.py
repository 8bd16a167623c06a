"""Extraction, grading, labelling and censoring of returned completions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.answers import (
    REASONS, canonical_number, extract_boxed, normalise_answer, rational_part, same_long_fraction,
)
from trailmark.functions.labels import apply_eligibility, classify_transition
from trailmark.functions.receipts import is_evaluated
from trailmark.functions.strict import is_blank
from trailmark.params import CensoringPolicy
from trailmark.vocab import EVALUATION_STATUSES


def extract_answers(completions: DataFrame, text: str = "generated_text") -> DataFrame:
    """Adds ``extraction``: struct of status, text, offsets and reason."""
    return completions.withColumn("extraction", extract_boxed(F.col(text)))


def evaluate_answers(
    extracted: DataFrame,
    reference: str = "reference_answer",
    equal: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Adds ``evaluation`` for rows that carry an ``extraction`` struct.

    ``equal`` plugs in a user's Arrow UDF (reference, candidate) -> boolean.
    """
    staged = evaluate_pairs(
        extracted.withColumn("_candidate", F.col("extraction.extracted_text")),
        reference, "_candidate", equal, F.col("extraction.status"),
    )
    return staged.drop("_candidate")


def evaluate_pairs(
    answers: DataFrame,
    reference: str,
    candidate: str,
    equal: Callable[[Column, Column], Column] | None = None,
    extraction_status: Column | None = None,
) -> DataFrame:
    """Adds ``evaluation``: struct of status, correct, reason and parsed counts.

    Every case that cannot be graded keeps its reason. Normalisation, number parsing
    and the verdict are separate projections, so each runs once per row.
    """
    blank = lambda name: F.coalesce(is_blank(F.col(name)), F.lit(True))
    status = F.lit("EXTRACTED") if extraction_status is None else extraction_status
    plain = answers.withColumns(
        {
            "_extraction": status,
            "_left": normalise_answer(F.col(reference)),
            "_right": normalise_answer(F.col(candidate)),
        }
    )
    if equal is None:
        parts = plain.withColumns(
            {
                "_a": rational_part(F.col("_left"), 1), "_b": rational_part(F.col("_left"), 2),
                "_c": rational_part(F.col("_right"), 1), "_d": rational_part(F.col("_right"), 2),
            }
        )
        same_number = F.col("_a") * F.col("_d") == F.col("_c") * F.col("_b")
        same_digits = canonical_number(F.col("_left")) == canonical_number(F.col("_right"))
        settled = parts.withColumn("_settled", F.coalesce(same_number, same_digits))
        long = same_long_fraction(F.col("_left"), F.col("_right"), F.col("_settled"))
        judged = settled.withColumn("_equal", F.coalesce("_settled", long, F.col("_left") == F.col("_right")))
    else:
        judged = plain.withColumn("_equal", equal(F.col(reference), F.col(candidate)))
    case = (
        F.when(F.col("_extraction") == "ERROR", "EXTRACTION_FAULT")
        .when(F.col("_extraction") != "EXTRACTED", "NOT_EXTRACTED")
        .when(blank(reference), "NO_REFERENCE")
        .when(blank(candidate), "NO_CANDIDATE")
        .when(F.col("_left") == "", "REFERENCE_UNPARSED")
        .when(F.col("_right") == "", "CANDIDATE_UNPARSED")
        .when(F.col("_equal").isNull(), "NO_VERDICT")
        .otherwise("GRADED")
    )
    known = judged.withColumn("_case", case)
    outcome = F.col("_case")
    graded = outcome == "GRADED"
    reason = F.when(
        outcome == "NOT_EXTRACTED", F.concat(F.lit("answer extraction status: "), F.col("_extraction"))
    )
    for name, text in REASONS.items():
        reason = reason.when(outcome == name, text)
    evaluation = F.struct(
        F.when(graded, F.when(F.col("_equal"), "CORRECT").otherwise("INCORRECT"))
        .when(outcome.isin("EXTRACTION_FAULT", "NO_VERDICT"), "ERROR")
        .otherwise("NON_EVALUABLE")
        .alias("status"),
        F.when(graded, F.col("_equal")).alias("correct"),
        reason.alias("reason"),
        F.when(outcome == "REFERENCE_UNPARSED", 0)
        .when(outcome.isin("CANDIDATE_UNPARSED", "NO_VERDICT", "GRADED"), 1)
        .alias("parsed_reference_count"),
        F.when(outcome == "CANDIDATE_UNPARSED", 0)
        .when(outcome.isin("NO_VERDICT", "GRADED"), 1)
        .alias("parsed_candidate_count"),
    )
    helpers = ("_extraction", "_left", "_right", "_a", "_b", "_c", "_d", "_settled", "_equal", "_case")
    return known.withColumn("evaluation", evaluation).drop(*helpers)


def grade_completions(completions: DataFrame, text: str = "generated_text") -> DataFrame:
    return evaluate_answers(extract_answers(completions, text))


def evaluation_violations(evaluated: DataFrame, status: str, correct: str) -> DataFrame:
    """Rows where ``correct`` is set without an evaluated status, or the reverse."""
    s, c = F.col(status), F.col(correct)
    known = F.coalesce(s.isin(*EVALUATION_STATUSES), F.lit(False))
    violation = (
        F.when(is_evaluated(s) & c.isNull(), "EVALUATED_WITHOUT_CORRECTNESS")
        .when(known & ~is_evaluated(s) & c.isNotNull(), "CORRECTNESS_WITHOUT_EVALUATION")
    )
    return evaluated.withColumn("violation", violation).where(F.col("violation").isNotNull())


def label_transitions(
    graded: DataFrame, policy: CensoringPolicy = CensoringPolicy()
) -> DataFrame:
    """Adds the observed label, the censoring decision and the primary label.

    Needs availability_status, base_termination, close_marker_start,
    forced_termination and both evaluations as status/correct columns.
    """
    observed = classify_transition(
        F.col("forced_status"), F.col("forced_correct"), F.col("final_status"), F.col("final_correct")
    )
    decision = apply_eligibility(
        F.col("availability_status"), F.col("base_termination"), F.col("close_marker_start"),
        F.col("forced_termination"), F.col("final_status"), F.col("forced_status"), policy,
    )
    decided = graded.withColumns(
        {"observed_transition_label": observed, "analytic_eligibility": decision}
    )
    return decided.withColumn(
        "transition_label",
        F.when(F.col("analytic_eligibility.eligible"), F.col("observed_transition_label")),
    )

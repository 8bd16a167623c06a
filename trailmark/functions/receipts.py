"""Small receipt-level expressions shared by stages and summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.vocab import EVALUATED_STATUSES, NOT_RECORDED


def is_completed(status: Column = None) -> Column:
    status = F.col("status") if status is None else status
    return status.eqNullSafe("COMPLETED")


def normalise_evaluation(status: Column) -> Column:
    return F.coalesce(status, F.lit(NOT_RECORDED))


def is_evaluated(status: Column) -> Column:
    return F.coalesce(status.isin(*EVALUATED_STATUSES), F.lit(False))


def failure_kind(error_type: Column, missing: str = NOT_RECORDED) -> Column:
    """Stage reports use NOT_RECORDED for a missing type, the run summary UNKNOWN_FAILURE."""
    return F.coalesce(F.nullif(error_type, F.lit("")), F.lit(missing))


def failure_payload(
    error_type: Column, message: Column, cuda_oom: Column, elapsed: Column, limit: int | None = None
) -> Column:
    """The message is kept whole unless a ``limit`` of characters is given."""
    return F.struct(
        error_type.alias("error_type"),
        (message if limit is None else F.substring(message, 1, limit)).alias("message"),
        F.coalesce(cuda_oom, F.lit(False)).alias("cuda_oom"),
        elapsed.alias("elapsed_seconds"),
    )


def memory_delta(after: Column, before: Column) -> Column:
    return after - before


def count_where(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL, not 0, when the denominator is 0."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))

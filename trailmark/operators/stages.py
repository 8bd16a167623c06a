"""Per-stage accounting over typed receipts (base rollouts or forced checkpoints).

Evaluation columns are named by the caller: ``final_status``/``final_correct`` for
rollouts, ``forced_status``/``forced_correct`` for checkpoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.receipts import (
    count_where,
    failure_kind,
    is_completed,
    is_evaluated,
    normalise_evaluation,
    ratio,
)
from trailmark.operators.exact import exact_totals, totals_with
from trailmark.operators.quantiles import (
    median_ranks,
    nearest_rank_quantiles,
    value_counts,
    values_at_ranks,
)
from trailmark.operators.scaffold import literal_rows
from trailmark.vocab import FAILED_STATUSES, NOT_RECORDED


def completed(receipts: DataFrame) -> DataFrame:
    return receipts.where(is_completed())


def failed(receipts: DataFrame, statuses: tuple[str, ...] = FAILED_STATUSES) -> DataFrame:
    return receipts.where(F.col("status").isin(*statuses))


def with_generation(receipts: DataFrame) -> DataFrame:
    return receipts.where(is_completed() & F.col("generation_recorded"))


def receipt_status_counts(receipts: DataFrame) -> DataFrame:
    return receipts.groupBy(F.coalesce("status", F.lit("UNKNOWN")).alias("status")).agg(
        F.count("*").alias("n")
    )


def evaluation_status_counts(receipts: DataFrame, status: str) -> DataFrame:
    return receipts.groupBy(normalise_evaluation(F.col(status)).alias("evaluation_status")).agg(
        F.count("*").alias("n")
    )


def valid_correctness(status: Column, correct: Column) -> Column:
    return is_evaluated(status) & correct.isNotNull()


def _evaluation_counts(status: str, correct: str) -> list[Column]:
    s, c = F.col(status), F.col(correct)
    valid = valid_correctness(s, c)
    return [
        count_where(valid).alias("evaluable"),
        count_where(valid & c).alias("correct"),
        count_where(valid & ~c).alias("incorrect"),
        count_where(s == "NON_EVALUABLE").alias("non_evaluable"),
        count_where(s == "ERROR").alias("errors"),
        count_where(is_evaluated(s) & c.isNull()).alias("malformed"),
        count_where(normalise_evaluation(s) == NOT_RECORDED).alias("not_recorded"),
    ]


def stage_evaluation_counts(receipts: DataFrame, status: str, correct: str) -> DataFrame:
    """Evaluable, malformed and faulty results over all receipts, in one pass."""
    return receipts.agg(F.count("*").alias("receipts"), *_evaluation_counts(status, correct))


def _failure_counts() -> list[Column]:
    return [
        count_where(F.col("status").isin(*FAILED_STATUSES)).alias("failed_or_interrupted"),
        count_where(F.col("cuda_oom")).alias("explicit_oom"),
    ]


def failure_summary(receipts: DataFrame) -> DataFrame:
    """Explicit OOM is counted over every receipt, failures over failed or interrupted ones."""
    return receipts.agg(*_failure_counts())


def failure_type_counts(receipts: DataFrame) -> DataFrame:
    return (
        failed(receipts)
        .groupBy(failure_kind(F.col("error_type")).alias("error_type"))
        .agg(F.count("*").alias("n"))
    )


def failure_counts_by_kind(all_receipts: DataFrame) -> DataFrame:
    """FAILED receipts of both stages, as the run summary counts them."""
    kind = F.coalesce("error_type", F.lit("UNKNOWN_FAILURE"))
    return failed(all_receipts, ("FAILED",)).groupBy(kind.alias("error_type")).agg(F.count("*").alias("n"))


def termination_counts(receipts: DataFrame) -> DataFrame:
    status = F.coalesce("termination_status", F.lit(NOT_RECORDED)).alias("termination_status")
    return with_generation(receipts).groupBy(status).agg(F.count("*").alias("n"))


def _termination_totals() -> list[Column]:
    recorded = is_completed() & F.col("generation_recorded")
    return [
        count_where(recorded & (F.col("termination_status") == "MAX_NEW_TOKENS")).alias("cap_reached"),
        count_where(is_completed() & ~F.col("generation_recorded")).alias("completed_without_generation"),
    ]


def termination_summary(receipts: DataFrame) -> DataFrame:
    return receipts.agg(*_termination_totals())


def _generation_sums(usable: Column) -> tuple[list[Column], dict[str, Column]]:
    """Counts and token sums, and the conditions of the two totals of elapsed time."""
    tokens = F.when(usable, F.col("generated_token_count"))
    elapsed = F.when(usable, F.col("elapsed_seconds"))
    paired = tokens.isNotNull() & elapsed.isNotNull()
    sums = [
        count_where(usable).alias("generations"),
        F.sum(tokens).alias("token_total"),
        F.count(tokens).alias("tokens_recorded"),
        F.count(elapsed).alias("elapsed_recorded"),
        count_where(paired).alias("paired"),
        F.sum(F.when(paired, tokens)).alias("paired_tokens"),
        count_where(paired & (elapsed == 0)).alias("zero_elapsed"),
    ]
    return sums, {"elapsed_total": elapsed.isNotNull(), "paired_elapsed": paired}


def _with_throughput(sums: DataFrame) -> DataFrame:
    throughput = ratio(F.col("paired_tokens"), F.col("paired_elapsed"))
    known = sums.withColumns({"tokens_per_second": throughput, "elapsed_total": F.coalesce("elapsed_total", F.lit(0.0))})
    return known.drop("paired_tokens", "paired_elapsed")


def generation_performance(receipts: DataFrame) -> DataFrame:
    """Token and time totals; aggregate throughput is a ratio of sums over paired rows. Times are summed exactly."""
    sums, totals = _generation_sums(F.lit(True))
    return _with_throughput(totals_with(with_generation(receipts), "elapsed_seconds", totals, sums))


def _memory_peaks(usable: Column) -> tuple[list[Column], list[Column]]:
    """Maxima and counts of the two measures."""
    allocated = F.when(usable, F.col("peak_allocated_bytes"))
    reserved = F.when(usable, F.col("peak_reserved_bytes"))
    maxima = [F.max(allocated).alias("peak_allocated_bytes"), F.max(reserved).alias("peak_reserved_bytes")]
    return maxima, [F.count(allocated).alias("allocated_measurements"), F.count(reserved).alias("reserved_measurements")]


def peak_memory(receipts: DataFrame) -> DataFrame:
    maxima, counts = _memory_peaks(F.lit(True))
    return with_generation(receipts).agg(*maxima, *counts)


def stage_overview(receipts: DataFrame, status: str, correct: str) -> DataFrame:
    """Every single-valued measure of a stage from one scan."""
    usable = is_completed() & F.col("generation_recorded")
    generation, totals = _generation_sums(usable)
    maxima, measured = _memory_peaks(usable)
    counts = [F.count("*").alias("receipts"), *_evaluation_counts(status, correct), *_failure_counts(), *_termination_totals()]
    return _with_throughput(totals_with(receipts, "elapsed_seconds", totals, [*counts, *generation, *measured], maxima))


def stage_counters(receipts: DataFrame, status: str) -> DataFrame:
    """Every count map of a stage from one scan: rows (counter, key, n).

    Receipts are grouped by the combination of their short vocabularies first; the few
    combinations are then unfolded into one row per counter.
    """
    combinations = receipts.select(
        F.coalesce("status", F.lit("UNKNOWN")).alias("receipt_status"),
        normalise_evaluation(F.col(status)).alias("evaluation"),
        F.when(F.col("status").isin(*FAILED_STATUSES), failure_kind(F.col("error_type"))).alias("failure_type"),
        F.when(
            is_completed() & F.col("generation_recorded"),
            F.coalesce("termination_status", F.lit(NOT_RECORDED)),
        ).alias("termination"),
        F.when(F.col("eligible"), "ELIGIBLE").otherwise("EXCLUDED").alias("eligibility"),
        "eligibility_status",
        F.when(~F.col("eligible"), F.col("reason_codes")).alias("exclusion_reason"),
    )
    names = combinations.columns
    counted = combinations.groupBy(*names).agg(F.count("*").alias("n"))
    entry = lambda name, key: F.struct(F.lit(name).alias("counter"), key.alias("key"))
    singles = F.array(*[entry(name, F.col(name)) for name in names[:-1]])
    codes = F.coalesce("exclusion_reason", F.array().cast("array<string>"))
    entries = F.concat(singles, F.transform(codes, lambda code: entry("exclusion_reason", code)))
    return (
        counted.select("n", F.inline(entries))
        .where(F.col("key").isNotNull())
        .groupBy("counter", "key")
        .agg(F.sum("n").cast("bigint").alias("n"))
    )


def _metric_values(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Distinct (metric, value, copies) rows of the named measures."""
    pairs = F.array(
        *[F.struct(F.lit(name).alias("metric"), c.cast("double").alias("value")) for name, c in metrics.items()]
    )
    return value_counts(df.select(F.inline(pairs)))


def _with_ranks(df: DataFrame, counts: DataFrame, metrics: dict[str, Column], ranks: dict[str, Column]) -> DataFrame:
    """One row per declared metric: count, total, min, max and the values at ``ranks``."""
    summary = counts.groupBy("metric").agg(
        F.sum("copies").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    totals = exact_totals(counts, ["metric"], "value", "copies")
    picked = values_at_ranks(counts, ranks)
    names = literal_rows(df.sparkSession, "metric", list(metrics), "string")
    # Each side holds at most one row per declared metric.
    for one in (summary, totals, picked):
        names = names.join(F.broadcast(one), "metric", "left")
    return names


def numeric_distribution(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Count, total, mean, min, nearest-rank quartiles and p90, max per metric.

    NULL values are ignored; a metric without values keeps a row with count 0.
    """
    rows = _with_ranks(df, _metric_values(df, metrics), metrics, nearest_rank_quantiles())
    return rows.select(
        "metric",
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        F.coalesce("total", F.lit(0.0)).alias("total"),
        ratio(F.col("total"), F.col("count")).alias("mean"),
        "min", "p25", "p50", "p75", "p90", "max",
    )


def length_distribution(rollouts: DataFrame) -> DataFrame:
    """Trajectory lengths of completed rollouts."""
    return numeric_distribution(completed(rollouts), {"length_tokens": F.col("generated_token_count")})


def generation_distributions(receipts: DataFrame) -> DataFrame:
    """Runtime and per-request throughput; throughput needs a positive elapsed time."""
    speed = F.when(
        F.col("elapsed_seconds") > 0, F.col("generated_token_count") / F.col("elapsed_seconds")
    )
    return numeric_distribution(
        with_generation(receipts),
        {"runtime_seconds": F.col("elapsed_seconds"), "tokens_per_second": speed},
    )


def runtime_mean_median(rollouts: DataFrame) -> DataFrame:
    """Mean and interpolated median of completed runtimes (not the nearest-rank p50)."""
    metrics = {"runtime": F.col("elapsed_seconds")}
    timed = completed(rollouts)
    rows = _with_ranks(timed, _metric_values(timed, metrics), metrics, median_ranks())
    return rows.select(
        ratio(F.col("total"), F.col("count")).alias("mean_seconds"),
        ((F.col("low_middle") + F.col("high_middle")) / 2).alias("median_seconds"),
    )


def final_accuracy(rollouts: DataFrame) -> DataFrame:
    """Accuracy over completed and eligible rollouts with a valid verdict."""
    s, c = F.col("final_status"), F.col("final_correct")
    kept = F.col("eligible")
    valid = kept & valid_correctness(s, c)
    counted = completed(rollouts).agg(
        F.count("*").alias("completed"),
        count_where(~kept).alias("excluded"),
        count_where(kept).alias("eligible"),
        count_where(valid).alias("evaluable"),
        count_where(valid & c).alias("correct"),
        count_where(valid & ~c).alias("incorrect"),
        count_where(kept & (s == "NON_EVALUABLE")).alias("non_evaluable"),
        count_where(kept & (s == "ERROR")).alias("errors"),
        count_where(kept & is_evaluated(s) & c.isNull()).alias("malformed"),
    )
    return counted.withColumn("accuracy", ratio(F.col("correct"), F.col("evaluable")))


def accuracy_status_counts(rollouts: DataFrame) -> DataFrame:
    return evaluation_status_counts(completed(rollouts).where("eligible"), "final_status")


def eligibility_summary(receipts: DataFrame) -> DataFrame:
    """Rows (counter, key, n): eligible/excluded totals, statuses, reasons of excluded rows."""
    grouped = receipts.groupBy("eligible", "eligibility_status", "reason_codes").agg(
        F.count("*").alias("n")
    )
    entry = lambda counter, key: F.struct(F.lit(counter).alias("counter"), key.alias("key"))
    no_codes = F.array().cast("array<string>")
    reasons = F.transform(
        F.when(F.col("eligible"), no_codes).otherwise(F.coalesce("reason_codes", no_codes)),
        lambda code: entry("exclusion_reason", code),
    )
    counters = F.concat(
        F.array(
            entry("receipts", F.when(F.col("eligible"), F.lit("ELIGIBLE")).otherwise(F.lit("EXCLUDED"))),
            entry("status", F.col("eligibility_status")),
        ),
        reasons,
    )
    return (
        grouped.select("n", F.inline(counters))
        .groupBy("counter", "key")
        .agg(F.sum("n").cast("bigint").alias("n"))
    )


def all_receipts_union(rollouts: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Receipts of both stages with a ``receipt_kind`` tag; missing columns are NULL."""
    return rollouts.withColumn("receipt_kind", F.lit("base")).unionByName(
        checkpoints.withColumn("receipt_kind", F.lit("forced")), allowMissingColumns=True
    )

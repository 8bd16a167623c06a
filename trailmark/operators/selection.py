"""Deterministic problem selection by hash rank, and its verification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import identity
from trailmark.functions.strict import is_blank

HASHES = ("problem_sha256", "reference_answer_sha256", "metadata_sha256")
MANIFEST_COLUMNS = ("problem_id", "source_index", "selection_rank", *HASHES)


def problem_violation() -> Column:
    """Reason a problem row breaks the input contract, else NULL."""
    blank = lambda name: F.coalesce(is_blank(F.col(name).cast("string")), F.lit(True))
    return (
        F.when(blank("problem_id"), "INVALID_PROBLEM_ID")
        .when(blank("problem"), "INVALID_PROBLEM")
        .when(blank("reference_answer"), "INVALID_REFERENCE_ANSWER")
    )


def validate_problems(problems: DataFrame, strict: bool = False) -> DataFrame:
    """Adds ``violation``; in strict mode the first bad row fails the job when it runs."""
    checked = problems.withColumn("problem_id", F.col("problem_id").cast("string"))
    violation = problem_violation()
    if not strict:
        return checked.withColumn("violation", violation)
    message = F.concat(F.lit("row "), F.col("source_index").cast("string"), F.lit(": "), violation)
    stop = F.when(violation.isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return checked.where(stop).withColumn("violation", F.lit(None).cast("string"))


def content_hashes(problems: DataFrame) -> DataFrame:
    """SHA-256 of problem text, reference answer and canonical metadata."""
    return problems.withColumns(
        {
            "problem_sha256": identity.sha256_text(F.col("problem")),
            "reference_answer_sha256": identity.sha256_text(F.col("reference_answer")),
            "metadata_sha256": identity.metadata_hash(F.col("level"), F.col("subject")),
        }
    )


def selection_rank(problems: DataFrame, seed: int) -> DataFrame:
    rank = identity.selection_rank(seed, F.col("problem_id"), F.col("source_index"))
    return problems.withColumn("selection_rank", rank)


def selection_manifest(problems: DataFrame, seed: int, size: int) -> DataFrame:
    """The ``size`` rows of lowest (rank, source_index); ``source_index`` is unique.

    Only ids are ranked. Ranks are digests, so their first digits deal them into even ranges that are in order; the
    counts of the ranges tell which ranges the selection needs, and only their ids are shuffled and numbered. No
    task sees more than one range. Up to ``TOP_K`` rows are first cut by a top-k per task, which shuffles fewer ids
    and selects the same rows. The texts of the selected rows are then fetched by joining the ids back, so only
    selected texts are hashed. Fewer rows than asked for fail the job when it runs.
    """
    if size <= 0:
        raise ValueError("manifest size must be positive")
    ranked = _dealt(selection_rank(problems.select("problem_id", "source_index"), seed))
    sizes = _range_sizes(ranked)
    if size <= TOP_K:
        top = manifest_ordinal(ranked.orderBy("selection_rank", "source_index").limit(size))
    else:
        top = _numbered(ranked, sizes, size)
    texts = problems.drop("problem_id")
    chosen = content_hashes(texts.join(top, "source_index")).select("manifest_ordinal", *MANIFEST_COLUMNS)
    return chosen.unionByName(_none_or_failure(sizes, size, chosen))


def _none_or_failure(sizes: DataFrame, size: int, like: DataFrame) -> DataFrame:
    """No rows, in the columns of ``like``; fails the job if the ranges do not hold ``size`` rows."""
    text = F.concat(F.lit(f"{size} problems asked for, available: "), F.col("available").cast("string"))
    short = F.when(F.col("available") >= size, F.lit(False)).otherwise(F.raise_error(text).cast("boolean"))
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema.fields]
    available = F.coalesce(F.sum("_rows"), F.lit(0)).alias("available")
    return sizes.agg(available).where(short).select(*empty)


def manifest_ordinal(selected: DataFrame) -> DataFrame:
    """Position of each selected row by (selection_rank, source_index), numbered range by range."""
    dealt = _dealt(selected)
    return _numbered(dealt, _range_sizes(dealt))


RANGE_DIGITS = 3  # 16 ** 3 ranges
TOP_K = 1000


def _dealt(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("_range", F.coalesce(F.substring("selection_rank", 1, RANGE_DIGITS), F.lit("")))


def _range_sizes(dealt: DataFrame) -> DataFrame:
    """Rows of each range: 4,096 at most, if ranks are hex digests."""
    return dealt.groupBy("_range").agg(F.count("*").alias("_rows"))


def _numbered(dealt: DataFrame, sizes: DataFrame, size: int | None = None) -> DataFrame:
    """Adds ``manifest_ordinal``: the rows of earlier ranges and the place in the own one; up to ``size`` if given."""
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    if size is not None:
        offsets = offsets.where(F.col("_before") < size)
    place = F.row_number().over(Window.partitionBy("_range").orderBy("selection_rank", "source_index"))
    ordinal = (F.col("_before") + F.col("_place")).cast("bigint")
    numbered = dealt.join(offsets, "_range").withColumn("_place", place).withColumn("manifest_ordinal", ordinal)
    kept = numbered if size is None else numbered.where(F.col("manifest_ordinal") <= size)
    return kept.drop("_range", "_before", "_place")


def checked_selection_size(problems: DataFrame, size: int) -> DataFrame:
    """One row telling whether ``size`` rows can be selected."""
    return problems.agg(F.count("*").alias("available")).select(
        F.lit(size).cast("bigint").alias("requested"), "available",
        ((F.lit(size) > 0) & (F.lit(size) <= F.col("available"))).alias("is_valid"),
    )


def verify_manifest(manifest: DataFrame, problems: DataFrame) -> DataFrame:
    """Violations (source_index, violation) of a manifest against its source rows.

    Source rows are reduced to the manifest's indexes before their texts are hashed.
    """
    wanted = manifest.select("source_index").distinct()
    source = (
        content_hashes(problems.join(wanted, "source_index", "left_semi"))
        .groupBy("source_index")
        .agg(
            F.count("*").alias("source_rows"),
            *[F.min(c).alias(f"actual_{c}") for c in ("problem_id", *HASHES)],
        )
    )
    rows = manifest.join(source, "source_index", "left")
    differs = [
        F.when(~F.col(c).eqNullSafe(F.col(f"actual_{c}")), F.lit(f"MISMATCH:{c}"))
        for c in ("problem_id", *HASHES)
    ]
    found = F.array_compact(
        F.array(
            F.when(F.col("source_rows").isNull(), F.lit("SOURCE_INDEX_OUT_OF_RANGE")),
            F.when(F.col("source_rows") > 1, F.lit("AMBIGUOUS_SOURCE_INDEX")),
            *[F.when(F.col("source_rows") == 1, d) for d in differs],
        )
    )
    repeated = manifest.groupBy("source_index").agg(F.count("*").alias("uses")).where("uses > 1")
    return (
        rows.select("source_index", F.explode(found).alias("violation"))
        .unionByName(repeated.select("source_index", F.lit("REPEATED_SOURCE_INDEX").alias("violation")))
        .distinct()
    )


def verify_rank_order(manifest: DataFrame, problems: DataFrame, seed: int, size: int) -> DataFrame:
    """Ordinals at which a stored manifest differs from the recomputed top-N."""
    columns = ("problem_id", "source_index", "selection_rank", *HASHES)
    stored = manifest.select("manifest_ordinal", F.struct(*columns).alias("stored"))
    fresh = selection_manifest(problems, seed, size).select(
        "manifest_ordinal", F.struct(*columns).alias("recomputed")
    )
    both = stored.join(fresh, "manifest_ordinal", "full")
    return both.where(~F.col("stored").eqNullSafe(F.col("recomputed"))).select(
        "manifest_ordinal",
        F.col("stored.problem_id").alias("stored_problem_id"),
        F.col("recomputed.problem_id").alias("recomputed_problem_id"),
    )


def bounded_scope(manifest: DataFrame, limit: int | None) -> DataFrame:
    """The first ``limit`` manifest rows; asking for more than exist fails the job."""
    if limit is None:
        return manifest
    size = manifest.agg(F.max("manifest_ordinal")).scalar()
    fits = F.when(
        F.coalesce(size, F.lit(0)) < limit,
        F.raise_error(F.lit(f"scope {limit} exceeds the reviewed manifest")).cast("boolean"),
    ).otherwise(F.col("manifest_ordinal") <= limit)
    return manifest.where(fits)

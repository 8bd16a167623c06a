"""Receipt directories and their typed, flat views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import strict
from trailmark.operators.eligibility import read_eligibility
from trailmark.sources.documents import read_json_files, read_or_empty


def read_receipts(spark: SparkSession, directory: str, strict_mode: bool = True) -> DataFrame:
    """(file_name, record VARIANT) for every ``*.json`` of a receipt directory."""
    return read_json_files(spark, directory, strict_mode)


def _evaluation(v: Column, key: str, prefix: str) -> list[Column]:
    return [
        strict.strict_string(v, f"$.{key}.status").alias(f"{prefix}_status"),
        strict.strict_bool(v, f"$.{key}.correct").alias(f"{prefix}_correct"),
    ]


def _generation(v: Column, key: str) -> list[Column]:
    kind = strict.json_type(v, f"$.{key}")
    recorded = F.coalesce(kind.startswith("OBJECT") & (kind != "OBJECT<>"), F.lit(False))
    memory = f"$.{key}.memory_after"
    return [
        recorded.alias("generation_recorded"),
        strict.nonnegative_int(v, f"$.{key}.generated_token_count").alias("generated_token_count"),
        strict.nonnegative_number(v, f"$.{key}.elapsed_seconds").alias("elapsed_seconds"),
        strict.shown_string(v, f"$.{key}.termination_status").alias("termination_status"),
        strict.nonnegative_int(v, f"{memory}.peak_allocated_bytes").alias("peak_allocated_bytes"),
        strict.nonnegative_int(v, f"{memory}.peak_reserved_bytes").alias("peak_reserved_bytes"),
    ]


def _failure(v: Column) -> list[Column]:
    return [
        strict.strict_string(v, "$.failure.error_type").alias("error_type"),
        F.coalesce(strict.strict_bool(v, "$.failure.cuda_oom"), F.lit(False)).alias("cuda_oom"),
    ]


def _with_eligibility(receipts: DataFrame, columns: list[Column]) -> DataFrame:
    return read_eligibility(receipts).select(*columns, "eligible", "eligibility_status", "reason_codes")


def typed_rollouts(receipts: DataFrame) -> DataFrame:
    """Flat rollout columns; texts and token arrays are not carried along."""
    v = F.col("record")
    return _with_eligibility(
        receipts,
        [
            strict.strict_string(v, "$.rollout_id").alias("rollout_id"),
            strict.strict_string(v, "$.problem_id").alias("problem_id"),
            strict.strict_int(v, "$.rollout_seed").alias("rollout_seed"),
            strict.shown_string(v, "$.status").alias("status"),
            *_evaluation(v, "final_evaluation", "final"),
            *_generation(v, "generation"),
            *_failure(v),
        ],
    )


def typed_checkpoints(receipts: DataFrame) -> DataFrame:
    v = F.col("record")
    return _with_eligibility(
        receipts,
        [
            strict.strict_string(v, "$.checkpoint_id").alias("checkpoint_id"),
            strict.strict_string(v, "$.parent_rollout_id").alias("parent_rollout_id"),
            strict.strict_string(v, "$.problem_id").alias("problem_id"),
            strict.strict_int(v, "$.checkpoint_token").alias("checkpoint_token"),
            strict.shown_string(v, "$.status").alias("status"),
            strict.shown_string(v, "$.availability_status").alias("availability_status"),
            *_evaluation(v, "forced_evaluation", "forced"),
            *_evaluation(v, "final_evaluation_reference", "final_ref"),
            strict.recorded_label(v, "$.observed_transition_label").alias("observed_transition_label"),
            strict.recorded_label(v, "$.transition_label").alias("transition_label"),
            *_generation(v, "forced_generation"),
            *_failure(v),
        ],
    )


def receipt_content_hash(receipts: DataFrame) -> DataFrame:
    """(file_name, content_hash): VARIANT prints with sorted keys, so key order is irrelevant."""
    return receipts.select("file_name", F.sha2(F.to_json("record"), 256).alias("content_hash"))


def land_receipts(typed: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Write typed receipts to Parquet once; later reports read only the columns they need.

    Name the run in ``partition_by``: landing again then replaces the partitions that come again, so a repeated
    landing doubles no receipt and deletes no other. Without it a folder is landed once: a second landing of the
    same receipts leaves it as it is, and one of other receipts fails instead of deleting the first.
    """
    if partition_by:
        writer = typed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*partition_by).parquet(path)
        return
    spark = typed.sparkSession
    landed = read_or_empty(spark, lambda: spark.read.schema(typed.schema).parquet(path), typed.schema)
    if landed.isEmpty():
        typed.write.mode("append").parquet(path)
        return
    digest = F.xxhash64(F.to_json(F.struct(*sorted(typed.columns)), {"ignoreNullFields": "false"})).cast("decimal(20,0)")
    sums = [df.agg(F.count("*").alias("rows"), F.sum(digest).alias("digest")).head() for df in (landed, typed)]
    if sums[0] != sums[1]:
        raise ValueError(f"{path} holds other receipts; name the run in partition_by to land beside them")

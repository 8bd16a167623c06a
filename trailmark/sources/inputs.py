"""Ledger, problems, manifest, runtime contract and disk usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions import strict
from trailmark.sources.documents import numbered_lines, parse_objects, read_json_lines, read_or_empty


def read_ledger(spark: SparkSession, path: str, strict_mode: bool = True, physical_order: bool = False) -> DataFrame:
    """Ledger events; order is the written ``seq``, or with ``physical_order`` the place of the line.

    In audit mode rejected lines are kept with their reason. In strict mode an event without a written
    ``seq`` fails the job, as no replay could place it, unless lines are numbered. Numbered events carry
    ``file_name`` and ``line_number`` too, and a strict fault names both.
    """
    lines = parse_objects(numbered_lines(spark, path), strict_mode) if physical_order else read_json_lines(spark, path, strict_mode)
    v = F.col("record")
    if strict_mode and not physical_order:
        unplaced = F.raise_error(F.lit("ledger event without a whole number seq")).cast("boolean")
        lines = lines.where(F.when(strict.strict_int(v, "$.seq").isNotNull(), F.lit(True)).otherwise(unplaced))
    text = lambda key: strict.strict_string(v, f"$.{key}").alias(key)
    payload = lambda key: strict.strict_string(v, f"$.payload.{key}").alias(key)
    audit = ["file_name", "line_number"] if physical_order else []
    audit += [] if strict_mode else ["problem", "value"]
    return lines.select(
        (F.col("position") if physical_order else strict.strict_int(v, "$.seq")).alias("seq"),
        F.to_timestamp(strict.strict_string(v, "$.timestamp_utc")).alias("timestamp_utc"),
        text("event_type"), text("intent_id"),
        payload("invocation_id"), payload("outcome"), payload("error_type"),
        strict.child(v, "$.payload").alias("payload"),
        *audit,
    )


def read_problems(
    problems: DataFrame,
    id_field: str,
    problem_field: str,
    answer_field: str,
    index_field: str,
    subject_field: str | None = None,
    level_field: str | None = None,
    require_rows: bool = True,
) -> DataFrame:
    """Map a source table to the problem columns; ``source_index`` must be stored in it.

    An empty table is rejected, which looks at one row.
    """
    needed = (id_field, problem_field, answer_field, index_field)
    missing = sorted(set(needed) - set(problems.columns))
    if missing:
        raise ValueError(f"dataset lacks required fields: {', '.join(missing)}")
    if require_rows and problems.isEmpty():
        raise ValueError("dataset split is empty")

    def metadata(name: str | None) -> Column:
        if name is None or name not in problems.columns:
            return F.lit(None).cast("string")
        kind = dict(problems.dtypes)[name]
        keeps_type = kind in ("string", "tinyint", "smallint", "int", "bigint")
        return F.col(name) if keeps_type else F.col(name).cast("string")

    return problems.select(
        F.col(id_field).cast("string").alias("problem_id"),
        F.col(index_field).cast("bigint").alias("source_index"),
        F.col(problem_field).alias("problem"),
        F.col(answer_field).alias("reference_answer"),
        metadata(level_field).alias("level"),
        metadata(subject_field).alias("subject"),
    )


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """A single JSON object as (file_name, record); no row when the file is absent."""
    def scan() -> DataFrame:
        text = spark.read.text(path, wholetext=True)
        return text.select(F.col("_metadata.file_name").alias("file_name"), "value")

    return parse_objects(read_or_empty(spark, scan, "file_name string, value string"), True)


def manifest_records(documents: DataFrame) -> DataFrame:
    """Manifest rows in stored order; a wrong version or an empty list fails the job."""
    v = F.col("record")
    version_ok = strict.strict_int(v, "$.schema_version").eqNullSafe(1)
    records = F.when(strict.is_array(v, "$.records"), F.try_variant_get(v, "$.records", "array<variant>"))
    checked = (
        F.when(~version_ok, F.raise_error(F.lit("unsupported selection-manifest schema")))
        .when(F.coalesce(F.size(records), F.lit(0)) < 1, F.raise_error(F.lit("selection manifest must contain records")))
        .otherwise(records)
    )
    rows = documents.select(F.posexplode(checked).alias("position", "item"))
    item = F.col("item")
    texts = ("problem_id", "selection_rank", "problem_sha256", "reference_answer_sha256", "metadata_sha256")
    return rows.select(
        (F.col("position") + 1).cast("bigint").alias("manifest_ordinal"),
        strict.strict_int(item, "$.source_index").alias("source_index"),
        *[strict.strict_string(item, f"$.{name}").alias(name) for name in texts],
    )


def manifest_record_violations(records: DataFrame) -> DataFrame:
    """Manifest rows without a usable id or index, and repeated problem ids."""
    counted = records.groupBy("problem_id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("source_index").isNull()).alias("bad_index")
    )
    violation = (
        F.when(F.coalesce(F.col("problem_id"), F.lit("")) == "", "INVALID_PROBLEM_ID")
        .when(F.col("bad_index") > 0, "INVALID_SOURCE_INDEX")
        .when(F.col("rows") > 1, "DUPLICATE_PROBLEM_ID")
    )
    return counted.withColumn("violation", violation).where(F.col("violation").isNotNull())


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Header document and records of a manifest written by ``write_manifest``."""
    kinds = "manifest_ordinal bigint, problem_id string, source_index bigint, selection_rank string, "
    kinds += "problem_sha256 string, reference_answer_sha256 string, metadata_sha256 string"
    root = path.rstrip("/")
    records = read_or_empty(spark, lambda: spark.read.schema(kinds).option("mode", "FAILFAST").json(f"{root}/records"), kinds)
    return read_document(spark, f"{root}/header"), records


def manifest_header_violations(
    documents: DataFrame, expected: dict[str, str | int], records: DataFrame | None = None
) -> DataFrame:
    """Header fields (dotted paths) that differ from the configuration.

    The stored size is checked against the document's own list, or against ``records`` where they are a table.
    """
    v = F.col("record")

    def check(path: str, value: str | int):
        getter = strict.strict_int if isinstance(value, int) else strict.strict_string
        return F.when(~getter(v, f"$.{path}").eqNullSafe(value), F.lit(path))

    checks = [check(path, value) for path, value in expected.items()]
    revision = strict.strict_string(v, "$.dataset.resolved_revision")
    checks.append(F.when(F.coalesce(revision, F.lit("")) == "", F.lit("dataset.resolved_revision")))
    size = strict.strict_int(v, "$.selection_size")
    if records is None:
        stored = F.size(F.try_variant_get(v, "$.records", "array<variant>")).cast("bigint")
    else:
        stored = records.agg(F.count("*")).scalar()
    checks.append(F.when(~size.eqNullSafe(stored), F.lit("selection_size")))
    return documents.select(F.explode(F.array_compact(F.array(*checks))).alias("field"))


MEMORY_FIELDS = ("allocated_bytes", "reserved_bytes", "peak_allocated_bytes", "peak_reserved_bytes")


def runtime_contract(documents: DataFrame) -> DataFrame:
    """One row: model-load memory, or NOT_RECORDED when the document or field is absent."""
    v = F.col("record")
    path = "$.runtime.memory_after_load"
    kind = strict.json_type(v, path)
    recorded = F.coalesce(kind.startswith("OBJECT") & (kind != "OBJECT<>"), F.lit(False))
    fields = [
        F.max(F.when(recorded, strict.nonnegative_int(v, f"{path}.{name}"))).alias(name)
        for name in MEMORY_FIELDS
    ]
    found = documents.agg(F.count_if(recorded).alias("found"), *fields)
    status = F.when(F.col("found") > 0, "RECORDED").otherwise("NOT_RECORDED")
    return found.select(status.alias("status"), *MEMORY_FIELDS)


def read_runtime_contract(spark: SparkSession, path: str) -> DataFrame:
    return runtime_contract(read_document(spark, path))


def artifact_disk_usage(spark: SparkSession, root: str) -> DataFrame:
    """Total bytes and number of all files below ``root``, hidden ones too; a missing folder holds none.

    The file system is asked for its own summary of the folder, so no file is opened and no list of files
    is gathered.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = system.getContentSummary(path) if system.exists(path) else None
    counts = (found.getLength(), found.getFileCount()) if found else (0, 0)
    return spark.createDataFrame([counts], "bytes bigint, files bigint")

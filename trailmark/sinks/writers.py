"""Immutable receipts, content-addressed reports and ledger appends."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import ExitStack

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.functions.identity import canonical_json
from trailmark.operators.manifest_out import manifest_header
from trailmark.operators.selection import MANIFEST_COLUMNS
from trailmark.operators.summary import batch_digest
from trailmark.params import ManifestHeader
from trailmark.session import file_system, kept, materialise, shuffles_dropped
from trailmark.sources.documents import read_or_empty


class ConflictError(RuntimeError):
    """An immutable record already exists with different content."""


def content_hash(columns: list[str]) -> Column:
    """Hash of a row's canonical JSON; column order does not matter."""
    return F.sha2(canonical_json(F.struct(*sorted(columns))), 256)


# What a store adds to its records: the hash of the rest, and the folder that an id belongs to.
CONTENT_HASH = "_content_hash"
BUCKET = "_bucket"
BUCKETS = 32  # the most folders that Spark lists without a job
# An append of more bytes than SLICE is moved in up to SLICES parts, so that its shuffle files are a share of it.
SLICE, SLICES = 64 << 20, 4


def _versions(records: DataFrame, key: str) -> DataFrame:
    """(id, hash) of records; those of a store carry their hash."""
    own = [c for c in records.columns if c not in (CONTENT_HASH, BUCKET)]
    known = F.col(CONTENT_HASH) if CONTENT_HASH in records.columns else content_hash(own)
    return records.select(F.col(key).alias("id"), known.alias("hash"))


def append_once_status(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Per id: APPEND, UNCHANGED or CONFLICT.

    Both sides are tagged and counted per (id, content hash), so repeated copies
    collapse before the shuffle and no join is needed.
    """
    return _compared(incoming, existing, key).select("id", "status")


def _compared(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Per id its status and how many incoming records have it."""
    versions = (
        _versions(incoming, key).withColumn("side", F.lit(1))
        .unionByName(_versions(existing, key).withColumn("side", F.lit(2)))
        .groupBy("id", "hash")
        .agg(F.count_if(F.col("side") == 1).alias("copies"),
             F.max((F.col("side") == 2).cast("int")).alias("is_old"))
    )
    ids = versions.groupBy("id").agg(
        F.count("*").alias("versions"), F.sum("copies").alias("copies"), F.max("is_old").alias("is_old")
    )
    status = (
        F.when(F.col("versions") > 1, "CONFLICT")
        .when(F.col("is_old") == 1, "UNCHANGED")
        .otherwise("APPEND")
    )
    return ids.where(F.col("copies") > 0).select("id", status.alias("status"), "copies")


def bucket_of(key: str) -> Column:
    """Folder of an id; an id has the same one whatever the type of its column."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(BUCKETS)).cast("int")


def stored_versions(spark: SparkSession, path: str, like: DataFrame, key: str, buckets: list[int]) -> DataFrame:
    """Ids and content hashes in some folders of a store: the other folders and columns are not read.

    Files that no folder holds were not written by :func:`append_once`; they have no hash, so their ids conflict.
    """
    schema = T.StructType([like.schema[key], T.StructField(CONTENT_HASH, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
    stored = read_or_empty(spark, lambda: spark.read.schema(schema).parquet(path), schema)
    return stored.where(F.col(BUCKET).isin(buckets) | F.col(BUCKET).isNull()).select(key, F.coalesce(CONTENT_HASH, F.lit("")).alias(CONTENT_HASH))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The records of a store, as they were appended."""
    return spark.read.parquet(path).drop(CONTENT_HASH, BUCKET)


def append_once(incoming: DataFrame, path: str, key: str, stored: bool = False) -> None:
    """Append records whose id is new; same content is a no-op, different content or no id an error.

    Records lie in folders by a hash of their id, beside their content hash. An append computes the incoming
    records once, and of the store it reads only ids and hashes in the folders that its own ids fall into. Its copy of
    the records is deleted when it ends; ``stored`` says that they are read from files that stay as they are,
    which needs no copy. An append that was cut off can be repeated: what it has written counts as unchanged.
    """
    spark, columns = incoming.sparkSession, incoming.columns
    if {CONTENT_HASH, BUCKET} & set(columns):
        raise ValueError(f"records may not have columns {CONTENT_HASH} and {BUCKET}")
    hashed = incoming.withColumns({CONTENT_HASH: content_hash(columns), BUCKET: bucket_of(key)})
    with ExitStack() as held:
        if not stored:
            hashed = held.enter_context(kept(hashed, "append"))
        held.enter_context(shuffles_dropped(spark))
        buckets = [r[BUCKET] for r in hashed.select(BUCKET).distinct().collect()]  # BUCKETS and a NULL at most
        if None in buckets:
            raise ValueError(f"records without {key}")
        known = stored_versions(spark, path, incoming, key, buckets)
        status = held.enter_context(kept(_compared(hashed, known, key), "append_status"))
        sample = status.where(F.col("status") == "CONFLICT").head()
        if sample is not None:
            raise ConflictError(f"refusing to replace an immutable record: {sample['id']}")
        new = F.col("status") == "APPEND"
        found = status.agg(F.count_if(new).alias("new"), F.count_if(~new | (F.col("copies") > 1)).alias("other")).head()
        if not found["new"] and _exists(spark, path):
            return
        new_ids = status.where(new).select(F.col("id").alias(key))
        parts = max(1, min(SLICES, len(buckets), -(-_bytes(hashed) // SLICE)))
        for part in range(parts):
            fresh = hashed.where(F.col(BUCKET).isin(sorted(buckets)[part::parts])) if parts > 1 else hashed
            if found["other"] or not found["new"]:
                fresh = fresh.join(new_ids, key, "left_semi").dropDuplicates([key])
            # One file a folder, or more where a folder gets much: the runtime planner splits and merges by size.
            fresh = fresh.select(*columns, CONTENT_HASH, BUCKET).hint("rebalance", BUCKET)
            fresh.write.mode("append").option("compression", "zstd").partitionBy(BUCKET).parquet(path)


def _bytes(df: DataFrame) -> int:
    """Size of a table's files, or what the planner expects of other rows."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


FOLDERS = 64  # above Spark's limit for listing folders one after another


def write_json_files(records: DataFrame, path: str) -> None:
    """One JSON object per ``*.json`` file, in ``FOLDERS`` folders below ``path``, which must be a new one.

    Spark's own writer takes a task commit, a checksum and a change of permissions for each file, and the driver lists and
    moves all of them; here tasks write their files themselves, dealt to the folders in turn, so no text is shuffled. A file
    is written under a name of its attempt, then moved, so a repeated task replaces its own files only.
    """
    folders = [f"part={k}" for k in range(FOLDERS)]
    system, root = file_system(path.rstrip("/"))
    for folder in folders:
        system.create_dir(f"{root}/{folder}", recursive=True)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        system, root = file_system(path.rstrip("/"))
        for batch in source:
            for value in batch.column("value"):
                folder = f"{root}/{folders[(part + number) % len(folders)]}"
                held, name = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/record-{part:05d}-{number:09d}.json"
                with system.open_output_stream(held) as out:
                    out.write(value.as_buffer())
                system.move(held, name)
                number += 1
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], names=["n"])

    lines = records.select(F.to_json(F.struct("*")).alias("value"))
    lines.mapInArrow(run, "n bigint").agg(F.sum("n")).collect()


REPORT_KEYS = ("section", "key", "metric")


def report_digest(report: DataFrame) -> DataFrame:
    """Digest of a (section, key, metric, value) report, independent of row order."""
    name = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in REPORT_KEYS])
    value = F.coalesce("value", F.lit("null"))
    return batch_digest(report.select(name.alias("name"), value.alias("value")), "name", "value")


def write_summary(report: DataFrame, root: str) -> str:
    """Write a report under its own digest; the same report always lands at the same path.

    The report is computed once, into the shared folder, before it is hashed. A folder left by an
    interrupted write (without the commit's ``_SUCCESS``) is written again; a finished one whose content does not
    match its name is an error and stays as it is.
    """
    spark: SparkSession = report.sparkSession
    report = materialise(report, "report")
    digest = report_digest(report).head()["digest"]
    path = f"{root.rstrip('/')}/summary/content_hash={digest}"
    try:
        stored = spark.read.schema(report.schema).parquet(path)
        if report_digest(stored).head()["digest"] == digest:
            return path
        if _exists(spark, f"{path}/_SUCCESS"):
            raise ConflictError(f"refusing to replace a report that differs from its name: {path}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    report.write.mode("overwrite").parquet(path)
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def write_manifest(manifest: DataFrame, header: ManifestHeader, path: str) -> str:
    """Write header and records once and return the manifest's hash; the same again is a no-op, another an error.

    Records are JSON lines in manifest order over as many files as the rows need. The header is written
    last: a folder without one was left by an interrupted write and is written anew.
    """
    spark, root = manifest.sparkSession, path.rstrip("/")
    manifest = materialise(manifest.select("manifest_ordinal", *MANIFEST_COLUMNS), "manifest")
    found = manifest_header(manifest, header).head()
    if _exists(spark, f"{root}/header/_SUCCESS"):
        if spark.read.text(f"{root}/header").head()["value"] != found["header"]:
            raise ConflictError(f"refusing to replace an immutable manifest: {root}")
        return found["manifest_hash"]
    ordered = manifest.repartitionByRange("manifest_ordinal").sortWithinPartitions("manifest_ordinal")
    ordered.write.mode("overwrite").option("ignoreNullFields", False).json(f"{root}/records")
    spark.createDataFrame([(found["header"],)], "value string").coalesce(1).write.mode("overwrite").text(f"{root}/header")
    return found["manifest_hash"]


def append_ledger(events: DataFrame, path: str) -> None:
    """Append events (seq, event_type, intent_id, payload) as JSON lines with a UTC timestamp."""
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
                          "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = events.select(
        F.lit(1).alias("schema_version"),
        "seq",
        F.concat(stamp, F.lit("+00:00")).alias("timestamp_utc"),
        "event_type", "intent_id", "payload",
    )
    rows.write.mode("append").option("ignoreNullFields", False).json(path)

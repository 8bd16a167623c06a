"""Session for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Ship the helpers with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def local_session(cpus: str = "8", name: str = "trailmark") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        # HotSpot never compiles methods above 8,000 bytes; such stages run faster unfused.
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # Keep compiled stages of a whole session; the default cache holds 100.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    A local session without either gets a folder of its own; on a cluster that is an error, as executors
    would not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="trailmark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/trailmark/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, survives executor loss."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Runtime setting of Spark's: a write's shuffle files go when it ends, else when the driver happens to collect its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that begin and end in this block leave no shuffle files behind."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


@contextmanager
def kept(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """As :func:`materialise`, for the length of a block: small on disk, and deleted when the block ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        with shuffles_dropped(spark):
            df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def file_system(folder: str):
    """Arrow's file system and path of a folder as Spark names it: a plain path, ``file:/path`` or a URI."""
    from pyarrow import fs

    if folder.startswith("file:") or ":/" not in folder:
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", folder)
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))


def folder_entries(system, folder: str) -> Iterator[tuple[str, bool, int]]:
    """(name, whether it is a folder, bytes) of what lies in a folder of :func:`file_system`; a local one is never held whole."""
    from pyarrow import fs

    if not isinstance(system, fs.LocalFileSystem):
        for info in system.get_file_info(fs.FileSelector(folder)):
            yield info.base_name, info.type == fs.FileType.Directory, info.size or 0
        return
    with os.scandir(folder) as found:
        for entry in found:
            try:
                yield entry.name, entry.is_dir(), entry.stat().st_size
            except FileNotFoundError:  # a link to nothing, or gone meanwhile
                continue


def uri_name(name: str) -> str:
    """A file's name as Spark gives it in ``_metadata.file_name``: what a URI may not hold is escaped."""
    barred = "[^A-Za-z0-9_!.~'()*:@&=+$,;\u0080-\U0010ffff-]|[\u0080-\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    return re.sub(barred, lambda found: "".join(f"%{byte:02X}" for byte in found[0].encode()), name)

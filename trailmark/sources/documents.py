"""JSON documents and JSON lines landed as VARIANT, with fail-closed checks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.functions import strict
from trailmark.session import file_system, folder_entries, materialise, uri_name

MALFORMED = "MALFORMED_JSON"
NOT_OBJECT = "NOT_AN_OBJECT"
BLANK = "BLANK_LINE"


def read_or_empty(spark: SparkSession, read, schema: str) -> DataFrame:
    """``read()``, or an empty table when the path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns that later filters read instead of computing them again.

    A filter is pushed below plain columns and repeats their expressions, once for each use; it is not pushed
    below a generator that makes them.
    """
    row = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def parse_exact(lines: DataFrame) -> DataFrame:
    """Adds ``record``: the text as one VARIANT; NULL if malformed or followed by more.

    The JSON parser stops after the first value, so ``{}}`` would pass. Parsing
    ``[text, hash of text]`` and finding the hash second rules out trailing content.
    """
    marked = lines.withColumn("_mark", F.xxhash64("value"))
    text = F.concat(F.lit("["), F.col("value"), F.lit(","), F.col("_mark").cast("string"), F.lit("]"))
    paired = computed_once(marked, {"_pair": F.try_parse_json(text)})
    whole = F.try_variant_get("_pair", "$[1]", "bigint") == F.col("_mark")
    first = F.try_variant_get("_pair", "$[0]", "variant")
    return computed_once(paired, {"record": F.when(whole, first)}).drop("_mark", "_pair")


def json_problem(text: Column, parsed: Column) -> Column:
    return (
        F.when(strict.is_blank(text), BLANK)
        .when(parsed.isNull(), MALFORMED)
        .when(~strict.is_object(parsed), NOT_OBJECT)
    )


def parse_objects(lines: DataFrame, strict_mode: bool) -> DataFrame:
    """From (file_name, value) to (file_name, record[, problem]); numbered lines keep their numbers.

    Strict mode fails the job on the first bad text; audit mode keeps it with its reason.
    """
    parsed = parse_exact(lines)
    flagged = parsed.withColumn("problem", json_problem(F.col("value"), F.col("record")))
    placed = [c for c in ("line_number", "position") if c in lines.columns]
    if not strict_mode:
        return flagged.select("file_name", *placed, "record", "problem", "value")
    where = [F.lit(":"), F.col("line_number").cast("string")] if placed else []
    message = F.concat(F.col("problem"), F.lit(" in "), F.col("file_name"), *where)
    # A filter, so that no column pruning can drop the check.
    stop = F.when(F.col("problem").isNotNull(), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return flagged.where(stop).select("file_name", *placed, "record")


FILES = 10_000  # the most files that a task reads on average
BATCH_FILES, BATCH_BYTES = 1_000, 4 << 20  # of a task's files, what is in memory at once


def _arrow_folder(spark: SparkSession, directory: str) -> str | None:
    """A directory's full name, if it is one directory that Arrow opens."""
    if set("{}[]*?\\") & set(directory):
        return None
    place = spark._jvm.org.apache.hadoop.fs.Path(directory)
    system = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(place):
        return None
    folder = system.makeQualified(place).toString()
    try:
        system, root = file_system(folder)
        return folder if not system.get_file_info(root).is_file else None
    except (pa.ArrowException, OSError):
        return None


def _listed(folders: DataFrame, base: str) -> DataFrame:
    """(path, name, folder, bytes) of the folders and ``*.json`` files in ``folders`` but for names that Spark hides.

    A written table, so every later read sees the same files.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = file_system(base)[0]
        held: list = []

        def out() -> pa.RecordBatch:
            columns = [list(c) for c in zip(*held)] or [[], [], [], []]
            kinds = (pa.string(), pa.string(), pa.bool_(), pa.int64())
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "name", "folder", "bytes"])

        for batch in source:
            for folder in batch.column("path").to_pylist():
                for name, is_folder, size in folder_entries(system, folder):
                    hidden = name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name
                    if not hidden and (is_folder or name.endswith(".json")):
                        held.append((f"{folder.rstrip('/')}/{name}", name, is_folder, size))
                    if len(held) >= 10_000:
                        yield out()
        yield out()

    return materialise(folders.mapInArrow(run, "path string, name string, folder boolean, bytes bigint"), "listed")


def _json_files(spark: SparkSession, base: str) -> DataFrame | None:
    """(path, name, folder, bytes) of the files of a directory, or of one with folders ``key=value`` of files only; else None.

    Tasks list them, so the driver holds no names.
    """
    key = F.regexp_extract("name", "^([^=]+)=.", 1)
    found = _listed(spark.range(0, 1, 1, 1).select(F.lit(file_system(base)[1]).alias("path")), base)
    folder = F.col("folder")
    kinds = found.agg(
        F.count_if(folder).alias("folders"), F.count_if(~folder).alias("files"), F.count_if(folder & (key == "")).alias("plain"),
        F.min(F.when(folder, key)).alias("low"), F.max(F.when(folder, key)).alias("high"),
    ).head()
    if not kinds["folders"]:
        return found
    if kinds["files"] or kinds["plain"] or kinds["low"] != kinds["high"] or kinds["low"].lower() in ("value", "_metadata"):
        return None
    inside = _listed(found.select("path").repartition(4 * spark.sparkContext.defaultParallelism, "path"), base)
    return inside if inside.where("folder").isEmpty() else None


def _whole_files(files: DataFrame, base: str) -> DataFrame:
    """(file_name, value) of listed files, in tasks of so many bytes as Spark's own readers take, or of ``FILES`` files."""
    spark = files.sparkSession
    files = files.where("bytes > 0")  # as Spark's text reader
    total = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).head()
    most = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    tasks = max(1, min(total["files"], spark.sparkContext.defaultParallelism), -(-total["files"] // FILES), -(-total["bytes"] // most))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system = file_system(base)[0]
        names: list = []
        values: list = []
        held = 0
        for batch in source:
            for path, name in zip(batch.column("path").to_pylist(), batch.column("name").to_pylist()):
                with system.open_input_stream(path, compression=None) as file:
                    values.append(file.read())
                names.append(uri_name(name))
                held += len(values[-1])
                if held >= BATCH_BYTES or len(names) >= BATCH_FILES:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.binary())], names=["file_name", "value"])
                    names, values, held = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.binary())], names=["file_name", "value"])

    read = files.select("path", "name").repartition(tasks, "path").mapInArrow(run, "file_name string, value binary")
    return read.select("file_name", F.col("value").cast("string").alias("value"))


def read_json_files(spark: SparkSession, directory: str, strict_mode: bool = True) -> DataFrame:
    """One JSON object per ``*.json`` file; a missing directory is an empty table.

    Tasks list the files and read them, some MB each: Spark's own reader lists them in the driver, which then holds about
    a KB for each file, and packs as few as four small files into a task. It reads what is left: paths with wildcards, stores that Arrow does
    not open, and folders in other places than ``key=value`` below the directory.
    """
    def scan() -> DataFrame:
        text = spark.read.text(directory, wholetext=True, pathGlobFilter="*.json")
        return text.select(F.col("_metadata.file_name").alias("file_name"), "value")

    base = _arrow_folder(spark, directory)
    files = None if base is None else _json_files(spark, base)
    lines = read_or_empty(spark, scan, "file_name string, value string") if files is None else _whole_files(files, base)
    return parse_objects(lines, strict_mode)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, line_number, position, value) of every line below ``path``, blank ones too, in physical order.

    ``line_number`` counts in the file; ``position`` goes on through all files, by modification time, then path. A
    task reads the lines of a split one after another, so a line's place in its split is its distance from the
    split's first row; what lies before the split is a sum over splits. Texts are neither shuffled nor sorted:
    the first pass counts, the second numbers, and a place outside of its split fails the job.
    """
    meta = lambda name: F.col(f"_metadata.{name}").alias(f"_{name}")

    def scan() -> DataFrame:
        found = spark.read.text(path).select(
            "value", meta("file_path"), meta("file_name"), meta("file_modification_time"), meta("file_block_start")
        )
        return found.withColumn("_row", F.monotonically_increasing_id())

    empty = "value string, _file_path string, _file_name string, _file_modification_time timestamp, _file_block_start long, _row long"
    lines = read_or_empty(spark, scan, empty)
    split = ["_file_path", "_file_block_start"]
    sizes = lines.groupBy(*split, "_file_modification_time").agg(F.count("*").alias("_rows"), F.min("_row").alias("_first"))
    in_file = Window.partitionBy("_file_path").orderBy("_file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    in_all = Window.orderBy("_file_modification_time", *split).rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    none = F.lit(0).cast("bigint")
    offsets = sizes.select(
        *split, "_rows", "_first", F.coalesce(F.sum("_rows").over(in_file), none).alias("_in_file"),
        F.coalesce(F.sum("_rows").over(in_all), none).alias("_in_all"),
    )
    place = F.col("_row") - F.col("_first")
    moved = F.raise_error(F.lit("the splits of the files changed between two passes")).cast("bigint")
    placed = lines.join(offsets, split).withColumn("_place", F.when((place >= 0) & (place < F.col("_rows")), place + 1).otherwise(moved))
    return placed.select(
        F.col("_file_name").alias("file_name"), (F.col("_in_file") + F.col("_place")).alias("line_number"),
        (F.col("_in_all") + F.col("_place")).alias("position"), "value",
    )


def read_json_lines(spark: SparkSession, path: str, strict_mode: bool = True) -> DataFrame:
    def scan() -> DataFrame:
        return spark.read.text(path).select(F.col("_metadata.file_name").alias("file_name"), "value")

    lines = read_or_empty(spark, scan, "file_name string, value string")
    return parse_objects(lines, strict_mode)

"""Structured Streaming over the two append-only inputs: ledger events and receipts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from trailmark.operators.ledger import DECIDING_EVENTS, STATES, event_code, state_name

HISTORY_BUCKETS = 1024
VIOLATIONS = ("TERMINAL_WITHOUT_START", "DUPLICATE_START", "DUPLICATE_TERMINAL")


def stream_intent_states(events: DataFrame) -> DataFrame:
    """State and validity per intent with constant state, for batch or streaming input.

    The exact violation code needs the third event: :func:`stream_intent_histories` gives it. Events
    without ``seq`` come last and ties are decided as in the batch replay.
    """
    coded = events.where(F.col("intent_id").isNotNull()).withColumn("code", event_code(F.col("event_type")))
    start, terminal = F.col("code") == 0, F.col("code") > 0
    place = F.struct(F.col("seq").isNull().alias("none"), F.col("seq").alias("seq"), F.col("code").alias("code"))
    seen = coded.where(F.col("code").isNotNull()).groupBy("intent_id").agg(
        F.count_if(start).alias("starts"),
        F.count_if(terminal).alias("terminals"),
        F.min(F.when(start, place)).alias("first_start"),
        F.min(F.when(terminal, place)).alias("first_terminal"),
    )
    invalid = (
        (F.col("starts") != 1)
        | (F.col("terminals") > 1)
        | F.coalesce(F.col("first_terminal") < F.col("first_start"), F.lit(False))
    )
    state = F.when(F.col("terminals") == 0, "STARTED_UNKNOWN").otherwise(state_name(F.col("first_terminal.code")))
    return seen.select("intent_id", F.when(~invalid, state).alias("state"), invalid.alias("is_violation"))


def stream_intent_histories(events: DataFrame, buckets: int = HISTORY_BUCKETS) -> DataFrame:
    """State and exact violation per intent of a stream, as the batch replay gives them once all has arrived.

    An intent's state is its first three start or terminal events so far, in replay order, whatever order they
    arrive in. A row is emitted only where a batch changes an intent's answer. Intents are dealt into ``buckets`` by a
    hash of their id, so that Python is called for a bucket and not for an intent; a batch reads and writes the state of the
    buckets it touches. A stream keeps the number of buckets it began with.
    """
    bucket = F.pmod(F.xxhash64("intent_id"), F.lit(buckets)).alias("bucket")
    seq = F.col("seq").cast("bigint")
    coded = events.where(F.col("intent_id").isNotNull()).select(
        bucket, "intent_id", seq.isNull().alias("unplaced"), F.coalesce(seq, F.lit(0)).alias("seq"), event_code(F.col("event_type")).alias("code")
    )
    return coded.where(F.col("code").isNotNull()).groupBy("bucket").applyInPandasWithState(
        _replay, "intent_id string, state string, violation string", "events binary", "update", "NoTimeout"
    )


_PLACE = ["intent_id", "unplaced", "seq", "code"]
_MERGED_ROWS = 10_000


def _replay(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    before = _unpacked(state.get[0]) if state.exists else None
    first, new, rows = before, [], 0
    for frame in frames:
        new.append(_deciding(frame[_PLACE]))
        rows += len(new[-1])
        if rows > max(_MERGED_ROWS, 0 if first is None else len(first)):
            first, new, rows = _deciding(pd.concat(new if first is None else [first, *new])), [], 0
    if new:
        first = _deciding(pd.concat(new if first is None else [first, *new]))
    state.update((_packed(first),))
    found = _answers(first)
    if before is not None:
        known = _answers(before).reindex(found.index)
        found = found[(found != known) | known.isna()]
    if len(found):
        violated = found.isin(VIOLATIONS)
        yield pd.DataFrame({"intent_id": found.index, "state": found.mask(violated, None).values, "violation": found.where(violated, None).values})


def _deciding(events: pd.DataFrame) -> pd.DataFrame:
    """The first three events of every intent, in replay order."""
    return events.sort_values(_PLACE).groupby("intent_id", sort=False).head(DECIDING_EVENTS)


def _answers(first: pd.DataFrame) -> pd.Series:
    """State or violation of every intent from its first three events, by the rules of the batch replay."""
    placed = first.assign(place=first.groupby("intent_id", sort=False).cumcount())
    codes = placed.pivot(index="intent_id", columns="place", values="code").reindex(columns=range(DECIDING_EVENTS))
    e1, e2, e3 = (codes[n] for n in range(DECIDING_EVENTS))
    rules = [e1 != 0, (e2 == 0) | (e3 == 0), e3.notna(), e2.isna()]
    states = np.array(STATES, object)[e2.fillna(1).clip(lower=1).astype(int) - 1]
    return pd.Series(np.select(rules, [*VIOLATIONS, "STARTED_UNKNOWN"], states).astype(object), index=codes.index)


def _packed(events: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(events, pa.schema([("intent_id", pa.string()), ("unplaced", pa.bool_()), ("seq", pa.int64()), ("code", pa.int32())]), preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(raw))).read_all().to_pandas()


def stream_receipt_counts(receipts: DataFrame) -> DataFrame:
    """Receipts per position and status; duplicates stay counted."""
    return receipts.groupBy(
        F.col("checkpoint_token").cast("bigint").alias("checkpoint_token"),
        F.coalesce("status", F.lit("UNKNOWN")).alias("status"),
    ).agg(F.count("*").alias("n"))


def run_available(stream: DataFrame, path: str, output_mode: str) -> None:
    """Process what has arrived, one folder per micro-batch.

    Writing a batch again after a failure replaces its own folder only, so each batch
    counts once.
    """
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    query = (
        stream.writeStream.outputMode(output_mode)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write_batch)
        .start()
    )
    query.awaitTermination()


def latest_updates(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Newest row per key of an update-mode output: the last compacted table and the batches after it."""
    return _newest(spark, path, key).drop("batch")


def compact_updates(spark: SparkSession, path: str, key: str) -> None:
    """Write the newest row per key as one table, so that later reads skip the batches it covers.

    Batches stay as they are. An unfinished table has no ``_SUCCESS`` and is never read; compacting again
    without new batches replaces nothing.
    """
    last = spark.read.parquet(f"{path}/rows").agg(F.max("batch")).head()[0]
    if last is not None and last != _compacted(spark, path):
        _newest(spark, path, key).write.mode("overwrite").parquet(f"{path}/compacted/upto-{last}")


def _newest(spark: SparkSession, path: str, key: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows")
    upto = _compacted(spark, path)
    if upto is not None:
        done = spark.read.parquet(f"{path}/compacted/upto-{upto}")
        rows = rows.where(F.col("batch") > upto).unionByName(done)
    columns = [c for c in rows.columns if c not in (key, "batch")]
    newest = rows.groupBy(key).agg(F.max(F.struct("batch", *columns)).alias("newest"))
    return newest.select(key, "newest.batch", *[F.col(f"newest.{c}").alias(c) for c in columns])


def _compacted(spark: SparkSession, path: str) -> int | None:
    """The last batch that a finished compacted table covers."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/compacted")
    system = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
    finished = lambda name: system.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/compacted/{name}/_SUCCESS"))
    return max((int(name.removeprefix("upto-")) for name in names if finished(name)), default=None)


def latest_complete(spark: SparkSession, path: str) -> DataFrame:
    """The last batch of a complete-mode output."""
    rows = spark.read.parquet(f"{path}/rows")
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")

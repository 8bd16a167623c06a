"""Helpers of this subpackage: tables, row keys, batches and word hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.session import materialise, scratch_path

__all__ = [
    "batches", "fold", "map_text", "materialise", "read", "scratch_path", "splitmix", "text_key", "unit", "word_hashes",
]

MAX_CACHED_WORDS = 150_000  # a full cache is emptied; it saves time only


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_key(text: Column) -> Column:
    """16 bytes that stand for a whole text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def fold(doc_id: int | None, parts: int) -> int:
    """crc32 of the id as text, modulo ``parts``; a null id is in part 0."""
    return 0 if doc_id is None else crc32(str(doc_id).encode()) % parts


def fold_column(doc_id: Column, parts: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def splitmix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform doubles in (0, 1] from the upper 53 bits."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / (1 << 53))


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MAX_CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


_HASHES = _WordHashes()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def release() -> None:
    """Give freed memory back to the system: Spark keeps idle Python workers, and one executor runs many."""
    _HASHES.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def batches(source: Iterable[pa.RecordBatch], column: str = "text", chars: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one hold about ``chars`` bytes, one row at least."""
    for batch in source:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + chars, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def map_text(
    df: DataFrame, fields: list[tuple[str, T.DataType]], work: Callable[[list[str]], dict[str, object]], text: str = "text"
) -> DataFrame:
    """All columns of ``df`` but the text, followed by ``fields``, which ``work`` makes from a list of whole texts.

    ``work`` returns one array or list for each field. Null texts reach it as empty.
    """
    kept = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*kept, *(T.StructField(name, kind) for name, kind in fields)])
    keep, made = [f.name for f in kept], [name for name, _ in fields]
    kinds = T.StructType([T.StructField(name, kind) for name, kind in fields])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(kinds)
        for batch in batches(source, text):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            found = work(texts)
            columns = [batch.column(name) for name in keep]
            columns += [pa.array(found[name], type=wanted.field(name).type) for name in made]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *made])

    return df.mapInArrow(run, schema)

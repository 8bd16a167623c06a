"""Context-triggered piecewise hashing of whole texts.

A hash of the last ``WINDOW`` bytes rolls over the UTF-8 bytes of a text. A position ends a piece of block size
2**k if the upper k bits of its hash are zero, so an edit moves only the ends next to it; where the same hash comes
again, it ends no piece, so a repeated line takes up one piece and not all of them. Every piece gives one of 64
letters. The least k that leaves at most ``PIECES`` ends and the three block sizes above it make the fingerprint,
``k:letters:letters:letters:letters``. Two fingerprints are compared at the smallest block size that both have, by
the edit distance of their letters (insertions and deletions) against both lengths; it counts only where they have
``COMMON`` letters in a row in common (half of the shorter, rounded up, if that is less), as unrelated letters agree
by chance.

Equal texts have equal fingerprints and likeness 1; null texts count as empty; an empty text has no letters and
is unlike any other. Any length is hashed whole, in segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.shared import batches, materialise

WINDOW = 7
PIECES = 63
SIZES = 4
COMMON = 4
SEGMENT = 1 << 20
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_BASE = 0x2F0B4C47
_STIR = 0x9E3779B1
_WEIGHTS = [pow(_BASE, j, 1 << 32) for j in range(WINDOW)]

FIELDS = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, head string, tail string, part int"
)


def rolled(data: bytes, start: int, stop: int) -> np.ndarray:
    """Hash of the ``WINDOW`` bytes that end at each position from ``start`` to ``stop``; bytes before the first are 0."""
    before = min(start, WINDOW - 1)
    seen = np.zeros(stop - start + WINDOW - 1, np.uint32)
    seen[WINDOW - 1 - before :] = np.frombuffer(data, np.uint8, stop - start + before, start - before)
    found = np.zeros(stop - start, np.uint32)
    for j, weight in enumerate(_WEIGHTS):
        found += seen[WINDOW - 1 - j : WINDOW - 1 - j + len(found)] * np.uint32(weight)
    found ^= found >> np.uint32(15)
    found *= np.uint32(_STIR)
    return found


def _wanted(hashes: np.ndarray, level: int) -> np.ndarray:
    return hashes.astype(np.uint64) < np.uint64((1 << 32) >> min(level, 31))


def _ends(data: bytes, level: int) -> tuple[np.ndarray, np.ndarray]:
    """First position of every hash whose upper ``level`` bits are zero, in order, and the hashes."""
    at, hashes = np.zeros(0, np.int64), np.zeros(0, np.uint32)
    for start in range(0, len(data), SEGMENT):
        found = rolled(data, start, min(start + SEGMENT, len(data)))
        ends = np.flatnonzero(found <= np.uint32(((1 << 32) >> level) - 1))
        hashes, first = np.unique(np.concatenate([hashes, found[ends]]), return_index=True)
        at = np.concatenate([at, ends + start])[first]
    order = np.argsort(at)
    return at[order], hashes[order]


def _letters(data: bytes, ends: np.ndarray) -> str:
    found, start = [], 0
    for end in ends.tolist():
        found.append(LETTERS[xxhash.xxh32_intdigest(data[start : end + 1]) >> 26])
        start = end + 1
    if start < len(data):
        found.append(LETTERS[xxhash.xxh32_intdigest(data[start:]) >> 26])
    return "".join(found)


def fingerprint(text: str) -> str:
    data = text.encode()
    level = max(0, (len(data) // PIECES).bit_length() - 2)
    at, hashes = _ends(data, level)
    while len(at) <= PIECES and level > 0:  # fewer ends than usual: look at smaller blocks
        level = max(0, level - 3)
        at, hashes = _ends(data, level)
    while len(at) > PIECES:
        level += 1
        keep = _wanted(hashes, level)
        at, hashes = at[keep], hashes[keep]
    return ":".join([str(level), *(_letters(data, at[_wanted(hashes, level + i)]) for i in range(SIZES))])


def shared_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one integer."""
    where: dict[str, int] = {}
    for i, letter in enumerate(a):
        where[letter] = where.get(letter, 0) | 1 << i
    mask = row = (1 << len(a)) - 1
    for letter in b:
        hit = row & where.get(letter, 0)
        row = (row + hit | row - hit) & mask
    return len(a) - row.bit_count()


def _alike(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    size = min(COMMON, (min(len(a), len(b)) + 1) // 2)
    runs = {a[i : i + size] for i in range(len(a) - size + 1)}
    if runs.isdisjoint([b[i : i + size] for i in range(len(b) - size + 1)]):
        return 0.0
    distance = len(a) + len(b) - 2 * shared_letters(a, b)
    return 1.0 - distance / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """From 0 to 1; 1 for equal fingerprints, 0 where they have no block size in common."""
    if a == b:
        return 1.0
    (i, *first), (j, *second) = a.split(":"), b.split(":")
    step = int(j) - int(i)
    if abs(step) >= SIZES:
        return 0.0
    return _alike(first[max(0, step)], second[max(0, -step)])


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many code points of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _row(doc_id: int | None, text: str, own: str, following: str, following_print: str) -> tuple:
    changed = edited(text, following)
    changed_print = fingerprint(changed)
    digest = hashlib.sha256(changed.encode()).hexdigest()
    return doc_id, len(text), digest, own, changed_print, likeness(own, changed_print), likeness(own, following_print)


_KINDS = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, *[pa.string()] * 2, pa.int32()]
_NAMES = [field.split()[0] for field in FIELDS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)


def _chained(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row of a sorted partition with the row after it; the last row only as an edge, with the first text."""
    part, first, last = TaskContext.get().partitionId(), None, None
    for batch in batches(source):
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            own = fingerprint(text)
            if last is None:
                first = text
            else:
                rows.append((*_row(*last, text, own), None, None, None))
            last = doc_id, text, own
        if rows:
            yield _batch(rows)
    if last is not None:
        yield _batch([(last[0], len(last[1]), None, last[2], None, None, None, first, last[1], part)])


def _joined(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(source, "tail"):
        rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tail", "fingerprint", "next_head")))
        yield _batch([(*_row(i, text, own, head, fingerprint(head)), None, None, None) for i, text, own, head in rows])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, one row a document.

    Documents follow each other by descending doc_id (null last; rows of one id by the md5 of their text), the first
    after the last. Texts are shuffled once, into sorted ranges; each range compares its neighbours as they stream by and
    leaves its first and last text, which meet those of the next range by a join. Only ranges' numbers are
    ordered in one task. One document follows itself; no documents give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    chained = materialise(rows.orderBy(F.desc_nulls_last("doc_id"), F.md5("text")).mapInArrow(_chained, FIELDS), "fingerprints")
    result = _NAMES[:7]
    edges = chained.where("part is not null")
    numbers = edges.select("part").withColumn("following", F.lead("part").over(Window.orderBy("part")))
    numbers = numbers.withColumn("following", F.coalesce("following", F.min("part").over(Window.partitionBy())))
    heads = edges.select(F.col("part").alias("following"), F.col("head").alias("next_head"))
    met = edges.join(numbers, "part").join(heads, "following").select("doc_id", "tail", "fingerprint", "next_head")
    return chained.where("part is null").select(result).unionAll(met.mapInArrow(_joined, FIELDS).select(result))

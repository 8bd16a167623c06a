"""Benchmark decontamination by the q-gram lemma, diagonal bands and banded alignment.

Text and items are compared as lower-case letters and digits with single spaces between. An item of
m characters found with at most k edits shares at least m - q + 1 - k * q of its q-grams with the place
it is found at, and all of them lie on diagonals (place in the text less place in the item) no
more than k apart. Shared q-grams are therefore counted in bands of 2 * (k + 1) diagonals that overlap by
half, so each such set of diagonals lies in one band. Bands that reach the bound are aligned; the alignment stays within
the band and counts edits, with free ends in the text. q is the largest up to ``Q`` that leaves an item of m
characters at least one shared q-gram at k = a tenth of m edits, q <= m / (k + 1); items are indexed by their q.
Items of fewer than ``LEAST`` characters are looked for unchanged, between borders of words; in scripts that
put no spaces between words every place is a border.

Items are cut into blocks of bounded size; a block's q-gram index is broadcast and the texts pass once
for each block, in Arrow batches with numpy. No text is split, so no match is lost at a border.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.shared import batches

Q = 8  # most characters of a gram
ERRORS = 0.1  # edits for each character of an item
LEAST = 24  # characters an item must have to be looked for with edits
BLOCK_CHARS = 2_000_000  # normalised characters of items in one broadcast
FILTER_BITS = 22


def normalise(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the normalised text and the place of each in the given one."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c.lower()[0] for c in text)
    codes = np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), np.uint32)
    plain = codes.copy()
    small = codes < 128
    plain[small & ~_ALNUM[np.where(small, codes, 0)]] = 32
    # White space and punctuation beyond ASCII: few code points, looked up one by one.
    for code in np.unique(codes[~small]):
        if not chr(code).isalnum() and not (0xD800 <= code < 0xE000):
            plain[codes == code] = 32
    space = plain == 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    place = np.nonzero(keep)[0]
    found = plain[place]
    begin = 1 if len(found) and found[0] == 32 else 0
    stop = len(found) - 1 if len(found) > begin and found[-1] == 32 else len(found)
    return found[begin:stop], place[begin:stop]


_ALNUM = np.array([chr(i).isalnum() for i in range(128)])


def qgrams(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """64-bit hashes of all runs of q codes."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    total = np.zeros(len(codes) - q + 1, np.uint64)
    for i in range(q):
        total = total * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - q + 1 + i]
    return total * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Index:
    q: int
    ids: list  # item ids
    items: list[np.ndarray]
    lengths: np.ndarray
    edits: np.ndarray
    bounds: np.ndarray  # least number of shared q-grams
    grams: np.ndarray  # sorted distinct hashes
    first: np.ndarray  # where the postings of each begin, and the end
    owner: np.ndarray
    place: np.ndarray
    known: np.ndarray  # by the upper bits of a hash: is any gram there


@dataclass
class Items:
    indexes: list[Index]  # one for each length of grams
    short: dict[str, list]  # normalised text of short items, and their ids
    lengths: dict[int, list[int]]  # lengths of short items by their first code


def build(items: list[tuple[object, str]], errors: float = ERRORS, least: int = LEAST) -> Items:
    """Indexes of items (id, text); null ones and those without a letter or digit are left out."""
    groups: dict[int, list[tuple[object, np.ndarray]]] = {}
    short: dict[str, list] = {}
    lengths: dict[int, set[int]] = {}
    for i, text in items:
        codes = normalise(text)[0] if text else ()
        if len(codes) >= least:
            groups.setdefault(min(Q, len(codes) // (int(len(codes) * errors) + 1)), []).append((i, codes))
        elif len(codes):
            short.setdefault(_string(codes), []).append(i)
            lengths.setdefault(int(codes[0]), set()).add(len(codes))
    return Items([_index(found, q, errors) for q, found in sorted(groups.items())], short, {c: sorted(own) for c, own in lengths.items()})


def _string(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


# Scripts written without spaces between words: Thai, Lao, Myanmar, Khmer, kana, ideographs.
_UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x312F), (0x31A0, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))


def borders(codes: np.ndarray) -> np.ndarray:
    """Whether a word may begin or end before each code, and after the last."""
    free = codes == 32
    if len(codes) and codes.max() >= _UNSPACED[0][0]:
        for low, high in _UNSPACED:
            free |= (codes >= low) & (codes <= high)
    found = np.ones(len(codes) + 1, bool)
    found[1:-1] = free[1:] | free[:-1]
    return found


def exact(codes: np.ndarray, items: Items) -> list[tuple[object, int, int]]:
    """(item id, start, end) of the first place of every short item in one normalised text."""
    border = borders(codes)
    starts = np.nonzero(border[:-1])[0]
    text, found = _string(codes), {}
    for start, code in zip(starts.tolist(), codes[starts].tolist()):
        for length in items.lengths.get(code, ()):
            piece = text[start : start + length]
            if piece in items.short and piece not in found and border[start + len(piece)]:
                found[piece] = start
    return [(i, start, start + len(piece)) for piece, start in found.items() for i in items.short[piece]]


def _index(found: list[tuple[object, np.ndarray]], q: int, errors: float) -> Index:
    lengths = np.array([len(c) for _, c in found], np.int64)
    edits = (lengths * errors).astype(np.int64)
    grams = [qgrams(c, q) for _, c in found]
    every = np.concatenate(grams)
    owner = np.repeat(np.arange(len(found)), [len(g) for g in grams])
    place = np.concatenate([np.arange(len(g)) for g in grams])
    order = np.argsort(every, kind="stable")
    distinct, first = np.unique(every[order], return_index=True)
    known = np.zeros(1 << FILTER_BITS, bool)
    known[(distinct >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Index(
        q, [i for i, _ in found], [c for _, c in found], lengths, edits, lengths - q + 1 - edits * q, distinct,
        np.append(first, len(every)), owner[order], place[order], known,
    )


def align(item: np.ndarray, region: np.ndarray, most: int, low: int | None = None, high: int | None = None) -> tuple[int, int, int]:
    """Least edits of the whole item against any part of the region, and that part's ends; most + 1 if there are more.

    Only the diagonals ``low`` to ``high`` (place in the region less place in the item) are computed, all of them if none are
    given: a row per item character, as wide as the band. Start and end are free; each cell also carries where its
    path began. Places before and after the region match nothing, so a path over them costs what leaving out the item's characters does.
    """
    low = -len(item) if low is None else low
    high = len(region) if high is None else high
    before, after = max(0, -low), max(0, len(item) + high - len(region))
    padded = np.concatenate([np.full(before, _NOTHING), region, np.full(after, _NOTHING)])
    width = high - low + 1
    at = np.arange(width)
    cost, begin = np.zeros(width, np.int64), at + low
    down, start_down = np.empty(width, np.int64), np.empty(width, np.int64)
    down[-1], start_down[-1] = len(item) + most + 2, 0  # from beyond the band
    for i, code in enumerate(item):
        first = before + i + low
        diagonal = cost + (padded[first : first + width] != code)
        down[:-1], start_down[:-1] = cost[1:] + 1, begin[1:]
        take = diagonal <= down
        own, start = np.where(take, diagonal, down), np.where(take, begin, start_down)
        best = np.minimum.accumulate(own - at)  # steps to the right cost one each
        origin = np.maximum.accumulate(np.where(own - at == best, at, 0))
        cost, begin = best + at, start[origin]
        if cost.min() > most:
            return most + 1, 0, 0
    end = int(cost.argmin())
    return int(cost[end]), min(max(0, int(begin[end])), len(region)), min(max(0, len(item) + low + end), len(region))


_NOTHING = np.uint32(0xFFFFFFFF)  # no code point


def regions(codes: np.ndarray, index: Index, hits: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(item, first, last diagonal) of bands whose shared q-grams reach the bound.

    ``hits`` are places in the text whose gram is number ``rows`` of the index.
    """
    counts = index.first[rows + 1] - index.first[rows]
    posting = np.repeat(index.first[rows] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    owner, place = index.owner[posting], index.place[posting]
    enough = (np.bincount(owner, minlength=len(index.items)) >= index.bounds)[owner]
    owner, place = owner[enough], place[enough]
    if not len(owner):
        return
    diagonal = np.repeat(hits, counts)[enough] - place
    # Half-bands of every item that is hit, numbered one after another; two neighbours are a band.
    step = index.edits + 1
    lower = diagonal // step[owner]
    lowest, highest = -(-index.lengths // step) - 1, int(hits[-1]) // step
    size = highest + lowest + 3
    ends = np.cumsum(size)
    number = (ends - size + lowest + 1)[owner] + lower
    halves = np.bincount(number, minlength=int(ends[-1]))
    # Grams met twice count twice here, so no band is lost; those that reach the bound are counted exactly.
    whose = np.repeat(np.arange(len(size)), size)
    bands = np.nonzero(halves[:-1] + halves[1:] >= index.bounds[whose[:-1]])[0]
    bands = bands[whose[bands] == whose[bands + 1]]
    if not len(bands):
        return
    order = np.argsort(number, kind="stable")
    sorted_ = number[order]
    for band in bands.tolist():
        item = int(whose[band])
        own = order[np.searchsorted(sorted_, band) : np.searchsorted(sorted_, band + 2)]
        if len(np.unique(place[own])) >= index.bounds[item]:
            half = band - int(ends[item] - size[item]) - int(lowest[item]) - 1
            yield item, half * int(step[item]), (half + 2) * int(step[item]) - 1


def matches(codes: np.ndarray, index: Index, grams: np.ndarray, least: int) -> list[tuple[int, int, int, int]]:
    """(item, edits, start, end) of the best match of every item in one normalised text."""
    hits = np.nonzero(index.known[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])[0]
    if len(hits) < least:
        return []
    rows = np.searchsorted(index.grams, grams[hits])
    rows[rows == len(index.grams)] = 0
    real = index.grams[rows] == grams[hits]
    hits, rows = hits[real], rows[real]
    if len(hits) < least:
        return []
    best: dict[int, tuple[int, int, int]] = {}
    for item, low, high in regions(codes, index, hits, rows):
        if item in best and best[item][0] == 0:
            continue
        spare, pattern = int(index.edits[item]), index.items[item]
        start = max(0, low - spare)
        region = codes[start : high + len(pattern) + spare]
        a = _find(region, pattern)
        edits, a, b = (0, a, a + len(pattern)) if a >= 0 else align(pattern, region, spare, low - spare - start, high + spare - start)
        if edits <= spare and (item not in best or (edits, start + a) < best[item][:2]):
            best[item] = (edits, start + a, start + b)
    return [(item, *found) for item, found in sorted(best.items())]


def _find(region: np.ndarray, pattern: np.ndarray) -> int:
    """Where the pattern stands unchanged, -1 if nowhere."""
    raw, wanted = region.tobytes(), pattern.tobytes()
    at = raw.find(wanted)
    while at % 4 and at > 0:  # a find inside of a code
        at = raw.find(wanted, at + 1)
    return at // 4 if at >= 0 else -1


def _blocks(spark, items: DataFrame, least_words: int = 0) -> Iterator[Items]:
    """Indexes of all items of so many words, each of bounded size: the blocks are counted first, then read one by one."""
    rows = items.select("item_id", "text").where("text IS NOT NULL").distinct()
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_CHARS
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else rows
        own = sorted(part.collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        yield build([(r.item_id, r.text) for r in own if words(normalise(r.text)[0]) >= least_words])


def _search(texts: list[str], items: Items) -> Iterator[list[tuple[object, int, int, int]]]:
    """(item id, edits, start, end) of the matches of each text, with places in the text as given."""
    least = [max(1, int(index.bounds.min())) for index in items.indexes]
    for text in texts:
        codes, place = normalise(text)
        found = [
            (index.ids[item], *rest) for index, bound in zip(items.indexes, least) for item, *rest in matches(codes, index, qgrams(codes, index.q), bound)
        ]
        if items.short and len(codes):
            found += [(item, 0, a, b) for item, a, b in exact(codes, items)]
        yield [(item, edits, int(place[a]), int(place[b - 1]) + 1) for item, edits, a, b in found]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, edits, start, end: the best place of every benchmark item found in every whole text.

    Among places with as few edits the first counts. Null and empty texts match nothing; items that are null or without
    a letter or digit are not looked for; repeated rows give repeated results; null ids stay.
    """
    spark = docs.sparkSession
    schema = T.StructType(
        [docs.schema["doc_id"], benchmark.schema["item_id"], T.StructField("edits", T.IntegerType()),
         T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )
    found = None
    for index in _blocks(spark, benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(source: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            kinds = to_arrow_schema(schema)
            for batch in batches(source, chars=1_000_000):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                rows = [
                    (doc_id, item, *rest)
                    for doc_id, own in zip(batch.column("doc_id").to_pylist(), _search(texts, sent.value))
                    for item, *rest in own
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names=kinds.names)

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


LEAST_WORDS = 2  # words of an item that may remove a text


def words(codes: np.ndarray) -> int:
    """Words of a normalised text; each character counts in scripts written without spaces."""
    border = borders(codes)
    return int((border[:-1] & (codes != 32)).sum())


def clean(docs: DataFrame, benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with all their columns as they are.

    Items of fewer than ``least_words`` words remove nothing, as half of a corpus may hold a single word;
    :func:`contaminated` reports them all the same. Null and empty texts stay, repeated rows go or stay together.
    """
    for index in _blocks(docs.sparkSession, benchmark, least_words):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(source: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches(source, chars=1_000_000):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array([not own for own in _search(texts, sent.value)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs

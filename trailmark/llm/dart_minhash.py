"""Near-duplicate classes by DartMinHash signatures, banded candidates and exact verification.

A text is a weighted set of word shingles. Darts are thrown by hash: for every shingle and
every dyadic band of weight they arrive along a rank axis as a Poisson process whose rate is
the width of the band, each with a weight coordinate and one of ``K`` signature coordinates. A
dart counts for a text if its weight coordinate lies below the text's weight of the shingle.
The earliest dart of each coordinate is the signature: two texts agree in a coordinate with a
probability equal to their weighted Jaccard similarity. A text of total weight w needs darts
only up to a rank near K ln K / w, so the work is about one dart per shingle instead of K hashes.

Whole process: identical texts are one node (md5 of the text). Nodes that share a band of
``ROWS`` coordinates are candidates. Each bucket first compares its members with one hub, its
smallest key, so a group of n copies costs n comparisons and not n * n; verified links give
components. Only buckets whose other members are then still in different components go on, without the hub, which has met
them all: they meet in bounded groups that yield links and no pairs, so no candidate goes untested. Hot hubs are the
small side of joins that Spark's skew handling can split; every grouping is pre-aggregated. Texts and members that
cannot match are left out before a shuffle by a broadcast bitmap of fixed size; an exact join follows.
Nothing is collected but counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.shared import batches, map_text, materialise, splitmix, text_key, unit, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 5
BANDS = 24  # at a similarity of 0.8 a pair shares no band with probability 7e-5
K = ROWS * BANDS
SEED = 0x5EEDDA27
CHUNK = 1000  # members of a bucket that meet in one group
BITS = 1 << 26  # size of the bitmap that is sent to all tasks: 8 MB

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the runs of ``size`` lower-case words, one per place; of all words if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed = word_hashes(words)
    width = min(size, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        total = total * _MULTIPLIER + hashed[i : len(words) - width + 1 + i]
    return splitmix(total)


def weighted(text: str, weighting: str = "set", size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights: 1 for ``set``, the number of copies for ``count``."""
    elements, copies = np.unique(shingles(text, size), return_counts=True)
    return elements, np.ones(len(elements)) if weighting == "set" else copies.astype(np.float64)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], k: int = K, seed: int = SEED) -> np.ndarray:
    """Rank of the earliest dart in each of ``k`` coordinates, one row per weighted set.

    A rank is a 53-bit random number, so equal ranks mean the same dart. Rows of empty sets
    are infinite. Sets with an unmet coordinate are thrown again up to twice the rank.
    """
    out = np.full((len(sets), k), np.inf)
    todo = [i for i, (elements, _) in enumerate(sets) if len(elements)]
    darts = k * (math.log(k) + 3)
    while todo:
        sizes = [len(sets[i][0]) for i in todo]
        doc = np.repeat(np.arange(len(todo)), sizes)
        elements = np.concatenate([sets[i][0] for i in todo])
        weights = np.concatenate([sets[i][1] for i in todo])
        limits = darts / np.bincount(doc, weights)
        found = np.full(len(todo) * k, np.inf)
        low, band = 0.0, 0
        while len(elements):
            high = 1.0 if band == 0 else 2.0 * low
            _throw(found, doc, elements, weights, limits, low, high, band, k, seed)
            low, band = high, band + 1
            more = weights > low
            doc, elements, weights = doc[more], elements[more], weights[more]
        found = found.reshape(-1, k)
        out[todo] = found
        todo = [i for i, row in zip(todo, found) if np.isinf(row).any()]
        darts *= 2
    return out


def _throw(found, doc, elements, weights, limits, low, high, band, k, seed) -> None:
    """Throw all darts of one weight band and keep the earliest ranks in ``found``."""
    start = (seed + (band + 1) * 0xD1B54A32D192ED03) % (1 << 64)
    state = splitmix(elements + np.uint64(start))
    rank = np.zeros(len(state))
    limit = limits[doc]
    while len(state):
        state = splitmix(state + _MULTIPLIER)
        rank = rank - np.log(unit(state)) / (high - low)
        alive = rank <= limit
        state, rank, doc, weights, limit = state[alive], rank[alive], doc[alive], weights[alive], limit[alive]
        place = splitmix(state ^ np.uint64(0xA0761D6478BD642F))
        inside = low + unit(place) * (high - low) <= weights
        coordinate = (splitmix(place + _MULTIPLIER) >> np.uint64(32)) % np.uint64(k)
        np.minimum.at(found, (doc * k + coordinate.astype(np.int64))[inside], rank[inside])


def band_keys(ranks: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One signed 64-bit key for each band of each signature."""
    bits = np.ascontiguousarray(ranks).view(np.uint64).reshape(len(ranks), bands, -1)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bits.shape[:2]).copy()
    for i in range(bits.shape[2]):
        keys = splitmix(keys * _MULTIPLIER + bits[:, :, i])
    return keys.view(np.int64)


def sketches(docs: DataFrame, weighting: str = "set") -> DataFrame:
    """``key``, ``id`` and the array ``bands`` of every row; texts without a word have no bands."""

    def work(texts: list[str]) -> dict[str, object]:
        sets = [weighted(t, weighting) for t in texts]
        keys = band_keys(signatures(sets))
        return {"bands": [row if len(s[0]) else [] for row, s in zip(keys, sets)]}

    rows = docs.select(text_key(F.col("text")).alias("key"), F.col("doc_id").alias("id"), "text")
    return map_text(rows, [("bands", T.ArrayType(T.LongType()))], work)


def _possible(rows: DataFrame, name: str, wanted: DataFrame) -> DataFrame:
    """Rows whose value ``name`` may be among those of ``wanted``: all that are, and a few that are not.

    The bitmap never exceeds ``BITS`` bits, whatever the data; a fuller one only lets more rows pass.
    """
    place = F.pmod(F.xxhash64(name), F.lit(BITS)) + 1
    bits = wanted.select(place.alias("place")).groupBy(F.bitmap_bucket_number("place").alias("_page"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    near = rows.withColumn("_page", F.bitmap_bucket_number(place)).join(F.broadcast(bits), "_page")
    return near.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)


def _shingle_table(docs: DataFrame, wanted: DataFrame, weighting: str) -> DataFrame:
    """``key``, ``shingles`` (distinct, with copies numbered if they count) of the wanted keys."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source):
            found = []
            for text in batch.column("text").to_pylist():
                elements, copies = weighted(text or "", weighting)
                if len(elements) and copies.max() > 1:  # the i-th copy is an element of its own: set overlap is then weighted
                    times = copies.astype(np.int64)
                    number = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    elements = splitmix(np.repeat(elements, times) + number.astype(np.uint64) * _MULTIPLIER)
                found.append(np.unique((elements >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(found, pa.list_(pa.int32()))], names=["key", "shingles"]
            )

    texts = _possible(docs.select(text_key(F.col("text")).alias("key"), "text"), "key", wanted)
    texts = texts.groupBy("key").agg(F.first("text").alias("text"))
    return texts.join(wanted, "key", "left_semi").mapInArrow(run, "key binary, shingles array<int>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a``, ``b`` whose sets reach the similarity."""
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    sized = both.where(F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y")))
    return sized.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b")


def _links_across(split: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between members of one bucket that are in different components so far.

    A bucket is dealt into chunks of about ``CHUNK`` members, and each two chunks meet in a group of their own, so
    a group is bounded. Within it the shared shingles of one member with all others are counted
    from an index of shingles, and members that have become linked in the group are not compared again;
    only links leave it.
    """

    def run(batch: pa.Table) -> pa.Table:
        keys, roots = batch.column("key").to_pylist(), batch.column("root").to_pylist()
        chunk = np.asarray(batch.column("chunk"))
        low, high = batch.column("i")[0].as_py(), batch.column("j")[0].as_py()
        found = [np.asarray(x.values) for x in batch.column("shingles")]
        parent = {r: r for r in roots}

        def root(r: bytes) -> bytes:
            while parent[r] != r:
                parent[r] = r = parent[parent[r]]
            return r

        sizes = np.array([len(x) for x in found])
        owner = np.repeat(np.arange(len(found)), sizes)
        every = np.concatenate(found) if found else np.empty(0, np.int32)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        pairs = []
        for n, own in enumerate(found):
            first, last = np.searchsorted(every, own), np.searchsorted(every, own, side="right")
            counts = last - first
            at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            shared = np.bincount(owner[at], minlength=len(found))
            alike = np.nonzero(shared >= similarity * (sizes + sizes[n] - shared))[0]
            for m in alike[alike < n].tolist():
                if (low == high or chunk[m] != chunk[n]) and root(roots[m]) != root(roots[n]):
                    parent[root(roots[m])] = root(roots[n])
                    pairs.append((keys[n], keys[m]))
        a, b = zip(*pairs) if pairs else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    dealt = split.withColumns({"chunk": F.pmod(F.xxhash64("key"), chunks).cast("int"), "other": F.explode(F.sequence(F.lit(0), chunks - 1))})
    dealt = dealt.join(sets, "key").select(
        "bucket", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "key", "root", "shingles"
    )
    return dealt.groupBy("bucket", "i", "j").applyInArrow(run, "a binary, b binary").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``key``, ``root`` (smallest key of the component) for every end of the edges ``a``, ``b``.

    Alternates large-star and small-star steps until no edge changes; each round is written to
    the shared folder, and only two numbers per round come to the driver.
    """
    edges = materialise(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lowest.select("u", F.col("m").alias("v"))).where("u != v")
        edges = materialise(small.distinct(), name)
        total = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (total.n, total.s) == mark:
            break
        mark = (total.n, total.s)
    roots = edges.select("v").distinct()
    return edges.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(
        roots.select(F.col("v").alias("key"), F.col("v").alias("root"))
    )


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, weighting: str = "set") -> DataFrame:
    """``id``, ``key``, ``root`` of every row of ``docs`` (columns doc_id, text): equal roots are one class.

    Rows with the same text are one class whatever their ids; a null text is an empty one. Texts
    without words are alike only if they are identical. Null and repeated ids are kept as they are.
    """
    rows = materialise(sketches(docs, weighting), "sketches")
    nodes = rows.groupBy("key").agg(F.first("bands").alias("bands"))
    members = nodes.select("key", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    shared = materialise(shared, "shared")
    members = materialise(_possible(members, "bucket", shared).join(shared, "bucket", "left_semi"), "buckets")
    hubs = materialise(members.groupBy("bucket").agg(F.min("key").alias("hub")), "hubs")
    spokes = materialise(members.join(hubs, "bucket").where("key != hub"), "spokes")

    pairs = spokes.select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = materialise(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = materialise(wanted, "wanted")
    sets = materialise(_shingle_table(docs, wanted, weighting), "shingles")
    links = materialise(_verified(pairs, sets, similarity), "links")

    found = components(links)
    split = spokes.join(found, "key", "left").select("bucket", "key", F.coalesce("root", "key").alias("root"))
    several = split.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    split = materialise(split.join(several.where("low != high").select("bucket", "n"), "bucket"), "split")
    if not split.isEmpty():
        links = materialise(links.unionByName(_links_across(split, sets, similarity)), "links")
        found = components(links)
    return rows.select("id", "key").join(found, "key", "left").select("id", "key", F.coalesce("root", "key").alias("root"))


def near_duplicate_classes(docs: DataFrame, similarity: float = SIMILARITY, weighting: str = "set") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest id of the class; null if it has none), class_size."""
    rows = near_duplicates(docs, similarity, weighting)
    rows = materialise(rows.select("id", "root"), "classes")
    classes = rows.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(classes, "root").select(F.col("id").alias("doc_id"), "class_id", "class_size")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, weighting: str = "set") -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row with the smallest id stays, nulls last.

    Ties of the id are decided by the text's key and then by all other columns; of identical rows one stays.
    """
    rows = near_duplicates(docs, similarity, weighting)
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("key").alias("key"))
    kept = rows.groupBy("root").agg(F.min(order).alias("best")).select("best.key", _id_text(F.col("best.id")).alias("id"))
    # Columns go by number, so none can clash. Each row is shuffled once: the join uses the window's partitions.
    names = {f"c{i}": f for i, f in enumerate(docs.schema.fields)}
    keyed = docs.toDF(*names).select(
        text_key(F.col(_of(names, "text"))).alias("key"), _id_text(F.col(_of(names, "doc_id"))).alias("id"), *names
    )
    sortable = [c for c, f in names.items() if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    first = F.row_number().over(Window.partitionBy("key", "id").orderBy(*sortable))
    one = keyed.withColumn("at", first).where("at = 1")
    return one.join(kept, ["key", "id"], "left_semi").select(*(F.col(c).alias(f.name) for c, f in names.items()))


def _of(names: dict[str, T.StructField], name: str) -> str:
    return next(c for c, f in names.items() if f.name == name)


def _id_text(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("string"), F.lit(""))

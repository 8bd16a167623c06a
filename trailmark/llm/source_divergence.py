"""How far the sources of a language differ in their words, by row accumulation over a term-major index.

Each language keeps the terms that at least ``LEAST_DOCS`` of its documents hold. A group (lang, source) gives
every kept term the share p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)); the unlikeness of two shares is
f(p, q) = floor((p - q)**2 / (p + q)). The sum of f over all kept terms, for every two sources of a language,
is found without a row per shared posting: each group scatters its terms through the postings of the index
into one dense array over its peers. Only terms that both groups hold are met that way, so what is scattered
is corrected for the zero baselines z (the share of a term that a group lacks):

    sum of f(p, q) = V * f(z, z') + sum over terms of g of (f(p, z') - f(z, z'))
                   + sum over terms of h of (f(z, q) - f(z, z'))
                   + sum over shared terms of (f(p, q) - f(p, z') - f(z, q) + f(z, z'))

The two middle sums need only how often each share occurs in a group. All numbers are integers.

Null text, lang and source count as empty; repeated rows are documents of their own; a group without terms has
shares all the same; a language that keeps no term gives pairs of value 0; no documents give no rows. Columns
other than lang, source and text are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.shared import batches, materialise

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LEAST_DOCS = 10
TOP_TERMS = 10
HELD = 150_000  # counters that a task holds before it sends them on
TILE = 256  # groups whose accumulators a task holds at once
ENTRIES = 100_000  # postings that are scattered at once

COUNTS = "lang string, source string, term string, n long, docs long"
PARTIAL = "lang string, peer int, other int, value long"


def _counted(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "n", "docs"]

    def sent() -> pa.RecordBatch:
        columns: list[list] = [[], [], [], [], []]
        for (lang, place), found in held.items():
            seen = holders[lang, place]
            columns[0] += [lang] * len(found)
            columns[1] += [place] * len(found)
            columns[2] += found.keys()
            columns[3] += found.values()
            columns[4] += [seen[term] for term in found]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)

    held: dict = defaultdict(Counter)
    holders: dict = defaultdict(Counter)
    for batch in batches(source):
        texts = pc.ascii_lower(batch.column("text"))
        for lang, place, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
            found = Counter(TERM.findall(text.as_py()))
            held[lang, place].update(found)
            holders[lang, place].update(found.keys())
        if sum(map(len, held.values())) > HELD:
            yield sent()
            held.clear()
            holders.clear()
    if held:
        yield sent()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); summed in each task before the shuffle."""
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return rows.mapInArrow(_counted, COUNTS).groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )


def kept_entries(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """The counts of kept terms, with the language's count ``n_lang``; ``first`` marks one row of each (lang, term)."""
    same = Window.partitionBy("lang", "term")
    return (
        counts.withColumns({
            "docs": F.sum("docs").over(same), "n_lang": F.sum("n").over(same),
            "first": F.col("source") == F.min("source").over(same),
        })
        .where(F.col("docs") >= least_docs)
        .drop("docs")
    )


def _quotient(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * (count + 2) / total), exact; null where ``total`` is 0."""
    wide = (count + 2).cast("decimal(20,0)") * F.lit(10**9).cast("decimal(10,0)")
    return 1 + F.when(total > 0, _quotient(wide, total.cast("decimal(20,0)")))


def unlikeness(p: Column, q: Column) -> Column:
    return _quotient((p - q) * (p - q), p + q)


def groups_of(docs: DataFrame, entries: DataFrame) -> DataFrame:
    """lang, source, peer (number in the language), peers, terms (V), total, total_lang, zero."""
    there = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = entries.groupBy("lang").agg(F.sum("n").alias("n_all"), F.sum(F.col("first").cast("long")).alias("terms"))
    in_lang = Window.partitionBy("lang")
    terms, zero = F.coalesce("terms", F.lit(0)), F.lit(0).cast("long")
    return (
        there.join(own, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .select(
            "lang", "source", (F.row_number().over(in_lang.orderBy("source")) - 1).alias("peer"),
            F.count("*").over(in_lang).cast("int").alias("peers"), terms.alias("terms"),
            (F.coalesce("n", zero) + 2 * terms).alias("total"), (F.coalesce("n_all", zero) + 2 * terms).alias("total_lang"),
        )
        .withColumn("zero", share(zero, F.col("total")))
    )


def _unlikeness(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def scatter(lengths: np.ndarray, peer: np.ndarray, p: np.ndarray, z: np.ndarray, rows: np.ndarray, first: int) -> None:
    """Add the corrected unlikeness of some terms to ``rows``, one dense array over the peers for each group from ``first``.

    A term has ``lengths[i]`` postings (peer, share, zero baseline), one after another; a peer has one at most.
    """
    starts = np.cumsum(lengths) - lengths
    term = np.repeat(np.arange(len(lengths)), lengths)
    for group in np.unique(peer[(peer >= first) & (peer < first + len(rows))]):
        mine = np.flatnonzero(peer == group)
        terms = term[mine]
        count = lengths[terms]
        ends = np.cumsum(count)
        at = np.repeat(starts[terms] - (ends - count), count) + np.arange(ends[-1])
        own, zero = np.repeat(p[mine], count), z[mine[0]]
        value = _unlikeness(own, p[at]) - _unlikeness(own, z[at]) - _unlikeness(zero, p[at]) + _unlikeness(zero, z[at])
        np.add.at(rows[group - first], peer[at], value)


def _accumulated(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by lang and tile, so one set of accumulators is held at a time."""
    schema = pa.schema([("lang", pa.string()), ("peer", pa.int32()), ("other", pa.int32()), ("value", pa.int64())])

    def sent() -> Iterator[pa.RecordBatch]:
        for i in range(len(rows)):
            other = np.flatnonzero(rows[i])
            if len(other):
                peer = np.full(len(other), held[1] * TILE + i)
                columns = [pa.array([held[0]] * len(other)), pa.array(peer, pa.int32()), pa.array(other, pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows[i][other])], schema=schema)

    held, rows = None, np.zeros((0, 0), np.int64)
    for batch in source:
        langs, tiles, peers = (batch.column(c).to_pylist() for c in ("lang", "tile", "peers"))
        postings = batch.column("postings")
        lengths = np.asarray(pc.list_value_length(postings)).astype(np.int64)
        start = 0
        while start < batch.num_rows:
            key, stop, size = (langs[start], tiles[start]), start, 0
            while stop < batch.num_rows and (langs[stop], tiles[stop]) == key and (stop == start or size < ENTRIES):
                size += lengths[stop]
                stop += 1
            if key != held:
                yield from sent()
                held, rows = key, np.zeros((min(TILE, peers[start] - key[1] * TILE), peers[start]), np.int64)
            flat = postings.slice(start, stop - start).flatten()
            columns = (np.asarray(flat.field(c)) for c in ("peer", "p", "z"))
            scatter(lengths[start:stop], *columns, rows, key[1] * TILE)
            start = stop
    yield from sent()


def shared_sums(scored: DataFrame) -> DataFrame:
    """lang, peer, other, value: sums over the terms that both groups hold, corrected for zero baselines."""
    index = scored.groupBy("lang", "peers", "term").agg(F.collect_list(F.struct("peer", "p", "z")).alias("postings"))
    tiles = F.array_distinct(F.transform("postings", lambda x: _quotient(x["peer"], F.lit(TILE)).cast("int")))
    tiled = index.select("lang", "peers", "postings", F.explode(tiles).alias("tile")).sortWithinPartitions("lang", "tile")
    return tiled.mapInArrow(_accumulated, PARTIAL).groupBy("lang", "peer", "other").agg(F.sum("value").alias("value"))


def _beyond(shares: Column, own_zero: Column, other_zero: Column) -> Column:
    """Sum of f(p, z') - f(z, z') over the terms of a group, from (share, number of terms)."""
    none = unlikeness(own_zero, other_zero)
    step = lambda total, x: total + x["terms"] * (unlikeness(x["p"], other_zero) - none)
    return F.aggregate(F.coalesce(shares, F.array().cast("array<struct<p:bigint,terms:bigint>>")), F.lit(0).cast("long"), step)


def pair_values(groups: DataFrame, scored: DataFrame) -> DataFrame:
    """lang, source, item, value for each two sources of a language: the size of the result, no more."""
    by_share = scored.groupBy("lang", "peer", "p").agg(F.count("*").alias("terms"))
    shares = by_share.groupBy("lang", "peer").agg(F.collect_list(F.struct("p", "terms")).alias("shares"))
    tile = _quotient(F.col("peer"), F.lit(TILE)).cast("int")
    tiles = F.sequence(F.lit(0), _quotient(F.col("peers") - 1, F.lit(TILE)).cast("int"))
    left = groups.select("lang", "source", "peer", "terms", "zero", F.explode(tiles).alias("tile"))
    right = groups.select("lang", tile.alias("tile"), F.col("source").alias("item"), F.col("peer").alias("other"), F.col("zero").alias("other_zero"))
    pairs = left.join(right, ["lang", "tile"]).where(F.col("peer") != F.col("other"))
    pairs = pairs.join(shares, ["lang", "peer"], "left").join(
        shares.select("lang", F.col("peer").alias("other"), F.col("shares").alias("other_shares")), ["lang", "other"], "left"
    )
    z, other = F.col("zero"), F.col("other_zero")
    outer = F.col("terms") * unlikeness(z, other) + _beyond(F.col("shares"), z, other) + _beyond(F.col("other_shares"), other, z)
    pairs = pairs.select("lang", "source", "peer", "item", "other", F.coalesce(outer, F.lit(0)).alias("outer"))
    return pairs.join(shared_sums(scored), ["lang", "peer", "other"], "left").select(
        "lang", "source", "item", (F.col("outer") + F.coalesce("value", F.lit(0))).alias("value")
    )


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: every other source (``pair``) and the ``top`` overused terms (``term``).

    Ranks go by value, largest first, then by the item's UTF-8 bytes.
    """
    entries = materialise(kept_entries(term_counts(docs), least_docs), "divergence_entries")
    groups = materialise(groups_of(docs, entries), "divergence_groups")
    scored = entries.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "peer", "peers", F.col("zero").alias("z"), share(F.col("n"), F.col("total")).alias("p"),
        share(F.col("n_lang"), F.col("total_lang")).alias("q"),
    )
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = scored.where(F.col("p") > F.col("q")).select(
        "lang", "source", F.col("term").alias("item"), unlikeness(F.col("p"), F.col("q")).alias("value")
    )
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)
    pairs = pair_values(groups, scored).withColumn("rank", F.row_number().over(by_value))
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs, "pair").unionAll(columns(terms, "term"))

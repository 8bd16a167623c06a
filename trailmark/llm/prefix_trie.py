"""The trie of all conversation prefixes, by collapsing whole sequences.

Every conversation is rebuilt (``rebuilt``), turned into the chain of its prefix keys, and identical ones are
collapsed into one weighted sequence, named after its smallest conv_id, with the list of conversations that end
there. A sequence that is a proper prefix of another is no leaf: an anti-join against all inner keys drops it. The
rest are sums over weighted prefixes, each summed in its task before the shuffle:

* A node's conv_id is the smallest sequence through it. Sequences through a descendant pass the node too, so
  the nodes that a sequence names are the end of its path, from some depth ``top`` on.
* Words of a subtree, counted once per conversation, are the words from that depth on of every sequence, times its weight;
  counted once per node, those from ``top`` on. ``saved_tokens`` is the difference.
* Below ``top`` a node's parent has the same name; only the nodes at ``top`` look their parent up.

Texts are replaced by digests of 16 bytes before conversations are put together: a task holds the
digests of one conversation, not its texts. Null role or text counts as empty, a null turn comes first, equal turns
go by their digest, repeated rows are turns of their own. Rows without a conv_id belong to no conversation.
No conversations give no nodes. Columns other than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.shared import materialise
from trailmark.operators.skew import salted_left_join

GROUP = 20  # conversations that share the turns of the first of them
MOST_SHARED = 4
BLOCK = 512  # neighbouring ids whose end lists are put together first
ROOT = ""

CHAINS = "conv_id long, end string, keys array<string>, rest array<long>"


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (digest, words): the first h turns of conversation c - c % 20, then its own after the first h."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    ordered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "words"))).alias("turns"))
    ordered = ordered.withColumn("turns", F.transform("turns", lambda x: F.struct(x["digest"].alias("digest"), x["words"].alias("words"))))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    own = ordered.withColumns({"h": h.cast("int"), "first": F.col("conv_id") - F.col("conv_id") % GROUP})
    heads = ordered.where(F.col("conv_id") % GROUP == 0).select(
        F.col("conv_id").alias("first"), F.slice("turns", 1, MOST_SHARED - 1).alias("head")
    )
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(heads, "first", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def _chained(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key of every prefix, each from the one before, and the words from its last turn on."""
    for batch in source:
        turns = batch.column("turns")
        lengths = np.asarray(pc.list_value_length(turns)).astype(np.int64)
        ends = np.cumsum(lengths)
        flat = turns.flatten()
        words = np.asarray(flat.field("words"))
        until = np.concatenate([[0], np.cumsum(words)])
        rest = np.repeat(until[ends], lengths) - until[:-1]
        digests, keys, last = flat.field("digest").to_pylist(), [], []
        for start, end in zip((ends - lengths).tolist(), ends.tolist()):
            key = ROOT
            for digest in digests[start:end]:
                key = hashlib.md5((key + digest).encode()).hexdigest()
                keys.append(key)
            last.append(key)
        offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(keys, pa.string()), pa.array(rest, pa.int64()))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), pa.array(last, pa.string()), *lists], names=["conv_id", "end", "keys", "rest"]
        )


def sequences(chains: DataFrame) -> DataFrame:
    """seq (smallest conv_id), weight (conversations), end, keys, rest of every distinct sequence."""
    counted = chains.groupBy("end").agg(F.min("conv_id").alias("seq"), F.count("*").alias("weight")).select("seq", "weight")
    return counted.join(chains.withColumnRenamed("conv_id", "seq"), "seq")


def leaves(seqs: DataFrame) -> DataFrame:
    """Sequences that are no proper prefix of another."""
    path = F.concat(F.array(F.lit(ROOT)), "keys")
    inner = seqs.select(F.explode(F.slice(path, F.lit(1), F.size("keys"))).alias("end")).distinct()
    return seqs.join(inner, "end", "left_anti")


def prefixes(seqs: DataFrame) -> DataFrame:
    """A row for each prefix of each sequence: its plain columns, ``rests`` (words from each depth on), depth, key, parent, rest."""
    plain = [c for c in seqs.columns if c not in ("end", "keys", "rest")]
    paths = seqs.select(
        *plain, F.concat(F.array(F.lit(ROOT)), "keys").alias("path"),
        F.concat(F.array(F.coalesce(F.get("rest", F.lit(0)), F.lit(0))), "rest").alias("rests"),
    )
    step = lambda key, i: F.struct(key.alias("key"), F.get("path", i - 1).alias("parent"), F.get("rests", i).alias("rest"))
    return paths.select(*plain, "rests", F.posexplode(F.transform("path", step)).alias("depth", "at")).select(
        *plain, "rests", F.col("depth").cast("long").alias("depth"), "at.key", "at.parent", "at.rest"
    )


def _hashed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the parts of each end list as they stream by in order."""

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    held = digest = None
    for batch in source:
        for key, ids in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist()):
            if key == held:
                digest.update(b",")
            else:
                if digest is not None:
                    yield sent()
                held, digest = key, hashlib.sha256()
            digest.update(ids.encode())
    if digest is not None:
        yield sent()


def end_hashes(chains: DataFrame) -> DataFrame:
    """key, ends_sha256. Lists are joined in blocks of neighbouring ids first; no list is held as a whole."""
    parts = chains.groupBy("end", (F.col("conv_id") - F.pmod("conv_id", F.lit(BLOCK))).alias("block"))
    listed = parts.agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return listed.repartition("end").sortWithinPartitions("end", "block").mapInArrow(_hashed, "key string, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, one row a node."""
    chains = materialise(rebuilt(conversations).mapInArrow(_chained, CHAINS), "trie_chains")
    seqs = materialise(sequences(chains), "trie_sequences")
    nodes = materialise(
        prefixes(seqs).groupBy("key", "parent", "depth").agg(
            F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum(F.col("weight") * F.col("rest")).alias("read")
        ),
        "trie_nodes",
    )
    tops = nodes.groupBy(F.col("conv_id").alias("seq")).agg(F.min("depth").alias("top"))
    marked = seqs.join(leaves(seqs).select("seq", F.lit(1).alias("leaf")), "seq", "left").join(tops, "seq", "left")
    at_top = F.coalesce(F.col("depth") == F.col("top"), F.lit(False))
    once = F.when(F.col("depth") >= F.col("top"), F.col("rest")).otherwise(F.get("rests", F.col("top").cast("int")))
    below = prefixes(marked).groupBy("key").agg(
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.sum(F.coalesce(once, F.lit(0))).alias("stored"),
        F.max(at_top).alias("at_top"),
    )
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    full = nodes.join(below, "key").join(children, "key", "left").join(end_hashes(chains), "key", "left")
    full = materialise(full, "trie_full")
    names = nodes.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    found = salted_left_join(full.where(F.col("at_top") & F.col("parent").isNotNull()), names, "parent", "above", ["key"])
    rest = full.where(~F.col("at_top") | F.col("parent").isNull()).withColumn(
        "parent_conv_id", F.when(F.col("parent").isNotNull(), F.col("conv_id"))
    )
    return found.drop("above").unionByName(rest).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        (F.col("read") - F.col("stored")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )

"""The selection manifest as a document, the campaign's scope and the identity that follows from both.

Records stay a table. What stands for them in a hash is the root of a tree over their canonical JSON in manifest
order, so no task ever holds the list; header, scope and run id are hashes of small canonical JSON objects.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.identity import canonical_json, run_id, sha256_text
from trailmark.operators.selection import MANIFEST_COLUMNS
from trailmark.params import ManifestHeader

FAN_OUT = 1024
LEVELS = 3  # below the root, which is hashed from the last level: FAN_OUT children at most up to 10 ** 12 rows


def ordered_digest(rows: DataFrame, place: str, text: Column, fan_out: int = FAN_OUT) -> DataFrame:
    """One row (digest, row_count) over texts in the order of their places, which count from 1.

    Leaves are SHA-256 of the texts; a node is SHA-256 of its children's hex digests, one after another. Places
    alone decide which leaves share a node, so the digest does not depend on partitions. NULL is hashed as
    an empty text; repeated places stand in the order of their hashes. An empty table has the digest of the empty text.
    """
    nodes = rows.select((F.col(place) - 1).alias("at"), sha256_text(F.coalesce(text, F.lit(""))).alias("node"), F.lit(1).cast("bigint").alias("n"))
    for _ in range(LEVELS):
        nodes = _up(nodes, fan_out)
    return nodes.agg(_joined("at", "node").alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("row_count"))


def _joined(at: str, node: str) -> Column:
    children = F.array_sort(F.collect_list(F.struct(at, node)))
    return sha256_text(F.array_join(F.transform(children, lambda c: c[node]), ""))


def _up(nodes: DataFrame, fan_out: int) -> DataFrame:
    parent = F.expr(f"at div {fan_out}").alias("up")
    grouped = nodes.withColumn("up", parent).groupBy("up").agg(_joined("at", "node").alias("node"), F.sum("n").alias("n"))
    return grouped.withColumnRenamed("up", "at")


def record_json() -> Column:
    """Canonical JSON of one manifest record."""
    return canonical_json(F.struct(*sorted(MANIFEST_COLUMNS)))


def manifest_header(manifest: DataFrame, header: ManifestHeader) -> DataFrame:
    """One row (header, manifest_hash): the header as canonical JSON, with size and digest of the records."""
    text = lambda value: F.lit(value).cast("string")
    dataset = {
        "id": text(header.dataset_id), "observed_fingerprint": text(header.observed_fingerprint),
        "requested_revision": text(header.requested_revision), "resolved_revision": text(header.resolved_revision),
        "selection_method": text(header.selection_method), "selection_seed": F.lit(header.selection_seed), "split": text(header.split),
    }
    fields = {
        "schema_version": F.lit(1), "study_protocol_id": text(header.study_protocol_id), "config_hash": text(header.config_hash),
        "dataset": F.struct(*[dataset[n].alias(n) for n in sorted(dataset)]),
        "selection_size": F.col("row_count"), "records_digest": F.col("digest"),
    }
    body = canonical_json(F.struct(*[fields[n].alias(n) for n in sorted(fields)]))
    digest = ordered_digest(manifest, "manifest_ordinal", record_json())
    return digest.select(body.alias("header")).select("header", sha256_text(F.col("header")).alias("manifest_hash"))


def campaign_identity(
    manifest: DataFrame, header: ManifestHeader, seeds: Sequence[int], positions: Sequence[int]
) -> DataFrame:
    """One row (manifest_hash, config_hash, campaign_scope_hash, run_id) of the full campaign, never of a stage.

    The scope is the manifest's hash, the ids and source indexes in manifest order, the seeds and the declared
    positions, in the order given.
    """
    if not seeds or not positions:
        raise ValueError("a campaign needs seeds and positions")
    ids = ordered_digest(manifest, "manifest_ordinal", F.col("problem_id")).select(F.col("digest").alias("problem_ids"))
    indexes = ordered_digest(manifest, "manifest_ordinal", F.col("source_index").cast("string")).select(F.col("digest").alias("source_indexes"))
    parts = [manifest_header(manifest, header).select("manifest_hash"), ids, indexes]
    row = parts[0]
    for part in parts[1:]:
        row = row.unionByName(part, allowMissingColumns=True)
    row = row.agg(*[F.max(c).alias(c) for c in row.columns])
    numbers = lambda values: F.array(*[F.lit(int(v)) for v in values])
    scope = F.struct(
        numbers(positions).alias("checkpoint_token_positions"), F.col("problem_ids"), numbers(seeds).alias("rollout_seeds"),
        F.col("manifest_hash").alias("selection_manifest_sha256"), F.col("source_indexes"),
    )
    named = row.select("manifest_hash", F.lit(header.config_hash).alias("config_hash"), sha256_text(canonical_json(scope)).alias("campaign_scope_hash"))
    return named.withColumn("run_id", run_id(F.col("manifest_hash"), F.col("config_hash"), F.col("campaign_scope_hash")))

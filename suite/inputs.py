"""Queries over sources, sinks, identities, strict reads and planning inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import query
from suite.views import EOS, MANIFEST_HASH, POSITIONS, SEEDS, SELECTION_SEED
from trailmark.functions import identity, strict
from trailmark.functions.labels import reason_codes
from trailmark.functions.receipts import failure_payload, memory_delta
from trailmark.functions.tokens import (
    context_limit_exceeded, preserves_prefix, strip_prefix, termination_status,
)
from trailmark.operators import manifest_out, planning, selection, stages
from trailmark.operators.eligibility import read_eligibility
from trailmark.operators.selection import MANIFEST_COLUMNS
from trailmark.params import ManifestHeader
from trailmark.plans.analysis import report_rows
from trailmark.session import scratch_path
from trailmark.sinks import writers
from trailmark.sources import inputs, receipts
from trailmark.sources.documents import parse_objects

# --- receipts as JSON documents ----------------------------------------------


def _document_receipts(fx):
    """One base-rollout receipt per document, as nested JSON columns."""
    doc = fx.table("documents")
    status = F.when(F.col("doc_id") % 9 == 0, "FAILED").otherwise("COMPLETED")
    done = status == "COMPLETED"
    return doc.select(
        F.lit(1).alias("schema_version"),
        F.concat(F.lit("r-"), F.col("doc_id").cast("string")).alias("rollout_id"),
        F.concat(F.lit("p-"), F.col("lang")).alias("problem_id"),
        F.col("text").alias("problem"),
        F.col("doc_id").alias("rollout_seed"),
        status.alias("status"),
        F.when(done, F.struct(
            F.col("n_chars").alias("generated_token_count"),
            (F.col("n_chars") / 100).alias("elapsed_seconds"),
            F.lit("EOS").alias("termination_status"),
            F.col("text").alias("generated_text"),
            F.struct(F.col("n_chars").alias("peak_allocated_bytes"), (F.col("n_chars") * 2).alias("peak_reserved_bytes")).alias("memory_after"),
        )).alias("generation"),
        F.when(done, F.struct(
            F.when(F.col("doc_id") % 2 == 0, "CORRECT").otherwise("INCORRECT").alias("status"),
            (F.col("doc_id") % 2 == 0).alias("correct"),
        )).alias("final_evaluation"),
        F.when(~done, F.struct(F.lit("OutOfMemoryError").alias("error_type"), F.lit(True).alias("cuda_oom"))).alias("failure"),
    )


_RECEIPT_ORACLE = """
SELECT 'r-' || CAST(doc_id AS VARCHAR) AS rollout_id, 'p-' || lang AS problem_id, doc_id AS rollout_seed,
  CASE WHEN doc_id % 9 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  CASE WHEN doc_id % 9 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'CORRECT' ELSE 'INCORRECT' END END AS final_status,
  CASE WHEN doc_id % 9 <> 0 THEN doc_id % 2 = 0 END AS final_correct, doc_id % 9 <> 0 AS generation_recorded,
  CASE WHEN doc_id % 9 <> 0 THEN n_chars END AS generated_token_count,
  CASE WHEN doc_id % 9 <> 0 THEN n_chars / 100 END AS elapsed_seconds,
  CASE WHEN doc_id % 9 <> 0 THEN 'EOS' END AS termination_status,
  CASE WHEN doc_id % 9 <> 0 THEN n_chars END AS peak_allocated_bytes,
  CASE WHEN doc_id % 9 <> 0 THEN n_chars * 2 END AS peak_reserved_bytes,
  CASE WHEN doc_id % 9 = 0 THEN 'OutOfMemoryError' END AS error_type, doc_id % 9 = 0 AS cuda_oom,
  TRUE AS eligible, 'NOT_DECLARED_LEGACY_ELIGIBLE' AS eligibility_status, '' AS reason_codes FROM documents"""


@query("read_receipts", _RECEIPT_ORACLE)
def _read_receipts(fx):
    """Written as one JSON file per receipt, read back and typed."""
    path = scratch_path(fx.spark, "receipts")
    writers.write_json_files(_document_receipts(fx), path)
    typed = receipts.typed_rollouts(receipts.read_receipts(fx.spark, path))
    return typed.withColumn("reason_codes", F.array_join("reason_codes", ","))


@query("reject_receipts", """
SELECT CASE doc_id % 4 WHEN 0 THEN 'MALFORMED_JSON' WHEN 1 THEN 'NOT_AN_OBJECT' WHEN 2 THEN 'BLANK_LINE' END AS problem,
  CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1""")
def _reject_receipts(fx):
    good = F.to_json(F.struct("doc_id", "text"))
    text = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(good, F.lit("}")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("["), good, F.lit("]")))
        .when(F.col("doc_id") % 4 == 2, F.lit("  "))
        .otherwise(good)
    )
    lines = fx.table("documents").select(F.col("source").alias("file_name"), text.alias("value"))
    return parse_objects(lines, strict_mode=False).groupBy("problem").agg(F.count("*").alias("n"))


@query("redact_report", """
SELECT 'accuracy' AS section, '' AS key, metric, CAST(n AS VARCHAR) AS value FROM (
  SELECT unnest(['completed','excluded','eligible','evaluable','correct','incorrect','non_evaluable','errors','malformed']) AS metric,
    unnest([c, 0, c, c, k, c - k, 0, 0, 0]) AS n FROM (
    SELECT count(*) AS c, count(*) FILTER (WHERE doc_id % 2 = 0) AS k FROM documents WHERE doc_id % 9 <> 0) s) t
UNION ALL SELECT 'statuses', CASE WHEN doc_id % 9 = 0 THEN 'FAILED' ELSE 'COMPLETED' END, 'n', CAST(count(*) AS VARCHAR) FROM documents GROUP BY 2""")
def _redact_report(fx):
    """Report rows from receipts that carry private texts: only keys and measures remain."""
    path = scratch_path(fx.spark, "landed")
    raw = _document_receipts(fx).select(F.lit("f").alias("file_name"), F.to_json(F.struct("*")).alias("value"))
    receipts.land_receipts(receipts.typed_rollouts(parse_objects(raw, True)), path)
    typed = fx.spark.read.parquet(path)
    return report_rows({
        "accuracy": stages.final_accuracy(typed).drop("accuracy"),
        "statuses": stages.receipt_status_counts(typed),
    })


# --- ledger ------------------------------------------------------------------


def _written_ledger(fx):
    path = scratch_path(fx.spark, "ledger")
    events = fx.view("fx_ledger").withColumn("payload", F.struct(F.lit("fixture").alias("reason")))
    writers.append_ledger(events, path)
    return inputs.read_ledger(fx.spark, path)


query("read_ledger", "SELECT seq, intent_id, event_type FROM fx_ledger")(
    lambda fx: _written_ledger(fx).select("seq", "intent_id", "event_type"))


@query("read_ledger_physical", "SELECT row_number() OVER (ORDER BY seq) AS seq, row_number() OVER (ORDER BY seq) AS line_number, intent_id, event_type FROM fx_ledger")
def physical_ledger(fx):
    """Events written one after another without a seq; the lines' places order them."""
    path = scratch_path(fx.spark, "plain-ledger")
    events = fx.view("fx_ledger").withColumn("payload", F.struct(F.lit("fixture").alias("reason")))
    events.coalesce(1).sortWithinPartitions("seq").select("event_type", "intent_id", "payload").write.json(path)
    return inputs.read_ledger(fx.spark, path, physical_order=True).select("seq", "line_number", "intent_id", "event_type")


query("append_ledger", """
SELECT event_type, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS stamped, 'fixture' AS reason FROM fx_ledger GROUP BY 1""")(
    lambda fx: _written_ledger(fx).groupBy("event_type").agg(
        F.count("*").alias("n"), F.count("timestamp_utc").alias("stamped"),
        F.max(F.try_variant_get("payload", "$.reason", "string")).alias("reason")))

# --- problems, manifest, contract --------------------------------------------


def _problems(fx):
    return fx.view("fx_problems")


query("read_problems", """
SELECT CAST(doc_id AS VARCHAR) AS problem_id, doc_id AS source_index, length(text) AS problem_length,
  source AS reference_answer, lang AS subject, n_chars AS level FROM documents""")(
    lambda fx: inputs.read_problems(
        fx.table("documents"), "doc_id", "text", "source", "doc_id", "lang", "n_chars"
    ).select("problem_id", "source_index", F.length("problem").cast("bigint").alias("problem_length"),
             "reference_answer", "subject", "level"))

query("validate_problems", """
SELECT source_index, CASE source_index % 7 WHEN 0 THEN 'INVALID_PROBLEM_ID' WHEN 1 THEN 'INVALID_PROBLEM' WHEN 2 THEN 'INVALID_REFERENCE_ANSWER' END AS violation
FROM fx_problems""")(
    lambda fx: selection.validate_problems(_problems(fx).withColumns({
        "problem_id": F.when(F.col("source_index") % 7 == 0, " ").otherwise(F.col("problem_id")),
        "problem": F.when(F.col("source_index") % 7 != 1, F.col("problem")),
        "reference_answer": F.when(F.col("source_index") % 7 == 2, "").otherwise(F.col("reference_answer")),
    })).select("source_index", "violation"))

MANIFEST_SIZE = 150
_MANIFEST = f"""manifest AS (
  SELECT row_number() OVER (ORDER BY rank, source_index) AS manifest_ordinal, problem_id, source_index, rank AS selection_rank,
    sha256(problem) AS problem_sha256, sha256(reference_answer) AS reference_answer_sha256,
    sha256('{{"level":' || coalesce(CAST(level AS VARCHAR), 'null') || ',"subject":"' || subject || '"}}') AS metadata_sha256
  FROM (SELECT *, sha256('{SELECTION_SEED}' || chr(0) || problem_id || chr(0) || CAST(source_index AS VARCHAR)) AS rank FROM fx_problems) r
  ORDER BY rank, source_index LIMIT {MANIFEST_SIZE})"""


def _manifest(fx):
    return selection.selection_manifest(_problems(fx), SELECTION_SEED, MANIFEST_SIZE)


query("selection_rank", f"""
SELECT problem_id, sha256('{SELECTION_SEED}' || chr(0) || problem_id || chr(0) || CAST(source_index AS VARCHAR)) AS selection_rank FROM fx_problems""")(
    lambda fx: selection.selection_rank(_problems(fx), SELECTION_SEED).select("problem_id", "selection_rank"))

query("selection_manifest", f"WITH {_MANIFEST} SELECT * FROM manifest")(_manifest)

query("manifest_ordinal", f"WITH {_MANIFEST} SELECT manifest_ordinal, problem_id FROM manifest")(
    lambda fx: _manifest(fx).select("manifest_ordinal", "problem_id"))

query("bounded_scope", f"WITH {_MANIFEST} SELECT manifest_ordinal, problem_id FROM manifest WHERE manifest_ordinal <= 40")(
    lambda fx: selection.bounded_scope(_manifest(fx), 40).select("manifest_ordinal", "problem_id"))

query("selection_size_check", f"""
SELECT CAST({MANIFEST_SIZE} AS BIGINT) AS requested, CAST(count(*) AS BIGINT) AS available, count(*) >= {MANIFEST_SIZE} AS is_valid FROM fx_problems""")(
    lambda fx: selection.checked_selection_size(_problems(fx), MANIFEST_SIZE))


@query("read_manifest", f"WITH {_MANIFEST} SELECT * FROM manifest")
def _read_manifest(fx):
    """The manifest written as its single nested document and read back."""
    path = scratch_path(fx.spark, "manifest")
    columns = ("problem_id", "source_index", "selection_rank", *selection.HASHES)
    rows = F.array_sort(F.collect_list(F.struct("manifest_ordinal", *columns)))
    document = _manifest(fx).agg(rows.alias("rows")).select(
        F.lit(1).alias("schema_version"), F.transform("rows", lambda r: r.dropFields("manifest_ordinal")).alias("records"))
    document.write.json(path)
    return inputs.manifest_records(inputs.read_document(fx.spark, path))


HEADER = ManifestHeader("protocol-1", "c" * 64, "data/set", "train", "rev-1", "hash-rank", SELECTION_SEED)
_RECORD = " || ',' || ".join(
    f"""'"{n}":' || {"CAST(source_index AS VARCHAR)" if n == "source_index" else f"'{chr(34)}' || {n} || '{chr(34)}'"}""" for n in sorted(MANIFEST_COLUMNS))


def _tree(name: str, text: str) -> str:
    """CTEs whose last, ``name``, is the digest of the manifest's texts in order, 1,024 children to a node."""
    fold = lambda to, of: f"{to} AS (SELECT place // 1024 AS place, sha256(string_agg(node, '' ORDER BY place)) AS node FROM {of} GROUP BY 1)"
    return f"""{name}_0 AS (SELECT manifest_ordinal - 1 AS place, sha256({text}) AS node FROM manifest),
{fold(name + '_1', name + '_0')}, {fold(name + '_2', name + '_1')}, {fold(name + '_3', name + '_2')},
{name} AS (SELECT sha256(string_agg(node, '' ORDER BY place)) AS digest FROM {name}_3)"""


_HEADER_CTE = f"""{_tree('records', f"'{{' || {_RECORD} || '}}'")}, head AS (
  SELECT '{{"config_hash":"{HEADER.config_hash}","dataset":{{"id":"data/set","observed_fingerprint":null,"requested_revision":null,"resolved_revision":"rev-1","selection_method":"hash-rank","selection_seed":{SELECTION_SEED},"split":"train"}},"records_digest":"'
    || digest || '","schema_version":1,"selection_size":' || (SELECT CAST(count(*) AS VARCHAR) FROM manifest) || ',"study_protocol_id":"protocol-1"}}' AS header FROM records)"""

query("manifest_document", f"WITH {_MANIFEST}, {_HEADER_CTE} SELECT header, sha256(header) AS manifest_hash FROM head")(
    lambda fx: manifest_out.manifest_header(_manifest(fx), HEADER))

query("campaign_identity", f"""
WITH {_MANIFEST}, {_HEADER_CTE}, {_tree('ids', 'problem_id')}, {_tree('indexes', 'CAST(source_index AS VARCHAR)')}, scope AS (
  SELECT sha256(header) AS manifest_hash, sha256('{{"checkpoint_token_positions":[{','.join(map(str, POSITIONS))}],"problem_ids":"' || (SELECT digest FROM ids)
    || '","rollout_seeds":[{','.join(map(str, SEEDS))}],"selection_manifest_sha256":"' || sha256(header) || '","source_indexes":"' || (SELECT digest FROM indexes) || '"}}') AS campaign_scope_hash FROM head)
SELECT manifest_hash, '{HEADER.config_hash}' AS config_hash, campaign_scope_hash, 'run-' || left(sha256('{{"campaign_scope_hash":"' || campaign_scope_hash
  || '","config_hash":"{HEADER.config_hash}","manifest_hash":"' || manifest_hash || '"}}'), 20) AS run_id FROM scope""")(
    lambda fx: manifest_out.campaign_identity(_manifest(fx), HEADER, SEEDS, POSITIONS))


@query("write_manifest", f"WITH {_MANIFEST} SELECT *, CAST(NULL AS VARCHAR) AS field FROM manifest UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'dataset.split'")
def _write_manifest(fx):
    """Written twice and read back, with the header fields that differ from a configuration of another split."""
    path = scratch_path(fx.spark, "manifest")
    assert writers.write_manifest(_manifest(fx), HEADER, path) == writers.write_manifest(_manifest(fx), HEADER, path)
    document, records = inputs.read_manifest(fx.spark, path)
    expected = {"config_hash": HEADER.config_hash, "dataset.id": "data/set", "dataset.split": "test", "dataset.selection_seed": SELECTION_SEED}
    return records.unionByName(inputs.manifest_header_violations(document, expected, records), allowMissingColumns=True)


@query("manifest_header_violations", """
SELECT field, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'config_hash' AS field FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'dataset.id' FROM customer WHERE c_mktsegment <> 'BUILDING'
  UNION ALL SELECT 'dataset.resolved_revision' FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT 'selection_size' FROM customer WHERE c_custkey % 7 <> 2) v GROUP BY 1""")
def _manifest_header_violations(fx):
    """One document per customer, with two records each."""
    key = F.col("c_custkey")
    document = F.struct(
        F.when(key % 3 == 0, "other").otherwise("config").alias("config_hash"),
        F.struct(F.col("c_mktsegment").alias("id"), F.when(key % 5 != 0, F.col("c_name")).otherwise("").alias("resolved_revision")).alias("dataset"),
        (key % 7).alias("selection_size"), F.array(F.struct(key.alias("source_index")), F.struct(key.alias("source_index"))).alias("records"))
    documents = fx.table("customer").select(F.lit("f").alias("file_name"), F.parse_json(F.to_json(document)).alias("record"))
    found = inputs.manifest_header_violations(documents, {"config_hash": "config", "dataset.id": "BUILDING"})
    return found.groupBy("field").agg(F.count("*").alias("n"))


@query("verify_manifest", f"""
WITH {_MANIFEST} SELECT CASE WHEN manifest_ordinal % 5 = 0 THEN source_index + 1000000 ELSE source_index END AS source_index,
  CASE WHEN manifest_ordinal % 5 = 0 THEN 'SOURCE_INDEX_OUT_OF_RANGE' ELSE 'MISMATCH:problem_sha256' END AS violation
FROM manifest WHERE manifest_ordinal % 5 = 0 OR manifest_ordinal % 7 = 0""")
def _verify_manifest(fx):
    tampered = _manifest(fx).withColumns({
        "problem_sha256": F.when(F.col("manifest_ordinal") % 7 == 0, F.lit("0")).otherwise(F.col("problem_sha256")),
        "source_index": F.when(F.col("manifest_ordinal") % 5 == 0, F.col("source_index") + 1000000).otherwise(F.col("source_index")),
    })
    return selection.verify_manifest(tampered, _problems(fx))


@query("verify_rank_order", f"""
WITH {_MANIFEST}, swapped AS (SELECT CASE WHEN manifest_ordinal = 3 THEN 4 WHEN manifest_ordinal = 4 THEN 3 ELSE manifest_ordinal END AS o, problem_id FROM manifest)
SELECT CAST(m.manifest_ordinal AS BIGINT) AS manifest_ordinal, s.problem_id AS stored_problem_id, m.problem_id AS recomputed_problem_id
FROM manifest m JOIN swapped s ON m.manifest_ordinal = s.o WHERE m.problem_id <> s.problem_id""")
def _verify_rank_order(fx):
    ordinal = F.col("manifest_ordinal")
    swapped = _manifest(fx).withColumn(
        "manifest_ordinal", F.when(ordinal == 3, 4).when(ordinal == 4, 3).otherwise(ordinal).cast("bigint"))
    return selection.verify_rank_order(swapped, _problems(fx), SELECTION_SEED, MANIFEST_SIZE)


@query("manifest_record_violations", """
SELECT lang AS problem_id, CAST(count(*) AS BIGINT) AS rows, 'DUPLICATE_PROBLEM_ID' AS violation FROM documents GROUP BY 1 HAVING count(*) > 1""")
def _manifest_record_violations(fx):
    rows = fx.table("documents").select(F.col("lang").alias("problem_id"), F.col("doc_id").alias("source_index"))
    return inputs.manifest_record_violations(rows).select("problem_id", "rows", "violation")


@query("read_runtime_contract", """
SELECT 'RECORDED' AS status, CAST(sum(p_size) AS BIGINT) AS allocated_bytes, CAST(NULL AS BIGINT) AS reserved_bytes,
  CAST(max(p_partkey) AS BIGINT) AS peak_allocated_bytes, CAST(count(*) AS BIGINT) AS peak_reserved_bytes FROM part""")
def _read_runtime_contract(fx):
    path = scratch_path(fx.spark, "contract")
    memory = fx.table("part").agg(
        F.sum("p_size").alias("allocated_bytes"), (-F.count("*")).alias("reserved_bytes"),
        F.max("p_partkey").alias("peak_allocated_bytes"), F.count("*").alias("peak_reserved_bytes"))
    memory.select(F.struct(F.struct("*").alias("memory_after_load")).alias("runtime")).write.json(path)
    return inputs.read_runtime_contract(fx.spark, path)


@query("artifact_disk_usage", """
SELECT CAST(sum(octet_length(encode(line)) + 1) AS BIGINT) AS bytes FROM (
  SELECT replace(replace(text, chr(10), ' '), chr(13), ' ') AS line FROM documents) d""")
def _artifact_disk_usage(fx):
    """Texts written one per line, a folder for each language: their bytes and one for each line's end."""
    path = scratch_path(fx.spark, "usage")
    line = F.translate("text", "\n\r", "  ").alias("value")
    fx.table("documents").select("lang", line).write.partitionBy("lang").text(path)
    return inputs.artifact_disk_usage(fx.spark, path).select("bytes")

# --- sinks -------------------------------------------------------------------


def _append_inputs(fx):
    orders = fx.table("orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    existing = orders.where(F.col("o_custkey") % 2 == 0)
    changed = F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus"))
    return orders.withColumn("o_orderstatus", changed), existing


query("append_once", """
SELECT o_orderkey AS id, CASE WHEN o_custkey % 2 <> 0 THEN 'APPEND' WHEN o_orderkey % 5 = 0 THEN 'CONFLICT' ELSE 'UNCHANGED' END AS status FROM orders""")(
    lambda fx: writers.append_once_status(*_append_inputs(fx), "o_orderkey"))


@query("append_once_store", "SELECT o_orderkey, o_orderstatus, o_custkey FROM orders")
def _append_once_store(fx):
    """A first partial batch, then everything: earlier records are kept, none is doubled."""
    path = scratch_path(fx.spark, "store")
    orders = fx.table("orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    writers.append_once(orders.where(F.col("o_custkey") % 2 == 0), path, "o_orderkey")
    writers.append_once(orders.unionByName(orders.where(F.col("o_orderkey") % 97 == 0)), path, "o_orderkey")
    return writers.read_store(fx.spark, path)


@query("write_summary", """
SELECT 'statuses' AS section, status AS key, 'n' AS metric, CAST(count(*) AS VARCHAR) AS value FROM fx_rollouts GROUP BY status
UNION ALL SELECT 'forced_statuses', status, 'n', CAST(count(*) AS VARCHAR) FROM fx_checkpoints GROUP BY status""")
def _write_summary(fx):
    root = scratch_path(fx.spark, "reports")
    report = report_rows({
        "statuses": stages.receipt_status_counts(fx.rollouts),
        "forced_statuses": stages.receipt_status_counts(fx.checkpoints),
    })
    first = writers.write_summary(report, root)
    second = writers.write_summary(report.orderBy(F.desc("key")), root)
    assert first == second
    return fx.spark.read.schema(report.schema).parquet(first)


# --- hashes and identities ---------------------------------------------------

query("content_hashes", """
SELECT problem_id, sha256(problem) AS problem_sha256, sha256(reference_answer) AS reference_answer_sha256,
  sha256('{"level":' || coalesce(CAST(level AS VARCHAR), 'null') || ',"subject":"' || subject || '"}') AS metadata_sha256 FROM fx_problems""")(
    lambda fx: selection.content_hashes(_problems(fx)).select("problem_id", *selection.HASHES))

query("canonical_json_hash", """
SELECT c_custkey, sha256('{"key":' || CAST(c_custkey AS VARCHAR) || ',"name":"' || c_name || '","nation":' || CAST(c_nationkey AS VARCHAR)
  || ',"segment":' || CASE WHEN c_custkey % 10 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || '}') AS hash FROM customer""")(
    lambda fx: fx.table("customer").select("c_custkey", identity.canonical_json_hash(F.struct(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("segment"))).alias("hash")))

query("token_hash", """
SELECT doc_id, CAST(len(token_ids) AS INTEGER) AS token_count, sha256('[' || array_to_string(token_ids, ',') || ']') AS token_sha256 FROM fx_trajectories""")(
    lambda fx: fx.trajectories.select(
        "doc_id", F.size("token_ids").alias("token_count"), identity.token_hash(F.col("token_ids")).alias("token_sha256")))

_ROLLOUT = f"'rollout:' || left('{MANIFEST_HASH}', 16) || ':' || problem_id || ':seed-' || CAST(rollout_seed AS VARCHAR)"
query("rollout_ids", f"SELECT problem_id, rollout_seed, {_ROLLOUT} AS rollout_identity FROM fx_rollouts")(
    lambda fx: fx.rollouts.select("problem_id", "rollout_seed", identity.rollout_id(
        F.lit(MANIFEST_HASH), F.col("problem_id"), F.col("rollout_seed")).alias("rollout_identity")))

query("checkpoint_ids", """
SELECT parent_rollout_id, checkpoint_token, 'checkpoint:' || parent_rollout_id || ':token-' || CAST(checkpoint_token AS VARCHAR) AS checkpoint_identity FROM fx_checkpoints""")(
    lambda fx: fx.checkpoints.select("parent_rollout_id", "checkpoint_token", identity.checkpoint_id(
        F.col("parent_rollout_id"), F.col("checkpoint_token")).alias("checkpoint_identity")))

query("run_identity", """
SELECT c_custkey, 'run-' || left(sha256('{"campaign_scope_hash":"' || sha256(CAST(c_custkey AS VARCHAR)) || '","config_hash":"' || sha256(c_mktsegment)
  || '","manifest_hash":"' || sha256(c_name) || '"}'), 20) AS run_id FROM customer""")(
    lambda fx: fx.table("customer").select("c_custkey", identity.run_id(
        F.sha2("c_name", 256), F.sha2("c_mktsegment", 256), F.sha2(F.col("c_custkey").cast("string"), 256)).alias("run_id")))

query("safe_names", """
SELECT doc_id, left(coalesce(nullif(trim(regexp_replace(text, '[^A-Za-z0-9._-]+', '-', 'g'), '.-'), ''), 'item'), 72) || '--' || left(sha256(text), 16) || '.json' AS safe_name
FROM documents""")(
    lambda fx: fx.table("documents").select("doc_id", identity.safe_name(F.col("text")).alias("safe_name")))

TEMPLATE = "Solve it in \\boxed{...}.\n\nProblem:\n{problem}\nEnd {x} {problem}"
_TEMPLATE_SQL = TEMPLATE.replace("'", "''")
query("render_prompt", f"""
SELECT doc_id, sha256(replace('{_TEMPLATE_SQL}', '{{problem}}', text)) AS prompt_sha256 FROM documents""")(
    lambda fx: fx.table("documents").select(
        "doc_id", F.sha2(identity.render_prompt(TEMPLATE, F.col("text")), 256).alias("prompt_sha256")))

# --- small receipt expressions -----------------------------------------------

query("failure_payload", """
SELECT doc_id, source AS error_type, text AS message, doc_id % 3 = 0 AS cuda_oom, CAST(n_chars AS DOUBLE) AS elapsed_seconds FROM documents""")(
    lambda fx: fx.table("documents").withColumn("p", failure_payload(
        F.col("source"), F.col("text"), F.when(F.col("doc_id") % 3 == 0, True), F.col("n_chars").cast("double"))
    ).select("doc_id", "p.*"))

query("memory_delta", """
SELECT rollout_id, peak_reserved_bytes - peak_allocated_bytes AS delta FROM fx_rollouts""")(
    lambda fx: fx.rollouts.select("rollout_id", memory_delta(
        F.col("peak_reserved_bytes"), F.col("peak_allocated_bytes")).alias("delta")))

query("termination_status", f"""
SELECT doc_id, CASE WHEN token_ids[-1] IN ({EOS[0]}, 4) THEN 'EOS' WHEN len(token_ids) >= 128 THEN 'MAX_NEW_TOKENS' ELSE 'OTHER_STOP' END AS termination_status
FROM fx_trajectories""")(
    lambda fx: fx.trajectories.select("doc_id", termination_status(F.col("token_ids"), (*EOS, 4), 128).alias("termination_status")))

query("context_limit_check", "SELECT doc_id, len(token_ids) + 512 > 1024 AS exceeded FROM fx_trajectories")(
    lambda fx: fx.trajectories.select("doc_id", context_limit_exceeded(F.col("token_ids"), 512, 1024).alias("exceeded")))


@query("prefix_integrity", """
SELECT doc_id, doc_id % 5 <> 0 AS preserved, CASE WHEN doc_id % 5 <> 0 THEN array_to_string(token_ids, ',') END AS generated FROM fx_trajectories""")
def _prefix_integrity(fx):
    """Full output = input + trajectory, with the input damaged in some rows."""
    given = F.array(F.lit(7), F.lit(8), F.lit(9))
    kept = F.when(F.col("doc_id") % 5 == 0, F.array(F.lit(7), F.lit(0), F.lit(9))).otherwise(given)
    full = F.concat(kept, "token_ids")
    return fx.trajectories.select(
        "doc_id", preserves_prefix(full, given).alias("preserved"),
        F.array_join(strip_prefix(full, given), ",").alias("generated"))


# --- strict reads from VARIANT -----------------------------------------------

# Eight JSON shapes of the same field, by order key.
_SHAPES = {
    0: "{k}", 1: "{k}.5", 2: '"{k}"', 3: "true", 4: "null", 5: None, 6: "-{k}1", 7: "{k}e1",
}


def _shaped_orders(fx):
    key = F.col("o_orderkey").cast("string")
    value = F.lit(None).cast("string")
    for shape, template in _SHAPES.items():
        text = F.lit(None).cast("string") if template is None else F.replace(F.lit(template), F.lit("{k}"), key)
        value = F.when(F.col("o_orderkey") % 8 == shape, text).otherwise(value)
    record = F.when(value.isNull(), F.lit('{"y":1}')).otherwise(F.concat(F.lit('{"x":'), value, F.lit("}")))
    return fx.table("orders").select("o_orderkey", F.parse_json(record).alias("v"))


query("strict_field_get", """
SELECT o_orderkey,
  CASE o_orderkey % 8 WHEN 0 THEN o_orderkey WHEN 6 THEN -CAST(CAST(o_orderkey AS VARCHAR) || '1' AS BIGINT) END AS int_value,
  CASE o_orderkey % 8 WHEN 0 THEN o_orderkey END AS nonnegative_int,
  CASE o_orderkey % 8 WHEN 0 THEN CAST(o_orderkey AS DOUBLE) WHEN 1 THEN CAST(o_orderkey AS DOUBLE) + 0.5e0 WHEN 7 THEN CAST(o_orderkey AS DOUBLE) * 10 END AS nonnegative_number,
  CASE WHEN o_orderkey % 8 = 2 THEN CAST(o_orderkey AS VARCHAR) END AS string_value,
  CASE WHEN o_orderkey % 8 = 3 THEN TRUE END AS bool_value FROM orders""")(
    lambda fx: _shaped_orders(fx).select(
        "o_orderkey", strict.strict_int(F.col("v"), "$.x").alias("int_value"),
        strict.nonnegative_int(F.col("v"), "$.x").alias("nonnegative_int"),
        strict.nonnegative_number(F.col("v"), "$.x").alias("nonnegative_number"),
        strict.strict_string(F.col("v"), "$.x").alias("string_value"),
        strict.strict_bool(F.col("v"), "$.x").alias("bool_value")))

# Fixed test shapes of the eligibility field: JSON text, expected status, expected codes.
ELIGIBILITY_SHAPES = (
    (None, "NOT_DECLARED_LEGACY_ELIGIBLE", ""),
    ("true", "EXPLICIT_BOOLEAN_ELIGIBLE", ""),
    ("false", "EXPLICIT_BOOLEAN_EXCLUDED", "EXPLICIT_BOOLEAN_EXCLUDED"),
    ("null", "MALFORMED_EXPLICIT_FIELD_EXCLUDED", "MALFORMED_EXPLICIT_FIELD"),
    ('"yes"', "MALFORMED_EXPLICIT_FIELD_EXCLUDED", "MALFORMED_EXPLICIT_FIELD"),
    ("1", "MALFORMED_EXPLICIT_FIELD_EXCLUDED", "MALFORMED_EXPLICIT_FIELD"),
    ('{"eligible":true,"reasons":[]}', "EXPLICIT_MAPPING_ELIGIBLE", ""),
    ('{"eligible":false,"reasons":[{"code":"B"},{"code":"A"},{"code":"B"},{"code":""},{"code":3},"A",null]}', "EXPLICIT_MAPPING_EXCLUDED", "A,B"),
    ('{"eligible":false,"reasons":"A"}', "EXPLICIT_MAPPING_EXCLUDED", ""),
    ('{"eligible":1,"status":"ELIGIBLE"}', "EXPLICIT_MAPPING_STATUS_ELIGIBLE", ""),
    ('{"status":"INELIGIBLE","reasons":[{"code":"C"}]}', "EXPLICIT_MAPPING_STATUS_EXCLUDED", "C"),
    ('{"status":"EXCLUDED"}', "EXPLICIT_MAPPING_STATUS_EXCLUDED", ""),
    ('{"status":"OTHER"}', "MALFORMED_EXPLICIT_FIELD_EXCLUDED", "MALFORMED_EXPLICIT_FIELD"),
    ("{}", "MALFORMED_EXPLICIT_FIELD_EXCLUDED", "MALFORMED_EXPLICIT_FIELD"),
)


def _shape_case(position: int) -> str:
    cases = " ".join(f"WHEN {i} THEN '{shape[position]}'" for i, shape in enumerate(ELIGIBILITY_SHAPES))
    return f"CASE o_orderkey % {len(ELIGIBILITY_SHAPES)} {cases} END"


def _eligibility_receipts(fx):
    field = F.lit(None).cast("string")
    for i, (text, _, _) in enumerate(ELIGIBILITY_SHAPES):
        body = "{}" if text is None else '{"analytic_eligibility":' + text + "}"
        field = F.when(F.col("o_orderkey") % len(ELIGIBILITY_SHAPES) == i, F.lit(body)).otherwise(field)
    return fx.table("orders").select("o_orderkey", F.parse_json(field).alias("record"))


query("read_eligibility", f"""
SELECT o_orderkey, status LIKE '%ELIGIBLE' AS eligible, status AS eligibility_status, codes AS reason_codes
FROM (SELECT o_orderkey, {_shape_case(1)} AS status, {_shape_case(2)} AS codes FROM orders) s""")(
    lambda fx: read_eligibility(_eligibility_receipts(fx)).select(
        "o_orderkey", "eligible", "eligibility_status", F.array_join("reason_codes", ",").alias("reason_codes")))

query("reason_codes", f"""
SELECT o_orderkey, CASE WHEN o_orderkey % {len(ELIGIBILITY_SHAPES)} IN (7, 10) THEN {_shape_case(2)} ELSE '' END AS codes FROM orders""")(
    lambda fx: _eligibility_receipts(fx).select("o_orderkey", F.array_join(
        reason_codes(strict.child(F.col("record"), "$.analytic_eligibility")), ",").alias("codes")))

# --- plans -------------------------------------------------------------------

_SEED_ROWS = "(SELECT CAST(unnest([" + ", ".join(map(str, SEEDS)) + "]) AS BIGINT) AS rollout_seed) s"
query("rollout_plan", f"""
SELECT problem_id, rollout_seed, {_ROLLOUT} AS rollout_id FROM fx_problems, {_SEED_ROWS}""")(
    lambda fx: planning.rollout_plan(_problems(fx), SEEDS, MANIFEST_HASH))

query("checkpoint_plan", f"""
SELECT rollout_id, checkpoint_token, 'checkpoint:' || rollout_id || ':token-' || CAST(checkpoint_token AS VARCHAR) AS checkpoint_id
FROM (SELECT DISTINCT rollout_id FROM fx_rollouts) r, (SELECT CAST(unnest([{', '.join(map(str, POSITIONS))}]) AS BIGINT) AS checkpoint_token) p""")(
    lambda fx: planning.checkpoint_plan(fx.planned, POSITIONS))

query("pending_requests", """
SELECT rollout_id FROM (SELECT DISTINCT rollout_id FROM fx_rollouts) r
WHERE 'intent:' || rollout_id NOT IN (SELECT intent_id FROM fx_ledger_orders WHERE event_type = 'INTENT_STARTED')""")(
    lambda fx: planning.pending_requests(fx.planned, fx.view("fx_ledger_orders")))

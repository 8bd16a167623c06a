"""Campaign-shaped views over the given tables.

One SQL text serves both engines: ``{orders}`` becomes a parquet scan in Spark and a
table name in DuckDB. Only token arrays need two dialects.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POSITIONS = (256, 512, 1024, 2048, 3072)
WORD_POSITIONS = (32, 64, 128, 256, 512)
SEEDS = (101, 102, 103, 104)
SELECTION_SEED = 20260926
MARKER = (2, 3)
CUE = (2, 3, 40)
EOS = (17,)
MANIFEST_HASH = "0123456789abcdef" * 4

VIEWS = {
    "fx_rollouts": """
WITH r AS (
  SELECT o_orderkey AS k, o_custkey, o_totalprice, o_orderstatus, o_orderpriority,
         100 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rollout_seed
  FROM {orders}
), d AS (
  SELECT * FROM r UNION ALL SELECT * FROM r WHERE k % 97 = 0
), t AS (
  SELECT d.*, CASE k % 20 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'INTERRUPTED_UNKNOWN' ELSE 'COMPLETED' END AS status FROM d
)
SELECT 'r-' || CAST(k AS STRING) AS rollout_id, 'p-' || CAST(o_custkey AS STRING) AS problem_id,
  CAST(rollout_seed AS BIGINT) AS rollout_seed, status,
  CASE WHEN status = 'COMPLETED' THEN CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'CORRECT'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'INCORRECT' WHEN o_orderpriority = '5-LOW' THEN 'ERROR' ELSE 'NON_EVALUABLE' END END AS final_status,
  CASE WHEN status = 'COMPLETED' THEN CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN TRUE
       WHEN o_orderpriority = '3-MEDIUM' AND k % 31 <> 0 THEN FALSE END END AS final_correct,
  status = 'COMPLETED' AND k % 37 <> 5 AS generation_recorded,
  CASE WHEN status = 'COMPLETED' THEN CAST(floor(o_totalprice) AS BIGINT) % 4096 + 1 END AS generated_token_count,
  CASE WHEN status = 'COMPLETED' THEN CAST(k % 50 AS DOUBLE) / 10e0 END AS elapsed_seconds,
  CASE WHEN status = 'COMPLETED' THEN CASE o_orderstatus WHEN 'F' THEN 'EOS' WHEN 'O' THEN 'MAX_NEW_TOKENS' ELSE 'OTHER_STOP' END END AS termination_status,
  CASE WHEN status = 'COMPLETED' THEN CAST(floor(o_totalprice) AS BIGINT) * 10 END AS peak_allocated_bytes,
  CASE WHEN status = 'COMPLETED' AND k % 3 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) * 16 END AS peak_reserved_bytes,
  CASE WHEN status = 'FAILED' THEN CASE WHEN k % 3 = 0 THEN 'OutOfMemoryError' WHEN k % 7 <> 0 THEN 'RuntimeError' END
       WHEN status = 'INTERRUPTED_UNKNOWN' THEN 'INTERRUPTED_UNKNOWN' END AS error_type,
  status = 'FAILED' AND k % 3 = 0 AS cuda_oom,
  CASE k % 11 WHEN 0 THEN 'MALFORMED_EXPLICIT_FIELD_EXCLUDED' WHEN 1 THEN 'EXPLICIT_MAPPING_EXCLUDED'
       WHEN 2 THEN 'EXPLICIT_BOOLEAN_ELIGIBLE' ELSE 'NOT_DECLARED_LEGACY_ELIGIBLE' END AS eligibility_status,
  k % 11 NOT IN (0, 1) AS eligible,
  CASE k % 11 WHEN 0 THEN 'MALFORMED_EXPLICIT_FIELD' WHEN 1 THEN 'BASE_TERMINATION_NOT_NATURAL_EOS' END AS reason_code
FROM t""",
    "fx_checkpoints_all": """
WITH t AS (
  SELECT l.*, o.o_custkey, CASE l_partkey % 25 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'INTERRUPTED_UNKNOWN'
         WHEN 2 THEN 'UNAVAILABLE' WHEN 3 THEN 'UNAVAILABLE' ELSE 'COMPLETED' END AS status
  FROM {lineitem} l JOIN {orders} o ON l_orderkey = o_orderkey
)
SELECT CASE WHEN l_partkey % 101 = 0 THEN 'r-missing' ELSE 'r-' || CAST(l_orderkey AS STRING) END AS parent_rollout_id,
  CASE WHEN l_suppkey % 53 = 0 THEN NULL ELSE 'p-' || CAST(o_custkey AS STRING) END AS problem_id,
  CAST(CASE l_linenumber WHEN 1 THEN 256 WHEN 2 THEN 512 WHEN 3 THEN 1024 WHEN 4 THEN 2048 WHEN 5 THEN 3072
       WHEN 6 THEN 4096 END AS BIGINT) AS checkpoint_token,
  status,
  CASE WHEN status <> 'UNAVAILABLE' THEN 'AVAILABLE' WHEN l_suppkey % 3 = 0 THEN 'TRAJECTORY_TOO_SHORT'
       WHEN l_suppkey % 3 = 1 THEN 'AFTER_THINK_CLOSE' ELSE 'AFTER_TERMINAL_TOKEN' END AS availability_status,
  CASE WHEN status = 'COMPLETED' THEN CASE l_returnflag WHEN 'A' THEN 'CORRECT' WHEN 'N' THEN 'INCORRECT' ELSE 'NON_EVALUABLE' END END AS forced_status,
  CASE WHEN status = 'COMPLETED' THEN CASE l_returnflag WHEN 'A' THEN TRUE WHEN 'N' THEN FALSE END END AS forced_correct,
  CASE l_suppkey % 7 WHEN 0 THEN 'CORRECT' WHEN 1 THEN 'INCORRECT' WHEN 2 THEN 'NON_EVALUABLE' END AS own_ref_status,
  CASE l_suppkey % 7 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS own_ref_correct,
  CASE l_suppkey % 43 WHEN 0 THEN 'C_TO_C' WHEN 1 THEN 'BOGUS' END AS own_observed_label,
  CASE l_suppkey % 41 WHEN 0 THEN 'W_TO_W' WHEN 1 THEN 'BOGUS' END AS transition_label,
  status = 'COMPLETED' AND l_partkey % 29 <> 4 AS generation_recorded,
  CASE WHEN status = 'COMPLETED' THEN CAST(floor(l_quantity) AS BIGINT) END AS generated_token_count,
  CASE WHEN status = 'COMPLETED' THEN floor(l_quantity) / 10e0 END AS elapsed_seconds,
  CASE WHEN status = 'COMPLETED' THEN CASE l_linestatus WHEN 'F' THEN 'EOS' ELSE 'MAX_NEW_TOKENS' END END AS termination_status,
  CASE WHEN status = 'COMPLETED' THEN CAST(floor(l_extendedprice) AS BIGINT) * 8 END AS peak_allocated_bytes,
  CASE WHEN status = 'COMPLETED' AND l_partkey % 2 = 0 THEN CAST(floor(l_extendedprice) AS BIGINT) * 9 END AS peak_reserved_bytes,
  CASE WHEN status = 'FAILED' THEN CASE WHEN l_suppkey % 2 = 0 THEN 'OutOfMemoryError' ELSE 'RuntimeError' END
       WHEN status = 'INTERRUPTED_UNKNOWN' THEN 'INTERRUPTED_UNKNOWN' END AS error_type,
  status = 'FAILED' AND l_suppkey % 2 = 0 AS cuda_oom,
  CASE WHEN l_partkey % 4 = 0 THEN 'EXPLICIT_MAPPING_EXCLUDED' WHEN l_partkey % 4 = 1 THEN 'EXPLICIT_MAPPING_ELIGIBLE'
       ELSE 'NOT_DECLARED_LEGACY_ELIGIBLE' END AS eligibility_status,
  l_partkey % 4 <> 0 AS eligible,
  CASE WHEN l_partkey % 4 = 0 THEN 'FORCED_TERMINATION_NOT_NATURAL_EOS' END AS reason_code
FROM t""",
    # Older receipts: no own references, no observed label.
    "fx_checkpoints": """
SELECT *, CAST(NULL AS STRING) AS final_ref_status, CAST(NULL AS BOOLEAN) AS final_ref_correct,
  CAST(NULL AS STRING) AS observed_transition_label
FROM {fx_checkpoints_all}""",
    # Receipts that carry their own final reference and observed label.
    "fx_checkpoints_own": """
SELECT *, own_ref_status AS final_ref_status, own_ref_correct AS final_ref_correct,
  own_observed_label AS observed_transition_label
FROM {fx_checkpoints_all}""",
    "fx_ledger": """
SELECT event_id AS seq, 'i-' || CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING) AS intent_id,
  CASE event_type WHEN 'signup' THEN 'INTENT_STARTED' WHEN 'purchase' THEN 'BASE_COMPLETED' WHEN 'error' THEN 'BASE_FAILED'
       WHEN 'view' THEN 'INTERRUPTED_UNKNOWN' ELSE 'NOTE' END AS event_type
FROM {events}""",
    "fx_ledger_orders": """
SELECT o_orderkey * 2 AS seq, 'intent:r-' || CAST(o_orderkey AS STRING) AS intent_id, 'INTENT_STARTED' AS event_type
FROM {orders} WHERE o_orderkey % 13 <> 7
UNION ALL
SELECT o_orderkey * 2 + 1, 'intent:r-' || CAST(o_orderkey AS STRING),
  CASE o_orderkey % 20 WHEN 0 THEN 'BASE_FAILED' WHEN 1 THEN 'INTERRUPTED_UNKNOWN' ELSE 'BASE_COMPLETED' END
FROM {orders} WHERE o_orderkey % 13 NOT IN (7, 8)""",
    "fx_invocations": """
SELECT event_id AS seq,
  CASE WHEN event_type IN ('signup', 'view') THEN 'RUN_INVOCATION_STARTED' WHEN event_type IN ('purchase', 'error') THEN 'RUN_INVOCATION_FINISHED' ELSE 'NOTE' END AS event_type,
  'invocation:' || CAST(user_id AS STRING) || ':' || CAST(CAST(ts AS DATE) AS STRING) AS invocation_id,
  CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' END AS outcome,
  CASE WHEN event_type = 'error' THEN 'RuntimeError' END AS error_type
FROM {events}""",
    "fx_problems": """
SELECT CAST(d.doc_id AS STRING) AS problem_id, d.doc_id AS source_index, d.text AS problem,
  CAST(d.n_chars AS STRING) AS reference_answer, l.quality AS level, d.lang AS subject
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "fx_completions": """
SELECT p_partkey AS part_id, CASE p_partkey % 8
    WHEN 0 THEN 'answer ' || chr(92) || 'boxed{' || n || '}'
    WHEN 1 THEN 'first ' || chr(92) || 'boxed{1}; final ' || chr(92) || 'boxed{' || chr(92) || 'frac{' || n || '}{3}}'
    WHEN 2 THEN 'answer is probably ' || n
    WHEN 3 THEN chr(92) || 'boxed{' || n
    WHEN 4 THEN 'x ' || chr(92) || 'boxed{ } y'
    WHEN 5 THEN chr(92) || 'boxed{' || chr(92) || 'boxed{' || n || '}}'
    WHEN 6 THEN 'answer ' || chr(92) || 'boxed{' || n || '}; typo ' || chr(92) || 'boxed{'
    ELSE chr(92) || 'boxedx{1} ' || chr(92) || 'boxed  {' || chr(92) || '{' || n || '}' END AS generated_text,
  CASE WHEN p_partkey % 3 = 0 THEN n WHEN p_partkey % 47 = 1 THEN ' ' ELSE CAST(p_size + 1 AS STRING) END AS reference_answer
FROM (SELECT p_partkey, p_size, CAST(p_size AS STRING) AS n FROM {part}) s""",
}

DUCKDB_VIEWS = {
    "fx_trajectories": """
SELECT doc_id, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS INTEGER)) AS token_ids FROM documents""",
}

_NAME = re.compile(r"\{([a-z]\w*)\}")


class Fixtures:
    """Views as Spark DataFrames for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _expand(self, sql: str) -> str:
        def source(match: re.Match) -> str:
            name = match.group(1)
            if name in VIEWS:
                return f"({self._expand(VIEWS[name])}) {name}"
            return f"parquet.`{self.sf_dir}/{name}.parquet`"

        return _NAME.sub(source, sql)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(self._expand(text))

    def view(self, name: str) -> DataFrame:
        df = self.sql(VIEWS[name])
        if "reason_code" in df.columns:
            # No lambda function, so the wide projection stays in generated code.
            code = F.col("reason_code")
            codes = F.when(code.isNull(), F.array().cast("array<string>")).otherwise(F.array(F.coalesce(code, F.lit(""))))
            df = df.withColumn("reason_codes", codes).drop("reason_code")
        return df

    @property
    def rollouts(self) -> DataFrame:
        return self.view("fx_rollouts")

    @property
    def checkpoints(self) -> DataFrame:
        return self.view("fx_checkpoints")

    @property
    def checkpoints_own(self) -> DataFrame:
        return self.view("fx_checkpoints_own")

    @property
    def planned(self) -> DataFrame:
        return self.rollouts.select("rollout_id").distinct()

    @property
    def trajectories(self) -> DataFrame:
        words = F.split("text", " ")
        return self.table("documents").select(
            "doc_id", F.transform(words, lambda w: F.length(w)).alias("token_ids")
        )


def with_views(sql: str) -> str:
    """An oracle as one SELECT, with the views it names (directly or not) as CTEs."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in [*VIEWS, *DUCKDB_VIEWS]:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(VIEWS.get(name) or DUCKDB_VIEWS[name])
                needed.append(name)

    visit(sql)
    body = sql.strip()
    if not needed:
        return body
    definitions = [
        f"{name} AS ({_NAME.sub(lambda m: m.group(1), VIEWS.get(name) or DUCKDB_VIEWS[name])})" for name in needed
    ]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(definitions) + ",\n" + body[5:]
    return "WITH " + ",\n".join(definitions) + "\n" + body

"""Queries over token arrays, completions, the ledger and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.inputs import physical_ledger
from suite.oracle_parts import EVAL
from suite.registry import query
from suite.views import CUE, EOS, MARKER, WORD_POSITIONS
from trailmark.functions.identity import checkpoint_id, intent_id
from trailmark.functions.tokens import all_subsequence_starts, find_subsequence
from trailmark.operators import grading, ledger, trajectory
from trailmark.params import CampaignPlan
from trailmark.plans.campaign import grade_forced
from trailmark.session import scratch_path
from trailmark.sinks import writers
from trailmark.sources import inputs
from trailmark.streaming import live

# --- token arrays ------------------------------------------------------------

_M0, _M1 = MARKER
_STARTS = f"""starts AS (SELECT doc_id, token_ids, list_filter(range(0, greatest(len(token_ids) - 1, 0)),
  lambda i: token_ids[i + 1] = {_M0} AND token_ids[i + 2] = {_M1}) AS s FROM fx_trajectories)"""

query("find_subsequence", f"WITH {_STARTS} SELECT doc_id, CAST(s[1] AS INTEGER) AS first_start FROM starts")(
    lambda fx: fx.trajectories.select("doc_id", find_subsequence(F.col("token_ids"), MARKER).alias("first_start")))

query("all_subsequence_starts", f"""
WITH {_STARTS} SELECT doc_id, CAST(len(s) AS INTEGER) AS hits, array_to_string(s, ',') AS starts FROM starts""")(
    lambda fx: fx.trajectories.withColumn("s", all_subsequence_starts(F.col("token_ids"), MARKER)).select(
        "doc_id", F.size("s").alias("hits"), F.array_join("s", ",").alias("starts")))

query("thinking_boundary", f"""
WITH {_STARTS} SELECT doc_id, CAST(s[1] AS INTEGER) AS first_close_marker_start, CAST(len(s) AS INTEGER) AS close_marker_count,
  CASE len(s) WHEN 0 THEN 'NO_CLOSE_MARKER' WHEN 1 THEN 'ONE_CLOSE_MARKER' ELSE 'MULTIPLE_CLOSE_MARKERS' END AS marker_status,
  sha256('[{_M0},{_M1}]') AS close_marker_sha256 FROM starts""")(
    lambda fx: trajectory.thinking_boundaries(fx.trajectories, MARKER).drop("token_ids"))

_CUT = f"""{_STARTS}, pos AS (SELECT unnest([{', '.join(map(str, WORD_POSITIONS))}])::INTEGER AS p),
cut AS (SELECT doc_id, token_ids, p AS checkpoint_token, CASE WHEN p > len(token_ids) THEN 'TRAJECTORY_TOO_SHORT' WHEN s[1] < p THEN 'AFTER_THINK_CLOSE'
  WHEN list_position(token_ids, {EOS[0]}) BETWEEN 1 AND p THEN 'AFTER_TERMINAL_TOKEN' ELSE 'AVAILABLE' END AS availability_status FROM starts, pos)"""

query("fixed_checkpoints", f"""
WITH {_CUT} SELECT doc_id, checkpoint_token, availability_status,
  CASE availability_status WHEN 'TRAJECTORY_TOO_SHORT' THEN 'saved trajectory has ' || CAST(len(token_ids) AS VARCHAR) || ' generated tokens'
    WHEN 'AFTER_THINK_CLOSE' THEN 'requested prefix reaches the original final-answer phase'
    WHEN 'AFTER_TERMINAL_TOKEN' THEN 'requested prefix contains a terminal token' END AS reason,
  CASE WHEN availability_status = 'AVAILABLE' THEN array_to_string(token_ids[1:checkpoint_token], ',') END AS prefix,
  CASE WHEN availability_status = 'AVAILABLE' THEN sha256('[' || array_to_string(token_ids[1:checkpoint_token], ',') || ']') END AS prefix_sha256 FROM cut""")(
    lambda fx: trajectory.fixed_checkpoints(fx.trajectories, WORD_POSITIONS, MARKER, EOS).select(
        "doc_id", "checkpoint_token", "availability_status", "reason",
        F.array_join("prefix_token_ids", ",").alias("prefix"), "prefix_sha256"))

_CUE_TEXT = ",".join(map(str, CUE))
query("forced_input", f"""
WITH {_CUT} SELECT doc_id, checkpoint_token, 2 AS prompt_token_count, checkpoint_token AS saved_prefix_token_count,
  checkpoint_token + {2 + len(CUE)} AS input_token_count, sha256('[' || CAST(doc_id AS VARCHAR) || ',8]') AS prompt_sha256,
  sha256('[' || array_to_string(token_ids[1:checkpoint_token], ',') || ']') AS prefix_sha256, sha256('[{_CUE_TEXT}]') AS cue_sha256,
  sha256('[' || CAST(doc_id AS VARCHAR) || ',8,' || array_to_string(token_ids[1:checkpoint_token], ',') || ',{_CUE_TEXT}]') AS input_sha256
FROM cut WHERE availability_status = 'AVAILABLE'""")(
    lambda fx: trajectory.forced_input(
        trajectory.fixed_checkpoints(
            fx.trajectories.withColumn("prompt_token_ids", F.array(F.col("doc_id").cast("int"), F.lit(8))),
            WORD_POSITIONS, MARKER, EOS),
        CUE,
    ).select("doc_id", "checkpoint_token", "prompt_token_count", "saved_prefix_token_count", "input_token_count",
             "prompt_sha256", "prefix_sha256", "cue_sha256", "input_sha256"))

query("cue_validation", f"""
WITH {_STARTS} SELECT doc_id, CASE WHEN doc_id % 2 <> 0 AND NOT coalesce(s[1] = 0, FALSE) THEN 'MARKER_NOT_AT_START'
  WHEN doc_id % 2 = 0 AND len(s) > 0 OR doc_id % 2 <> 0 AND len(list_filter(s, lambda i: i >= 2)) > 0 THEN 'SECOND_MARKER'
  WHEN list_contains(token_ids, {EOS[0]}) THEN 'CONTAINS_EOS' END AS violation FROM starts""")(
    lambda fx: trajectory.cue_violations(
        fx.trajectories.withColumn("token_ids", F.when(
            F.col("doc_id") % 2 == 0, F.concat(F.array(*[F.lit(i) for i in MARKER]), "token_ids")
        ).otherwise(F.col("token_ids"))), MARKER, EOS).select("doc_id", "violation"))

# --- completions -------------------------------------------------------------

_BS = "chr(92)"
_BOX = f"{_BS} || 'boxed{{' || n || '}}'"
_EXTRACTED = f"""ex AS (SELECT p_partkey AS part_id, p_partkey % 8 AS k, p_size, CAST(p_size AS VARCHAR) AS n, generated_text, reference_answer
  FROM part JOIN fx_completions ON p_partkey = part_id),
extracted AS (SELECT *, CASE k WHEN 2 THEN 'MISSING_BOXED_ANSWER' WHEN 3 THEN 'MALFORMED_BOXED_ANSWER' WHEN 4 THEN 'EMPTY_BOXED_ANSWER' ELSE 'EXTRACTED' END AS status,
  CASE WHEN k IN (0, 5, 6) THEN {_BOX} WHEN k = 1 THEN {_BS} || 'boxed{{' || {_BS} || 'frac{{' || n || '}}{{3}}}}'
    WHEN k = 7 THEN {_BS} || 'boxed  {{' || {_BS} || '{{' || n || '}}' END AS extracted_text,
  CASE k WHEN 0 THEN 7 WHEN 1 THEN 23 WHEN 3 THEN 0 WHEN 4 THEN 2 WHEN 5 THEN 7 WHEN 6 THEN 7 WHEN 7 THEN 11 END AS start_offset FROM ex)"""
_END = "CASE WHEN k = 4 THEN 11 ELSE start_offset + length(extracted_text) END"

query("extract_boxed", f"""
WITH {_EXTRACTED} SELECT part_id, status, extracted_text, CAST(start_offset AS INTEGER) AS start_offset,
  CAST({_END} AS INTEGER) AS end_offset,
  CASE k WHEN 2 THEN 'completion contains no boxed expression' WHEN 3 THEN 'boxed expression has no matching closing brace'
    WHEN 4 THEN 'boxed expression is empty' END AS reason FROM extracted""")(
    lambda fx: grading.extract_answers(fx.view("fx_completions")).select("part_id", "extraction.*"))

_GRADED = f"""{_EXTRACTED}, graded AS (SELECT *, CASE WHEN status <> 'EXTRACTED' THEN 'NON_EVALUABLE' WHEN trim(reference_answer) = '' THEN 'NON_EVALUABLE'
    WHEN k IN (0, 5, 6) AND reference_answer = n THEN 'CORRECT'
    WHEN k = 1 AND CAST(p_size AS DOUBLE) = 3 * CAST(nullif(trim(reference_answer), '') AS DOUBLE) THEN 'CORRECT' ELSE 'INCORRECT' END AS grade FROM extracted)"""

query("evaluate_answers", f"""
WITH {_GRADED} SELECT part_id, grade AS status, CASE grade WHEN 'CORRECT' THEN TRUE WHEN 'INCORRECT' THEN FALSE END AS correct,
  CASE WHEN status <> 'EXTRACTED' THEN 'answer extraction status: ' || status WHEN trim(reference_answer) = '' THEN 'missing or empty reference answer' END AS reason,
  CASE WHEN grade <> 'NON_EVALUABLE' THEN 1 END AS parsed_reference_count, CASE WHEN grade <> 'NON_EVALUABLE' THEN 1 END AS parsed_candidate_count FROM graded""")(
    lambda fx: grading.grade_completions(fx.view("fx_completions")).select("part_id", "evaluation.*"))

query("evaluate_numeric_answers", """
SELECT o_orderkey, form, correct FROM (
  SELECT o_orderkey, unnest(['fraction', 'decimal', 'spaced', 'sign', 'other']) AS form,
    unnest([o_orderkey % 3 = 0, TRUE, TRUE, o_orderkey = 0, FALSE]) AS correct FROM orders) s""")(
    lambda fx: grading.evaluate_pairs(fx.table("orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("n"), F.inline(F.array(*[
        F.struct(F.lit(name).alias("form"), value.alias("given")) for name, value in (
            ("fraction", F.concat(F.lit("\\boxed{\\dfrac{"), (F.floor(F.col("o_orderkey") / 3) * 6).cast("string"), F.lit("}{2}}"))),
            ("decimal", F.concat(F.lit("$"), F.col("o_orderkey").cast("string"), F.lit(".000$"))),
            ("spaced", F.concat(F.lit(" \\left "), F.col("o_orderkey").cast("string"), F.lit("\\, ."))),
            ("sign", F.concat(F.lit("-"), F.col("o_orderkey").cast("string"))),
            ("other", F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))))
    ]))), "n", "given").select("o_orderkey", "form", "evaluation.correct"))


query("evaluate_long_fractions", """
SELECT o_orderkey, form, correct FROM (
  SELECT o_orderkey, unnest(['cancelled', 'halves', 'thirds', 'zero', 'text']) AS form,
    unnest([TRUE, TRUE, o_orderkey % 3 = 0, FALSE, TRUE]) AS correct FROM orders) s""")(
    lambda fx: grading.evaluate_pairs(fx.table("orders").select("o_orderkey", F.inline(F.array(*[
        F.struct(F.lit(name).alias("form"), reference.alias("reference"), given.alias("given")) for name, reference, given in (
            ("cancelled", F.concat(_key(), F.lit("/2")), F.concat(F.lit("\\boxed{\\frac{"), _key(), F.lit("0000000000000}{20000000000000}}"))),
            ("halves", F.concat((F.col("o_orderkey") * 2 + 1).cast("string"), F.lit("/2")), F.concat(_key(), F.lit(".50000000"))),
            ("thirds", F.concat(_key(), F.lit("0000000000000/3")), F.concat(F.floor(F.col("o_orderkey") / 3).cast("string"), F.lit("0000000000000.0000000"))),
            ("zero", F.concat(_key(), F.lit("0000000000000/0")), F.concat(_key(), F.lit("0000000000001/0"))),
            ("text", F.concat(_key(), F.lit("0000000000000/0")), F.concat(_key(), F.lit("0000000000000/0"))))
    ]))), "reference", "given").select("o_orderkey", "form", "evaluation.correct"))


def _key():
    return F.col("o_orderkey").cast("string")


def _forced_results(fx):
    """Returned forced completions with their parent's facts attached."""
    part = fx.table("part").select(
        F.col("p_partkey").alias("part_id"), "p_size", F.col("p_retailprice"))
    return fx.view("fx_completions").join(part, "part_id").select(
        "part_id", "generated_text", "reference_answer",
        F.when(F.col("part_id") % 13 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(17))).alias("generated_token_ids"),
        F.when(F.col("part_id") % 17 == 0, "AFTER_THINK_CLOSE").otherwise("AVAILABLE").alias("availability_status"),
        F.when(F.col("p_size") % 5 != 0, F.when(F.col("p_size") % 5 == 1, "MAX_NEW_TOKENS").otherwise("EOS")).alias("base_termination"),
        F.when(F.col("part_id") % 11 != 0, F.col("p_size")).alias("close_marker_start"),
        F.when(F.col("p_size") % 4 == 0, "NON_EVALUABLE").when(F.col("p_size") % 4 == 1, "INCORRECT").otherwise("CORRECT").alias("final_status"),
        F.when(F.col("p_size") % 4 != 0, F.col("p_size") % 4 != 1).alias("final_correct"),
    )


query("apply_eligibility", f"""
WITH {_GRADED}, c AS (SELECT part_id, grade, p_size,
    part_id % 17 <> 0 AS c1, coalesce(p_size % 5 NOT IN (0, 1), FALSE) AS c2, part_id % 11 <> 0 AS c3, part_id % 13 <> 0 AS c4,
    p_size % 4 <> 0 AS c5, grade IN {EVAL} AS c6 FROM graded),
r AS (SELECT *, list_filter([CASE WHEN NOT c1 THEN 'CHECKPOINT_NOT_AVAILABLE' END, CASE WHEN NOT c2 THEN 'BASE_TERMINATION_NOT_NATURAL_EOS' END,
    CASE WHEN NOT c3 THEN 'BASE_CLOSE_THINK_MARKER_MISSING' END, CASE WHEN NOT c4 THEN 'FORCED_TERMINATION_NOT_NATURAL_EOS' END,
    CASE WHEN NOT c5 THEN 'ORIGINAL_FINAL_NOT_EVALUABLE' END, CASE WHEN NOT c6 THEN 'FORCED_ANSWER_NOT_EVALUABLE' END], lambda x: x IS NOT NULL) AS codes,
  CASE WHEN c5 AND c6 THEN (CASE WHEN grade = 'CORRECT' THEN 'C' ELSE 'W' END) || '_TO_' || (CASE WHEN p_size % 4 = 1 THEN 'W' ELSE 'C' END) END AS observed FROM c)
SELECT part_id, len(codes) = 0 AS eligible, array_to_string(codes, ',') AS reasons, observed AS observed_transition_label,
  CASE WHEN len(codes) = 0 THEN observed END AS transition_label FROM r""")(
    lambda fx: grade_forced(_forced_results(fx), CampaignPlan(), EOS, 512).select(
        "part_id", "analytic_eligibility.eligible", F.array_join("analytic_eligibility.reasons", ",").alias("reasons"),
        "observed_transition_label", "transition_label"))

# --- ledger ------------------------------------------------------------------

_CODES = """coded AS (SELECT *, CASE event_type WHEN 'INTENT_STARTED' THEN 0 WHEN 'BASE_COMPLETED' THEN 1 WHEN 'BASE_FAILED' THEN 2 WHEN 'INTERRUPTED_UNKNOWN' THEN 3 END AS code FROM {0}),
ordered AS (SELECT *, row_number() OVER (PARTITION BY intent_id ORDER BY seq) AS o FROM coded WHERE code IS NOT NULL)"""
_STATES = _CODES + """, hist AS (SELECT intent_id, max(code) FILTER (WHERE o = 1) AS e1, max(code) FILTER (WHERE o = 2) AS e2, max(code) FILTER (WHERE o = 3) AS e3 FROM ordered GROUP BY 1),
states AS (SELECT intent_id, CASE WHEN e1 <> 0 THEN 'TERMINAL_WITHOUT_START' WHEN e2 = 0 OR e3 = 0 THEN 'DUPLICATE_START' WHEN e3 IS NOT NULL THEN 'DUPLICATE_TERMINAL' END AS violation,
  CASE WHEN e1 <> 0 OR e2 = 0 OR e3 IS NOT NULL THEN NULL WHEN e2 IS NULL THEN 'STARTED_UNKNOWN' WHEN e2 = 1 THEN 'COMPLETED' WHEN e2 = 2 THEN 'FAILED' ELSE 'INTERRUPTED_UNKNOWN' END AS state FROM hist)"""

query("ledger_event_order", f"""
WITH {_CODES.format("fx_ledger")} SELECT seq, intent_id, event_type, CAST(o AS INTEGER) AS event_ordinal FROM ordered""")(
    lambda fx: ledger.ledger_event_order(fx.view("fx_ledger")).select("seq", "intent_id", "event_type", "event_ordinal"))

for _name, _view in (("intent_states", "fx_ledger"), ("intent_states_valid", "fx_ledger_orders")):
    query(_name, f"WITH {_STATES.format(_view)} SELECT intent_id, state, violation FROM states")(
        lambda fx, view=_view: ledger.intent_states(fx.view(view)))

query("intent_states_physical", f"WITH {_STATES.format('fx_ledger')} SELECT intent_id, state, violation FROM states")(
    lambda fx: ledger.intent_states(physical_ledger(fx)))

query("interrupted_intents", f"""
WITH {_STATES.format("fx_ledger_orders")} SELECT 'INTERRUPTED_UNKNOWN' AS event_type, intent_id, 'prior run ended without terminal receipt' AS reason
FROM states WHERE state = 'STARTED_UNKNOWN'""")(
    lambda fx: ledger.interrupted_intents(fx.view("fx_ledger_orders")).select("event_type", "intent_id", "reason"))


@query("interrupted_intents_appended", f"""
WITH {_STATES.format("fx_ledger_orders")} SELECT CASE state WHEN 'STARTED_UNKNOWN' THEN 'INTERRUPTED_UNKNOWN' ELSE state END AS state,
  CAST(count(*) AS BIGINT) AS n FROM states GROUP BY 1""")
def _interrupted_intents_appended(fx):
    """The ledger read again after the events of its dangling starts were appended."""
    path = scratch_path(fx.spark, "ledger")
    events = fx.view("fx_ledger_orders")
    writers.append_ledger(events.withColumn("payload", F.parse_json(F.lit("{}"))), path)
    writers.append_ledger(ledger.interrupted_intents(events), path)
    return ledger.intent_states(inputs.read_ledger(fx.spark, path)).groupBy("state").agg(F.count("*").alias("n"))

# Receipts exist for rollouts whose key is not a multiple of 17.
_RECOVERY = _STATES.format("fx_ledger_orders") + """, rec AS (SELECT 'intent:' || rollout_id AS intent_id, CASE WHEN rollout_seed = 103 THEN 'ODD' ELSE status END AS receipt_status, count(*) AS n
  FROM fx_rollouts WHERE CAST(substr(rollout_id, 3) AS BIGINT) % 17 <> 0 GROUP BY 1, 2),
recovery AS (SELECT coalesce(s.intent_id, r.intent_id) AS intent_id, state, receipt_status, CAST(coalesce(n, 0) AS BIGINT) AS receipts,
  CASE WHEN violation IS NOT NULL THEN 'ERROR_INVALID_HISTORY' WHEN state IS NULL THEN 'ERROR_RECEIPT_WITHOUT_INTENT'
    WHEN state = 'STARTED_UNKNOWN' THEN CASE WHEN receipt_status IS NULL THEN 'MARK_INTERRUPTED' WHEN receipt_status = 'ODD' THEN 'ERROR_UNSUPPORTED_RECEIPT_STATUS' ELSE 'RECOVER_' || receipt_status END
    WHEN receipt_status IS NULL THEN CASE WHEN state = 'INTERRUPTED_UNKNOWN' THEN 'SYNTHESISE_INTERRUPTED_RECEIPT' ELSE 'ERROR_TERMINAL_WITHOUT_RECEIPT' END
    ELSE 'KEEP' END AS action FROM states s FULL JOIN rec r ON s.intent_id = r.intent_id)"""


def _recovery(fx):
    stored = fx.rollouts.where(F.substring("rollout_id", 3, 20).cast("bigint") % 17 != 0).select(
        F.col("rollout_id").alias("receipt_id"),
        F.when(F.col("rollout_seed") == 103, "ODD").otherwise(F.col("status")).alias("status"))
    return ledger.intent_receipt_recovery(ledger.intent_states(fx.view("fx_ledger_orders")), stored)


query("intent_receipt_recovery", f"WITH {_RECOVERY} SELECT * FROM recovery")(_recovery)

query("recovery_events", f"""
WITH {_RECOVERY}, due AS (SELECT DISTINCT intent_id, action FROM recovery WHERE action = 'MARK_INTERRUPTED' OR action LIKE 'RECOVER%')
SELECT CAST((SELECT max(seq) FROM fx_ledger_orders) + row_number() OVER (ORDER BY sha256(intent_id), intent_id) AS BIGINT) AS seq, intent_id,
  CASE action WHEN 'RECOVER_COMPLETED' THEN 'BASE_COMPLETED' WHEN 'RECOVER_FAILED' THEN 'BASE_FAILED' ELSE 'INTERRUPTED_UNKNOWN' END AS event_type,
  CASE action WHEN 'MARK_INTERRUPTED' THEN '{{"reason":"prior run ended without terminal receipt"}}' ELSE '{{"recovered":true}}' END AS payload
FROM due""")(
    lambda fx: ledger.recovery_events(fx.view("fx_ledger_orders"), _recovery(fx)).withColumn("payload", F.to_json("payload")))

query("interrupted_receipts", f"""
WITH {_RECOVERY} SELECT DISTINCT rollout_id, problem_id, rollout_seed, 'INTERRUPTED_UNKNOWN' AS status, 'INTERRUPTED_UNKNOWN' AS error_type,
  'prior invocation ended after intent start without a receipt' AS message, FALSE AS cuda_oom
FROM fx_rollouts WHERE 'intent:' || rollout_id IN (SELECT intent_id FROM recovery WHERE action IN ('MARK_INTERRUPTED', 'SYNTHESISE_INTERRUPTED_RECEIPT'))""")(
    lambda fx: ledger.interrupted_receipts(
        fx.rollouts.select("rollout_id", "problem_id", "rollout_seed").distinct(), _recovery(fx)
    ).select("rollout_id", "problem_id", "rollout_seed", "status", "failure.error_type", "failure.message", "failure.cuda_oom"))

_AVAILABLE = f"{_CUT}, ckpt AS (SELECT 'checkpoint:r-' || CAST(doc_id AS VARCHAR) || ':token-' || CAST(checkpoint_token AS VARCHAR) AS checkpoint_id, checkpoint_token, sha256('[' || array_to_string(token_ids[1:checkpoint_token], ',') || ']') AS prefix_sha256, doc_id FROM cut WHERE availability_status = 'AVAILABLE')"


@query("interrupted_checkpoint_receipts", f"""
WITH {_AVAILABLE} SELECT checkpoint_id, checkpoint_token, prefix_sha256, 'AVAILABLE' AS availability_status, 'INTERRUPTED_UNKNOWN' AS status,
  'INTERRUPTED_UNKNOWN' AS error_type FROM ckpt WHERE doc_id % 3 = 0""")
def _interrupted_checkpoint_receipts(fx):
    """Every available checkpoint has a started intent; receipts exist for two thirds."""
    cut = trajectory.fixed_checkpoints(fx.trajectories, WORD_POSITIONS, MARKER, EOS).where("availability_status = 'AVAILABLE'")
    parent = F.concat(F.lit("r-"), F.col("doc_id").cast("string"))
    planned = cut.select(checkpoint_id(parent, F.col("checkpoint_token")).alias("checkpoint_id"), "checkpoint_token",
                         "prefix_sha256", "availability_status", "doc_id")
    started = planned.select(F.lit(1).alias("seq"), intent_id(F.col("checkpoint_id")).alias("intent_id"), F.lit("INTENT_STARTED").alias("event_type"))
    stored = planned.where(F.col("doc_id") % 3 != 0).select(F.col("checkpoint_id").alias("receipt_id"), F.lit("COMPLETED").alias("status"))
    recovery = ledger.intent_receipt_recovery(ledger.intent_states(started), stored)
    return ledger.interrupted_receipts(planned.drop("doc_id"), recovery, "checkpoint_id").select(
        "checkpoint_id", "checkpoint_token", "prefix_sha256", "availability_status", "status", "failure.error_type")


query("invocation_log", """
WITH g AS (SELECT invocation_id, count(*) FILTER (WHERE event_type = 'RUN_INVOCATION_STARTED') AS starts,
  count(*) FILTER (WHERE event_type = 'RUN_INVOCATION_FINISHED') AS finishes, min(seq) FILTER (WHERE event_type = 'RUN_INVOCATION_STARTED') AS first_seq,
  max(seq) FILTER (WHERE event_type = 'RUN_INVOCATION_FINISHED') AS last_seq FROM fx_invocations GROUP BY 1)
SELECT g.invocation_id, CAST(starts AS BIGINT) AS starts, CAST(finishes AS BIGINT) AS finishes, first_seq, f.outcome, f.error_type
FROM g LEFT JOIN fx_invocations f ON f.seq = g.last_seq WHERE starts > 0""")(
    lambda fx: ledger.invocation_log(fx.view("fx_invocations")))

# --- streaming ---------------------------------------------------------------


def _stream(fx, table: str):
    schema = fx.table(table).schema
    return fx.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(fx.sf_dir)


def _event_stream(fx):
    kind = F.col("event_type")
    event = (
        F.when(kind == "signup", "INTENT_STARTED").when(kind == "purchase", "BASE_COMPLETED")
        .when(kind == "error", "BASE_FAILED").when(kind == "view", "INTERRUPTED_UNKNOWN").otherwise("NOTE"))
    intent = F.concat(F.lit("i-"), F.col("user_id").cast("string"), F.lit("-"), F.col("ts").cast("date").cast("string"))
    return _stream(fx, "events").select(F.col("event_id").alias("seq"), intent.alias("intent_id"), event.alias("event_type"))


@query("stream_intent_states", f"""
WITH {_STATES.format("fx_ledger")} SELECT intent_id, state, violation IS NOT NULL AS is_violation FROM states""")
def _stream_intent_states(fx):
    events = _event_stream(fx)
    path = scratch_path(fx.spark, "intent-states")
    live.run_available(live.stream_intent_states(events), path, "update")
    return live.latest_updates(fx.spark, path, "intent_id")


@query("stream_intent_histories", f"WITH {_STATES.format('fx_ledger')} SELECT intent_id, state, violation FROM states")
def _stream_intent_histories(fx):
    """The stream's answers after compaction, with the exact violation."""
    path = scratch_path(fx.spark, "intent-histories")
    live.run_available(live.stream_intent_histories(_event_stream(fx)), path, "update")
    live.compact_updates(fx.spark, path, "intent_id")
    return live.latest_updates(fx.spark, path, "intent_id")


@query("stream_receipt_counts", """
SELECT CAST(l_linenumber AS BIGINT) AS checkpoint_token, coalesce(nullif(l_linestatus, 'O'), 'UNKNOWN') AS status, CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY 1, 2""")
def _stream_receipt_counts(fx):
    receipts = _stream(fx, "lineitem").select(
        F.col("l_linenumber").alias("checkpoint_token"), F.nullif("l_linestatus", F.lit("O")).alias("status"))
    path = scratch_path(fx.spark, "receipt-counts")
    live.run_available(live.stream_receipt_counts(receipts), path, "complete")
    return live.latest_complete(fx.spark, path)

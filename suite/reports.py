"""Queries over rollouts and checkpoints: eligibility, joins, aggregates, transitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.oracle_parts import (
    EVAL, POS, UNIQ, concentration, contrasts, distribution, exact_total, facts, funnel, positions_of, rates,
)
from suite.registry import RAW_ORACLES, query
from suite.views import MANIFEST_HASH, POSITIONS
from trailmark.functions.labels import derived_code, label_of_code, verdict
from trailmark.functions.receipts import normalise_evaluation
from trailmark.operators import accounting, grading, planning, stages, summary, transitions
from trailmark.params import RunContext
from trailmark.plans.analysis import analysis_sections, report_rows
from trailmark.plans.run_summary import receipts_digest, run_summary_sections
from trailmark.session import materialise


def _facts(fx, own=False):
    return transitions.transition_facts(fx.checkpoints_own if own else fx.checkpoints, fx.rollouts, POSITIONS)


# --- filters -----------------------------------------------------------------

query("completed_filter", """
SELECT rollout_id, generated_token_count FROM fx_rollouts WHERE status = 'COMPLETED'""")(
    lambda fx: stages.completed(fx.rollouts).select("rollout_id", "generated_token_count"))

query("failed_filter", """
SELECT receipt_kind, id, status FROM (
  SELECT 'base' AS receipt_kind, rollout_id AS id, status FROM fx_rollouts
  UNION ALL SELECT 'forced', parent_rollout_id, status FROM fx_checkpoints) s
WHERE status IN ('FAILED', 'INTERRUPTED_UNKNOWN')""")(
    lambda fx: stages.failed(stages.all_receipts_union(fx.rollouts, fx.checkpoints)).select(
        "receipt_kind", F.coalesce("rollout_id", "parent_rollout_id").alias("id"), "status"))

query("declared_position_filter", f"""
SELECT parent_rollout_id, checkpoint_token, status FROM fx_checkpoints WHERE checkpoint_token IN {POS}""")(
    lambda fx: fx.checkpoints.where(transitions.declared_position_filter(POSITIONS)).select(
        "parent_rollout_id", "checkpoint_token", "status"))

query("valid_correctness_filter", f"""
SELECT rollout_id, final_status, final_correct FROM fx_rollouts
WHERE final_status IN {EVAL} AND final_correct IS NOT NULL""")(
    lambda fx: fx.rollouts.where(stages.valid_correctness(F.col("final_status"), F.col("final_correct"))).select(
        "rollout_id", "final_status", "final_correct"))

query("normalise_evaluation", """
SELECT rollout_id, coalesce(final_status, 'NOT_RECORDED') AS evaluation_status, final_correct AS correct FROM fx_rollouts""")(
    lambda fx: fx.rollouts.select(
        "rollout_id", normalise_evaluation(F.col("final_status")).alias("evaluation_status"),
        F.col("final_correct").alias("correct")))

# --- joins -------------------------------------------------------------------

query("unique_base_index", f"""
WITH {UNIQ} SELECT base_id, p_verdict AS parent_verdict, coalesce(p_status, 'NOT_RECORDED') AS parent_final_status,
  p_eligible AS parent_eligible, p_elig_status AS parent_eligibility_status FROM uniq""")(
    lambda fx: transitions.unique_base_index(fx.rollouts).drop("parent_reason_codes"))

query("checkpoint_parent_join", f"""
WITH {UNIQ} SELECT parent_rollout_id, problem_id, checkpoint_token, status, base_id IS NOT NULL AS parent_found,
  p_verdict AS parent_verdict, p_eligible AS parent_eligible
FROM fx_checkpoints LEFT JOIN uniq ON parent_rollout_id = base_id""")(
    lambda fx: transitions.checkpoint_parent_join(fx.checkpoints, fx.rollouts).select(
        "parent_rollout_id", "problem_id", "checkpoint_token", "status", "parent_found",
        "parent_verdict", "parent_eligible"))

query("final_reference_fallback", f"""
WITH {UNIQ} SELECT parent_rollout_id, checkpoint_token, final_ref_status, CASE WHEN final_ref_status IS NULL THEN p_verdict
  WHEN final_ref_status IN {EVAL} THEN final_ref_correct END AS final_verdict
FROM fx_checkpoints_own LEFT JOIN uniq ON parent_rollout_id = base_id""")(
    lambda fx: transitions.final_reference_fallback(
        transitions.checkpoint_parent_join(fx.checkpoints_own, fx.rollouts)
    ).select("parent_rollout_id", "checkpoint_token", "final_ref_status", "final_verdict"))

_KEYS = f"""WITH plan AS (
  SELECT rollout_id AS parent_rollout_id, checkpoint_token FROM (SELECT DISTINCT rollout_id FROM fx_rollouts) r,
    (SELECT unnest([{', '.join(map(str, POSITIONS))}])::BIGINT AS checkpoint_token) p),
obs AS (SELECT parent_rollout_id, checkpoint_token, count(*) AS n FROM fx_checkpoints
  WHERE parent_rollout_id IS NOT NULL AND checkpoint_token IS NOT NULL GROUP BY 1, 2),
states AS (SELECT coalesce(p.parent_rollout_id, o.parent_rollout_id) AS parent_rollout_id,
  coalesce(p.checkpoint_token, o.checkpoint_token) AS checkpoint_token,
  CASE WHEN p.parent_rollout_id IS NULL THEN 'UNEXPECTED' WHEN n IS NULL THEN 'MISSING' ELSE 'RECORDED' END AS state,
  CAST(coalesce(n, 0) AS BIGINT) AS receipts, CAST(greatest(coalesce(n, 0) - 1, 0) AS BIGINT) AS duplicates
  FROM plan p FULL JOIN obs o ON p.parent_rollout_id = o.parent_rollout_id AND p.checkpoint_token = o.checkpoint_token)"""

query("plan_reconciliation", f"{_KEYS} SELECT * FROM states")(
    lambda fx: accounting.plan_reconciliation(fx.checkpoints, fx.planned, POSITIONS))

query("missing_receipts", f"{_KEYS} SELECT parent_rollout_id, checkpoint_token FROM states WHERE state = 'MISSING'")(
    lambda fx: accounting.missing_receipts(fx.checkpoints, fx.planned, POSITIONS))

query("observed_expected_sets", f"""{_KEYS} SELECT CAST(count(*) FILTER (WHERE state = 'RECORDED') AS BIGINT) AS observed_and_expected,
  CAST(count(*) FILTER (WHERE state = 'MISSING') AS BIGINT) AS expected_only,
  CAST(count(*) FILTER (WHERE state = 'UNEXPECTED') AS BIGINT) AS observed_only FROM states""")(
    lambda fx: accounting.observed_expected_sets(fx.checkpoints, fx.planned, POSITIONS))

# --- accounting --------------------------------------------------------------

query("checkpoint_accounting", f"""{_KEYS}, c AS (
  SELECT *, status AS st FROM fx_checkpoints WHERE parent_rollout_id IN (SELECT rollout_id FROM fx_rollouts) AND checkpoint_token IN {POS}),
tot AS (SELECT 5 * (SELECT count(DISTINCT rollout_id) FROM fx_rollouts) AS expected, (SELECT count(*) FROM fx_checkpoints) AS recorded,
  (SELECT count(*) FROM states WHERE state = 'RECORDED') AS ue, (SELECT sum(duplicates) FROM states) AS dup,
  (SELECT sum(receipts) FROM states WHERE state = 'UNEXPECTED') AS unexpected,
  (SELECT count(*) FROM fx_checkpoints WHERE parent_rollout_id IS NULL OR checkpoint_token IS NULL) AS malformed),
pos AS (SELECT checkpoint_token, count(*) AS expected_receipts, count(*) FILTER (WHERE state = 'RECORDED') AS u, sum(receipts) AS r
  FROM states WHERE state <> 'UNEXPECTED' GROUP BY 1),
long AS (
  SELECT 'all' AS scope, 'expected' AS metric, expected AS n FROM tot UNION ALL SELECT 'all', 'recorded', recorded FROM tot
  UNION ALL SELECT 'all', 'recorded_unique_expected', ue FROM tot UNION ALL SELECT 'all', 'missing', expected - ue FROM tot
  UNION ALL SELECT 'all', 'unexpected', unexpected FROM tot UNION ALL SELECT 'all', 'duplicate_logical', dup FROM tot
  UNION ALL SELECT 'all', 'malformed_identity', malformed FROM tot
  UNION ALL SELECT checkpoint_token::VARCHAR, 'expected_receipts', expected_receipts FROM pos
  UNION ALL SELECT checkpoint_token::VARCHAR, 'recorded_unique_expected_receipts', u FROM pos
  UNION ALL SELECT checkpoint_token::VARCHAR, 'missing_expected_receipts', expected_receipts - u FROM pos
  UNION ALL SELECT checkpoint_token::VARCHAR, 'recorded_receipts', r FROM pos WHERE r > 0
  UNION ALL SELECT checkpoint_token::VARCHAR, 'receipt_status:' || status, count(*) FROM c GROUP BY 1, 2
  UNION ALL SELECT checkpoint_token::VARCHAR, 'availability_status:' || availability_status, count(*) FROM c GROUP BY 1, 2)
SELECT scope, metric, CAST(n AS BIGINT) AS n FROM long""")(
    lambda fx: accounting.checkpoint_accounting(fx.checkpoints, fx.planned, POSITIONS))

_AVAILABILITY = f"""SELECT checkpoint_token, metric, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT checkpoint_token, availability_status AS metric FROM fx_checkpoints WHERE checkpoint_token IS NOT NULL
  UNION ALL SELECT checkpoint_token, 'receipt_' || status FROM fx_checkpoints WHERE checkpoint_token IS NOT NULL) s GROUP BY 1, 2
UNION ALL SELECT CAST(p AS BIGINT), NULL, CAST(0 AS BIGINT) FROM (SELECT unnest({list(POSITIONS)}) AS p) d
  WHERE p NOT IN (SELECT checkpoint_token FROM fx_checkpoints WHERE checkpoint_token IS NOT NULL)"""
query("availability_by_position", _AVAILABILITY)(
    lambda fx: accounting.availability_by_position(fx.checkpoints, POSITIONS))

query("report_position_keys", f"""SELECT checkpoint_token, metric, n, CAST(checkpoint_token AS VARCHAR) AS position_key
FROM ({_AVAILABILITY}) a ORDER BY CAST(checkpoint_token AS INTEGER)""")(
    lambda fx: accounting.report_position_keys(accounting.availability_by_position(fx.checkpoints, POSITIONS)))

# --- stage summaries ---------------------------------------------------------

for _kind, _view, _st, _ok in (("base", "fx_rollouts", "final_status", "final_correct"),
                               ("forced", "fx_checkpoints", "forced_status", "forced_correct")):
    _get = (lambda name: lambda fx: fx.view(name))(_view)
    _suffix = "" if _kind == "base" else "_forced"

    query("receipt_status_counts" + _suffix, f"""
SELECT coalesce(status, 'UNKNOWN') AS status, CAST(count(*) AS BIGINT) AS n FROM {_view} GROUP BY 1""")(
        lambda fx, get=_get: stages.receipt_status_counts(get(fx)))

    query("stage_evaluation_counts" + _suffix, f"""
SELECT CAST(count(*) AS BIGINT) AS receipts,
  CAST(count(*) FILTER (WHERE {_st} IN {EVAL} AND {_ok} IS NOT NULL) AS BIGINT) AS evaluable,
  CAST(count(*) FILTER (WHERE {_st} IN {EVAL} AND {_ok}) AS BIGINT) AS correct,
  CAST(count(*) FILTER (WHERE {_st} IN {EVAL} AND NOT {_ok}) AS BIGINT) AS incorrect,
  CAST(count(*) FILTER (WHERE {_st} = 'NON_EVALUABLE') AS BIGINT) AS non_evaluable,
  CAST(count(*) FILTER (WHERE {_st} = 'ERROR') AS BIGINT) AS errors,
  CAST(count(*) FILTER (WHERE {_st} IN {EVAL} AND {_ok} IS NULL) AS BIGINT) AS malformed,
  CAST(count(*) FILTER (WHERE {_st} IS NULL) AS BIGINT) AS not_recorded FROM {_view}""")(
        lambda fx, get=_get, st=_st, ok=_ok: stages.stage_evaluation_counts(get(fx), st, ok))

    query("failure_summary" + _suffix, f"""
SELECT CAST(count(*) FILTER (WHERE status IN ('FAILED','INTERRUPTED_UNKNOWN')) AS BIGINT) AS failed_or_interrupted,
  CAST(count(*) FILTER (WHERE cuda_oom) AS BIGINT) AS explicit_oom FROM {_view}""")(
        lambda fx, get=_get: stages.failure_summary(get(fx)))

    query("failure_kind" + _suffix, f"""
SELECT coalesce(nullif(error_type, ''), 'NOT_RECORDED') AS error_type, CAST(count(*) AS BIGINT) AS n
FROM {_view} WHERE status IN ('FAILED','INTERRUPTED_UNKNOWN') GROUP BY 1""")(
        lambda fx, get=_get: stages.failure_type_counts(get(fx)))

    query("termination_counts" + _suffix, f"""
SELECT coalesce(termination_status, 'NOT_RECORDED') AS termination_status, CAST(count(*) AS BIGINT) AS n
FROM {_view} WHERE status = 'COMPLETED' AND generation_recorded GROUP BY 1""")(
        lambda fx, get=_get: stages.termination_counts(get(fx)))

    query("termination_summary" + _suffix, f"""
SELECT CAST(count(*) FILTER (WHERE status = 'COMPLETED' AND generation_recorded AND termination_status = 'MAX_NEW_TOKENS') AS BIGINT) AS cap_reached,
  CAST(count(*) FILTER (WHERE status = 'COMPLETED' AND NOT generation_recorded) AS BIGINT) AS completed_without_generation FROM {_view}""")(
        lambda fx, get=_get: stages.termination_summary(get(fx)))

    query("generation_performance" + _suffix, f"""
SELECT CAST(count(*) AS BIGINT) AS generations, CAST(coalesce(sum(generated_token_count), 0) AS BIGINT) AS token_total,
  CAST(count(generated_token_count) AS BIGINT) AS tokens_recorded,
  coalesce({exact_total('elapsed_seconds')}, 0) AS elapsed_total,
  CAST(count(elapsed_seconds) AS BIGINT) AS elapsed_recorded,
  CAST(count(*) FILTER (WHERE generated_token_count IS NOT NULL AND elapsed_seconds IS NOT NULL) AS BIGINT) AS paired,
  CAST(count(*) FILTER (WHERE generated_token_count IS NOT NULL AND elapsed_seconds = 0) AS BIGINT) AS zero_elapsed,
  CAST(sum(generated_token_count) AS DOUBLE) / nullif({exact_total('elapsed_seconds')}, 0) AS tokens_per_second
FROM {_view} WHERE status = 'COMPLETED' AND generation_recorded""")(
        lambda fx, get=_get: stages.generation_performance(get(fx)))

    _done = f"{_view} WHERE status = 'COMPLETED' AND generation_recorded"
    query("numeric_distribution" + _suffix, f"""
SELECT metric, count, round(total, 4) AS total, round(mean, 6) AS mean, min, p25, p50, p75, p90, max FROM ({distribution({
        "runtime_seconds": ("elapsed_seconds", _done),
        "tokens_per_second": ("CASE WHEN elapsed_seconds > 0 THEN generated_token_count / elapsed_seconds END", _done)})}) d""")(
        lambda fx, get=_get: stages.generation_distributions(get(fx)).withColumns(
            {"total": F.round("total", 4), "mean": F.round("mean", 6)}))

    query("peak_memory" + _suffix, f"""
SELECT max(peak_allocated_bytes) AS peak_allocated_bytes, max(peak_reserved_bytes) AS peak_reserved_bytes,
  CAST(count(peak_allocated_bytes) AS BIGINT) AS allocated_measurements, CAST(count(peak_reserved_bytes) AS BIGINT) AS reserved_measurements
FROM {_done}""")(
        lambda fx, get=_get: stages.peak_memory(get(fx)))

    query("eligibility_summary" + _suffix, f"""
SELECT counter, key, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'receipts' AS counter, CASE WHEN eligible THEN 'ELIGIBLE' ELSE 'EXCLUDED' END AS key FROM {_view}
  UNION ALL SELECT 'status', eligibility_status FROM {_view}
  UNION ALL SELECT 'exclusion_reason', reason_code FROM {_view} WHERE NOT eligible AND reason_code IS NOT NULL) s GROUP BY 1, 2""")(
        lambda fx, get=_get: stages.eligibility_summary(get(fx)))

    query("stage_overview" + _suffix, f"""
SELECT CAST(count(*) AS BIGINT) AS receipts,
  CAST(count(*) FILTER (WHERE {_st} IN {EVAL} AND {_ok} IS NOT NULL) AS BIGINT) AS evaluable,
  CAST(count(*) FILTER (WHERE {_st} IN {EVAL} AND {_ok}) AS BIGINT) AS correct,
  CAST(count(*) FILTER (WHERE {_st} IN {EVAL} AND NOT {_ok}) AS BIGINT) AS incorrect,
  CAST(count(*) FILTER (WHERE {_st} = 'NON_EVALUABLE') AS BIGINT) AS non_evaluable,
  CAST(count(*) FILTER (WHERE {_st} = 'ERROR') AS BIGINT) AS errors,
  CAST(count(*) FILTER (WHERE {_st} IN {EVAL} AND {_ok} IS NULL) AS BIGINT) AS malformed,
  CAST(count(*) FILTER (WHERE {_st} IS NULL) AS BIGINT) AS not_recorded,
  CAST(count(*) FILTER (WHERE status IN ('FAILED','INTERRUPTED_UNKNOWN')) AS BIGINT) AS failed_or_interrupted,
  CAST(count(*) FILTER (WHERE cuda_oom) AS BIGINT) AS explicit_oom,
  CAST(count(*) FILTER (WHERE generation_recorded AND termination_status = 'MAX_NEW_TOKENS') AS BIGINT) AS cap_reached,
  CAST(count(*) FILTER (WHERE status = 'COMPLETED' AND NOT generation_recorded) AS BIGINT) AS completed_without_generation,
  CAST(count(*) FILTER (WHERE generation_recorded) AS BIGINT) AS generations,
  CAST(sum(generated_token_count) FILTER (WHERE generation_recorded) AS BIGINT) AS token_total,
  CAST(count(generated_token_count) FILTER (WHERE generation_recorded) AS BIGINT) AS tokens_recorded,
  {exact_total('CASE WHEN generation_recorded THEN elapsed_seconds END')} AS elapsed_total,
  CAST(count(elapsed_seconds) FILTER (WHERE generation_recorded) AS BIGINT) AS elapsed_recorded,
  CAST(count(*) FILTER (WHERE generation_recorded AND generated_token_count IS NOT NULL AND elapsed_seconds IS NOT NULL) AS BIGINT) AS paired,
  CAST(count(*) FILTER (WHERE generation_recorded AND elapsed_seconds = 0) AS BIGINT) AS zero_elapsed,
  max(peak_allocated_bytes) FILTER (WHERE generation_recorded) AS peak_allocated_bytes,
  max(peak_reserved_bytes) FILTER (WHERE generation_recorded) AS peak_reserved_bytes,
  CAST(count(peak_allocated_bytes) FILTER (WHERE generation_recorded) AS BIGINT) AS allocated_measurements,
  CAST(count(peak_reserved_bytes) FILTER (WHERE generation_recorded) AS BIGINT) AS reserved_measurements,
  CAST(sum(generated_token_count) FILTER (WHERE generation_recorded) AS DOUBLE)
    / {exact_total('CASE WHEN generation_recorded THEN elapsed_seconds END')} AS tokens_per_second FROM {_view}""")(
        lambda fx, get=_get, st=_st, ok=_ok: stages.stage_overview(get(fx), st, ok))

    query("stage_counters" + _suffix, f"""
SELECT counter, key, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'receipt_status' AS counter, status AS key FROM {_view}
  UNION ALL SELECT 'evaluation', coalesce({_st}, 'NOT_RECORDED') FROM {_view}
  UNION ALL SELECT 'failure_type', coalesce(error_type, 'NOT_RECORDED') FROM {_view} WHERE status IN ('FAILED','INTERRUPTED_UNKNOWN')
  UNION ALL SELECT 'termination', termination_status FROM {_view} WHERE generation_recorded
  UNION ALL SELECT 'eligibility', CASE WHEN eligible THEN 'ELIGIBLE' ELSE 'EXCLUDED' END FROM {_view}
  UNION ALL SELECT 'eligibility_status', eligibility_status FROM {_view}
  UNION ALL SELECT 'exclusion_reason', reason_code FROM {_view} WHERE NOT eligible AND reason_code IS NOT NULL) s GROUP BY 1, 2""")(
        lambda fx, get=_get, st=_st: stages.stage_counters(get(fx), st))

query("failure_counts_by_kind", """
SELECT coalesce(error_type, 'UNKNOWN_FAILURE') AS error_type, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT status, error_type FROM fx_rollouts UNION ALL SELECT status, error_type FROM fx_checkpoints) s
WHERE status = 'FAILED' GROUP BY 1""")(
    lambda fx: stages.failure_counts_by_kind(stages.all_receipts_union(fx.rollouts, fx.checkpoints)))

query("all_receipts_union", """
SELECT receipt_kind, status, CAST(count(*) AS BIGINT) AS n, max(peak_allocated_bytes) AS peak_allocated_bytes FROM (
  SELECT 'base' AS receipt_kind, status, peak_allocated_bytes FROM fx_rollouts
  UNION ALL SELECT 'forced', status, peak_allocated_bytes FROM fx_checkpoints) s GROUP BY 1, 2""")(
    lambda fx: stages.all_receipts_union(fx.rollouts, fx.checkpoints).groupBy("receipt_kind", "status").agg(
        F.count("*").alias("n"), F.max("peak_allocated_bytes").alias("peak_allocated_bytes")))

query("length_distribution", distribution(
    {"length_tokens": ("generated_token_count", "fx_rollouts WHERE status = 'COMPLETED'")}))(
    lambda fx: stages.length_distribution(fx.rollouts))

query("exact_distribution", f"""
WITH t AS (
  SELECT 'speed' AS metric, {exact_total('x')} AS total, count(*) AS n, min(x) AS lo, max(x) AS hi FROM (SELECT CAST(l_extendedprice AS DOUBLE) / (l_partkey + 1) AS x FROM lineitem) s
  UNION ALL SELECT 'huge', CAST(sum(CAST(l_quantity AS HUGEINT)) * 10000000000000000 AS DOUBLE), count(*), min(CAST(l_quantity AS DOUBLE)) * 1e16, max(CAST(l_quantity AS DOUBLE)) * 1e16 FROM lineitem
  UNION ALL SELECT 'tiny', count(*) * 3e-12, count(*), 3e-12, 3e-12 FROM lineitem
  UNION ALL SELECT 'vast', count(*) * 1e300, count(*), 1e300, 1e300 FROM lineitem)
SELECT metric, CAST(n AS BIGINT) AS count, total, total / CAST(n AS DOUBLE) AS mean, lo AS min, hi AS max FROM t""")(
    lambda fx: stages.numeric_distribution(fx.table("lineitem"), {
        "speed": F.col("l_extendedprice").cast("double") / (F.col("l_partkey") + 1), "huge": F.col("l_quantity").cast("double") * 1e16,
        "tiny": F.lit(3e-12), "vast": F.lit(1e300)}).select("metric", "count", "total", "mean", "min", "max"))

query("runtime_mean_median", f"""
SELECT {exact_total('elapsed_seconds')} / CAST(count(elapsed_seconds) AS DOUBLE) AS mean_seconds,
  quantile_cont(elapsed_seconds, 0.5) AS median_seconds FROM fx_rollouts WHERE status = 'COMPLETED'""")(
    lambda fx: stages.runtime_mean_median(fx.rollouts))

query("final_accuracy", f"""
SELECT *, CAST(correct AS DOUBLE) / nullif(CAST(evaluable AS DOUBLE), 0) AS accuracy FROM (
SELECT CAST(count(*) AS BIGINT) AS completed, CAST(count(*) FILTER (WHERE NOT eligible) AS BIGINT) AS excluded,
  CAST(count(*) FILTER (WHERE eligible) AS BIGINT) AS eligible,
  CAST(count(*) FILTER (WHERE eligible AND final_status IN {EVAL} AND final_correct IS NOT NULL) AS BIGINT) AS evaluable,
  CAST(count(*) FILTER (WHERE eligible AND final_status IN {EVAL} AND final_correct) AS BIGINT) AS correct,
  CAST(count(*) FILTER (WHERE eligible AND final_status IN {EVAL} AND NOT final_correct) AS BIGINT) AS incorrect,
  CAST(count(*) FILTER (WHERE eligible AND final_status = 'NON_EVALUABLE') AS BIGINT) AS non_evaluable,
  CAST(count(*) FILTER (WHERE eligible AND final_status = 'ERROR') AS BIGINT) AS errors,
  CAST(count(*) FILTER (WHERE eligible AND final_status IN {EVAL} AND final_correct IS NULL) AS BIGINT) AS malformed
FROM fx_rollouts WHERE status = 'COMPLETED') s""")(
    lambda fx: stages.final_accuracy(fx.rollouts))

query("accuracy_status_counts", """
SELECT coalesce(final_status, 'NOT_RECORDED') AS evaluation_status, CAST(count(*) AS BIGINT) AS n
FROM fx_rollouts WHERE status = 'COMPLETED' AND eligible GROUP BY 1""")(
    lambda fx: stages.accuracy_status_counts(fx.rollouts))

query("evaluation_invariant", f"""
SELECT rollout_id, final_status, final_correct, 'EVALUATED_WITHOUT_CORRECTNESS' AS violation FROM fx_rollouts
WHERE final_status IN {EVAL} AND final_correct IS NULL""")(
    lambda fx: grading.evaluation_violations(fx.rollouts, "final_status", "final_correct").select(
        "rollout_id", "final_status", "final_correct", "violation"))

# --- transitions -------------------------------------------------------------

query("transition_facts", f"""
WITH {facts("fx_checkpoints_own")} SELECT parent_rollout_id, problem_id, checkpoint_token, stage, primary_label, observed_label,
  effective AS effective_eligibility FROM facts""")(
    lambda fx: _facts(fx, own=True).select(
        "parent_rollout_id", "problem_id", "checkpoint_token", "stage", "primary_label", "observed_label",
        "effective_eligibility"))

query("transition_funnel", funnel("fx_checkpoints"))(
    lambda fx: transitions.transition_funnel(fx.checkpoints, fx.rollouts, POSITIONS))
query("transition_funnel_own_references", funnel("fx_checkpoints_own"))(
    lambda fx: transitions.transition_funnel(fx.checkpoints_own, fx.rollouts, POSITIONS))

query("validated_label", f"""
WITH {facts("fx_checkpoints_own")} SELECT parent_rollout_id, checkpoint_token, primary_label, primary_label_status,
  observed_label, observed_label_status FROM facts""")(
    lambda fx: _facts(fx, own=True).select(
        "parent_rollout_id", "checkpoint_token", "primary_label", "primary_label_status",
        "observed_label", "observed_label_status"))

query("classify_transition", f"""
WITH {facts("fx_checkpoints_own")} SELECT parent_rollout_id, checkpoint_token, derived AS label FROM derived""")(
    lambda fx: transitions.final_reference_fallback(
        transitions.checkpoint_parent_join(
            fx.checkpoints_own.where(transitions.declared_position_filter(POSITIONS) & (F.col("status") == "COMPLETED")),
            fx.rollouts)
    ).select("parent_rollout_id", "checkpoint_token", label_of_code(derived_code(
        verdict(F.col("forced_status"), F.col("forced_correct")), F.col("final_verdict"))).alias("label")))

for _name, _label, _own in (("primary_transitions", "primary_label", False), ("observed_transitions", "observed_label", True)):
    _src = "fx_checkpoints_own" if _own else "fx_checkpoints"
    _rows = getattr(transitions, _name)
    _view_name = _name.split("_")[0]
    query(_name, f"""WITH {facts(_src)} SELECT {_label} AS label, problem_id, checkpoint_token FROM facts WHERE {_label} IS NOT NULL""")(
        lambda fx, rows=_rows, own=_own: rows(_facts(fx, own)))
    _tail = "" if _view_name == "primary" else "_observed"
    query("transition_rates_by_checkpoint" + _tail, rates(_src, _label))(
        lambda fx, rows=_rows, own=_own: transitions.transition_rates_by_checkpoint(rows(_facts(fx, own)), POSITIONS))
    query("matched_contrasts" + _tail, contrasts(_src, _label))(
        lambda fx, rows=_rows, own=_own: transitions.matched_contrasts(rows(_facts(fx, own)), POSITIONS))
    query("event_concentration" + _tail, concentration(_src, _label))(
        lambda fx, rows=_rows, own=_own: transitions.event_concentration(rows(_facts(fx, own)), POSITIONS))
    query("concentration_positions" + _tail, positions_of(_src, _label))(
        lambda fx, rows=_rows, own=_own: transitions.concentration_positions(rows(_facts(fx, own))))

# --- run level ---------------------------------------------------------------

query("operational_summary", f"""
WITH b AS (SELECT CAST(count(DISTINCT problem_id) AS BIGINT) AS problems_attempted,
  CAST(count(DISTINCT problem_id) FILTER (WHERE status = 'COMPLETED') AS BIGINT) AS problems_completed,
  CAST(count(*) AS BIGINT) AS trajectories_recorded, CAST(count(DISTINCT rollout_id) FILTER (WHERE status = 'COMPLETED') AS BIGINT) AS trajectories_completed,
  CAST(sum(generated_token_count) AS BIGINT) AS bt, count(*) FILTER (WHERE final_status = 'NON_EVALUABLE') AS bn,
  count(*) FILTER (WHERE final_status = 'ERROR') AS be, count(*) FILTER (WHERE status = 'FAILED') AS bf,
  count(*) FILTER (WHERE status = 'INTERRUPTED_UNKNOWN') AS bi, max(peak_allocated_bytes) AS ba, max(peak_reserved_bytes) AS br,
  {exact_total("CASE WHEN status = 'COMPLETED' THEN elapsed_seconds END")}
    / CAST(count(CASE WHEN status = 'COMPLETED' THEN elapsed_seconds END) AS DOUBLE) AS mean_seconds,
  quantile_cont(CASE WHEN status = 'COMPLETED' THEN elapsed_seconds END, 0.5) AS median_seconds FROM fx_rollouts),
f AS (SELECT CAST(count(*) AS BIGINT) AS checkpoints_recorded, CAST(sum(generated_token_count) AS BIGINT) AS ft,
  count(*) FILTER (WHERE forced_status = 'NON_EVALUABLE') AS fn, count(*) FILTER (WHERE forced_status = 'ERROR') AS fe,
  count(*) FILTER (WHERE status = 'FAILED') AS ff, count(*) FILTER (WHERE status = 'INTERRUPTED_UNKNOWN') AS fi,
  max(peak_allocated_bytes) AS fa, max(peak_reserved_bytes) AS fr,
  {', '.join(f"CAST(count(*) FILTER (WHERE transition_label = '{n}') AS BIGINT) AS {n.lower()}" for n in ('W_TO_C', 'W_TO_W', 'C_TO_C', 'C_TO_W'))}
  FROM fx_checkpoints)
SELECT problems_attempted, problems_completed, CAST(NULL AS BIGINT) AS problems_planned, CAST(NULL AS BIGINT) AS trajectories_planned,
  trajectories_recorded, trajectories_completed, checkpoints_recorded, bt AS base_generated_tokens, ft AS forced_generated_tokens,
  bt + ft AS total_generated_tokens, w_to_c, w_to_w, c_to_c, c_to_w, CAST(bn + fn AS BIGINT) AS non_evaluable,
  CAST(be + fe AS BIGINT) AS evaluation_errors, CAST(bf + ff AS BIGINT) AS failures, CAST(bi + fi AS BIGINT) AS interrupted_unknown,
  mean_seconds, median_seconds, greatest(ba, fa) AS peak_allocated_bytes, greatest(br, fr) AS peak_reserved_bytes FROM b, f""")(
    lambda fx: summary.operational_summary(fx.rollouts, fx.checkpoints))

query("campaign_rates", f"""
WITH b AS (SELECT count(*) FILTER (WHERE status = 'COMPLETED') AS completed,
  count(*) FILTER (WHERE final_status = 'CORRECT' AND final_correct) AS correct,
  count(*) FILTER (WHERE (final_status = 'CORRECT' AND final_correct) OR (final_status = 'INCORRECT' AND NOT final_correct)) AS evaluable,
  count(*) FILTER (WHERE status = 'COMPLETED' AND final_status = 'NON_EVALUABLE') AS bn,
  sum(generated_token_count) AS bt, {exact_total('elapsed_seconds')} AS bs FROM fx_rollouts),
f AS (SELECT count(*) FILTER (WHERE availability_status = 'AVAILABLE') AS available,
  count(*) FILTER (WHERE availability_status = 'AVAILABLE' AND forced_status = 'NON_EVALUABLE') AS fn,
  sum(generated_token_count) AS ft, {exact_total('elapsed_seconds')} AS fs FROM fx_checkpoints)
SELECT correct::DOUBLE / evaluable::DOUBLE AS conditional_accuracy, bn::DOUBLE / completed::DOUBLE AS base_non_evaluable_rate,
  fn::DOUBLE / available::DOUBLE AS forced_non_evaluable_rate, bt::DOUBLE / bs::DOUBLE AS base_tokens_per_second,
  ft::DOUBLE / fs::DOUBLE AS forced_tokens_per_second, (bt + ft)::DOUBLE / (bs + fs)::DOUBLE AS combined_tokens_per_second FROM b, f""")(
    lambda fx: summary.campaign_rates(fx.rollouts, fx.checkpoints))

DEVICE_BYTES = 8589410304

query("stage_gate", f"""
WITH b AS (SELECT count(*) AS attempted, count(*) FILTER (WHERE cuda_oom OR status = 'INTERRUPTED_UNKNOWN') AS faults,
  count(*) FILTER (WHERE status = 'FAILED') AS failures, max(peak_reserved_bytes) AS peak,
  {exact_total('elapsed_seconds')} AS s FROM fx_rollouts),
f AS (SELECT count(*) FILTER (WHERE availability_status = 'AVAILABLE') AS available,
  count(*) FILTER (WHERE cuda_oom OR status = 'INTERRUPTED_UNKNOWN') AS faults,
  count(*) FILTER (WHERE availability_status = 'AVAILABLE' AND status = 'FAILED') AS failures, max(peak_reserved_bytes) AS peak,
  {exact_total('elapsed_seconds')} AS s FROM fx_checkpoints),
m AS (SELECT CAST(b.failures AS BIGINT) AS base_failures, CAST(b.faults + f.faults AS BIGINT) AS faults,
  f.failures::DOUBLE / available::DOUBLE AS forced_failure_share, CAST({DEVICE_BYTES} - greatest(b.peak, f.peak) AS BIGINT) AS headroom_bytes,
  (b.s + f.s) / attempted::DOUBLE * 80 / 3600 AS projected_hours FROM b, f)
SELECT *, no_faults AND failures_within_limit AND memory_headroom AND time_within_limit AS extend FROM (
  SELECT *, faults = 0 AS no_faults, base_failures = 0 AND forced_failure_share <= 0.05 AS failures_within_limit,
    headroom_bytes >= 536870912 AS memory_headroom, projected_hours <= 12 AS time_within_limit FROM m) s""")(
    lambda fx: summary.stage_gate(fx.rollouts, fx.checkpoints, DEVICE_BYTES, 80))

query("receipt_batch_digest", """
WITH leaf AS (SELECT sha256(rollout_id || '|' || sha256(rollout_id || ',' || problem_id || ',' || status) || '|' || CAST(count(*) AS VARCHAR)) AS node
  FROM fx_rollouts GROUP BY rollout_id, problem_id, status),
l1 AS (SELECT left(node, 4) AS slot, sha256(left(node, 4) || ':' || string_agg(node, '' ORDER BY node)) AS node FROM leaf GROUP BY 1),
l2 AS (SELECT left(slot, 2) AS slot2, sha256(left(slot, 2) || ':' || string_agg(node, '' ORDER BY node)) AS node FROM l1 GROUP BY 1)
SELECT sha256('root:' || string_agg(node, '' ORDER BY node)) AS digest, (SELECT CAST(count(*) AS BIGINT) FROM fx_rollouts) AS record_count FROM l2""")(
    lambda fx: summary.batch_digest(
        fx.rollouts.select("rollout_id", F.sha2(F.concat_ws(",", "rollout_id", "problem_id", "status"), 256).alias("content_hash")),
        "rollout_id", "content_hash"))

query("sorted_reports", """
SELECT coalesce(status, 'UNKNOWN') AS status, CAST(count(*) AS BIGINT) AS n FROM fx_checkpoints GROUP BY 1 ORDER BY 1""")(
    lambda fx: stages.receipt_status_counts(fx.checkpoints).orderBy("status"))

_RATE = tuple(f"{n}_rate" for n in ("w_to_c", "w_to_w", "c_to_c", "c_to_w"))
_SUMMARY = ("count", "total", "mean", "min", "p25", "p50", "p75", "p90", "max")
# Section -> (registered oracle, row keys, measures).
_SECTIONS = {
    "final_answer_accuracy": ("final_accuracy", (), (
        "completed", "excluded", "eligible", "evaluable", "correct", "incorrect", "non_evaluable", "errors", "malformed", "accuracy")),
    "accuracy_status_counts": ("accuracy_status_counts", ("evaluation_status",), ("n",)),
    "base_trajectory_length": ("length_distribution", ("metric",), _SUMMARY),
    "checkpoint_accounting": ("checkpoint_accounting", ("scope", "metric"), ("n",)),
    "transition_funnel": ("transition_funnel", ("counter", "key"), ("n",)),
}
_OVERVIEW = (
    "receipts", "evaluable", "correct", "incorrect", "non_evaluable", "errors", "malformed", "not_recorded",
    "failed_or_interrupted", "explicit_oom", "cap_reached", "completed_without_generation", "generations", "token_total",
    "tokens_recorded", "elapsed_total", "elapsed_recorded", "paired", "zero_elapsed", "peak_allocated_bytes",
    "peak_reserved_bytes", "allocated_measurements", "reserved_measurements", "tokens_per_second")
for _kind, _suffix in (("base", ""), ("forced", "_forced")):
    _SECTIONS[f"{_kind}_overview"] = ("stage_overview" + _suffix, (), _OVERVIEW)
    _SECTIONS[f"{_kind}_counters"] = ("stage_counters" + _suffix, ("counter", "key"), ("n",))
    _SECTIONS[f"{_kind}_generation_distributions"] = ("numeric_distribution" + _suffix, ("metric",), _SUMMARY)
_TRANSITION_SECTIONS = {
    "rates": (rates, ("checkpoint_token",), (
        "evaluable_transitions", "w_to_c", "w_to_w", "c_to_c", "c_to_w", *_RATE,
        "wrong_checkpoint_transitions", "recovery_rate", "non_recovery_rate")),
    "contrasts": (contrasts, ("scope",), transitions.CONTRAST_METRICS),
    "concentration": (concentration, ("label",), (
        "event_count", "distinct_problems", "distinct_groups", "distinct_positions", "max_events_in_problem", "max_problem_share",
        "max_events_in_group", "max_group_share", "herfindahl_by_problem", "herfindahl_by_group")),
    "concentration_positions": (positions_of, ("label", "checkpoint_token"), ("event_count",)),
}


def _report_oracle() -> str:
    parts = []

    def add(section, sql, keys, measures):
        key = " || '/' || ".join(f"CAST({k} AS VARCHAR)" for k in keys) or "''"
        names = ", ".join(f"'{m}'" for m in measures)
        values = ", ".join(f"round(CAST({m} AS DOUBLE), 4)" for m in measures)
        parts.append(f"SELECT '{section}' AS section, {key} AS key, unnest([{names}]) AS metric, unnest([{values}]) AS value FROM ({sql}) q")

    for section, (name, keys, measures) in _SECTIONS.items():
        add(section, RAW_ORACLES[name], keys, measures)
    for view in ("primary", "observed"):
        for section, (sql, keys, measures) in _TRANSITION_SECTIONS.items():
            add(f"{view}_{section}", sql("fx_checkpoints", f"{view}_label"), keys, measures)
    return "\nUNION ALL ".join(parts)


@query("analysis_report", _report_oracle())
def _analysis_report(fx):
    """Typed receipts are landed once, as in a real campaign; all sections read the landed tables."""
    rollouts, checkpoints = materialise(fx.rollouts, "rollouts"), materialise(fx.checkpoints, "checkpoints")
    planned = rollouts.select("rollout_id").distinct()
    report = report_rows(analysis_sections(rollouts, checkpoints, planned, POSITIONS))
    return report.withColumn("value", F.round(F.col("value").cast("double"), 4))


# --- run summary -------------------------------------------------------------

RUN = RunContext("run-1", MANIFEST_HASH, "c" * 64, "d" * 64)
_TEXTS = ("rollout_id", "problem_id", "status", "final_status", "termination_status", "error_type", "eligibility_status")
_OTHERS = ("rollout_seed", "final_correct", "generation_recorded", "generated_token_count", "elapsed_seconds", "peak_allocated_bytes",
           "peak_reserved_bytes", "cuda_oom", "eligible")


def _digest_sql(view: str, key: str, texts, others) -> str:
    """The hash tree over the canonical JSON of whole rows, whose texts need no escapes."""
    fields = {n: f"coalesce('\"' || {n} || '\"', 'null')" for n in texts} | {n: f"coalesce(CAST({n} AS VARCHAR), 'null')" for n in others}
    fields["reason_codes"] = "CASE WHEN reason_code IS NULL THEN '[]' ELSE '[\"' || reason_code || '\"]' END"
    record = " || ',' || ".join(f"'\"{n}\":' || {fields[n]}" for n in sorted(fields))
    return f"""WITH leaf AS (SELECT sha256({key} || '|' || hash || '|' || CAST(count(*) AS VARCHAR)) AS node
  FROM (SELECT {key}, sha256('{{' || {record} || '}}') AS hash FROM {view}) h GROUP BY {key}, hash),
l1 AS (SELECT left(node, 4) AS slot, sha256(left(node, 4) || ':' || string_agg(node, '' ORDER BY node)) AS node FROM leaf GROUP BY 1),
l2 AS (SELECT left(slot, 2) AS slot2, sha256(left(slot, 2) || ':' || string_agg(node, '' ORDER BY node)) AS node FROM l1 GROUP BY 1)
SELECT sha256('root:' || string_agg(node, '' ORDER BY node)) AS digest, (SELECT CAST(count(*) AS BIGINT) FROM {view}) AS record_count FROM l2"""


query("receipt_batch_digest_whole_rows", _digest_sql("fx_rollouts", "rollout_id", _TEXTS, _OTHERS))(
    lambda fx: receipts_digest(fx.rollouts, "rollout_id"))

_FORCED_TEXTS = (
    "parent_rollout_id", "problem_id", "status", "availability_status", "forced_status", "own_ref_status", "own_observed_label",
    "transition_label", "termination_status", "error_type", "eligibility_status", "final_ref_status", "observed_transition_label")
_FORCED_OTHERS = (
    "checkpoint_token", "forced_correct", "own_ref_correct", "generation_recorded", "generated_token_count", "elapsed_seconds",
    "peak_allocated_bytes", "peak_reserved_bytes", "cuda_oom", "eligible", "final_ref_correct")
query("receipt_batch_digest_whole_rows_forced", _digest_sql("fx_checkpoints", "parent_rollout_id", _FORCED_TEXTS, _FORCED_OTHERS))(
    lambda fx: receipts_digest(fx.checkpoints, "parent_rollout_id"))

_PLANNED = """SELECT DISTINCT problem_id, rollout_id FROM fx_rollouts
UNION ALL SELECT 'p-' || CAST(c_custkey AS VARCHAR), 'planned-' || CAST(c_custkey AS VARCHAR) FROM customer"""


def _planned_scope(fx):
    """All rollouts and one more of every customer, most of them never run."""
    customer = F.col("c_custkey").cast("string")
    more = fx.table("customer").select(F.concat(F.lit("p-"), customer).alias("problem_id"), F.concat(F.lit("planned-"), customer).alias("rollout_id"))
    return fx.rollouts.select("problem_id", "rollout_id").distinct().unionByName(more)


def _run_summary_oracle() -> str:
    totals = RAW_ORACLES["operational_summary"]
    for name, column in (("problems_planned", "problem_id"), ("trajectories_planned", "rollout_id")):
        totals = totals.replace(f"CAST(NULL AS BIGINT) AS {name}", f"(SELECT CAST(count(DISTINCT {column}) AS BIGINT) FROM ({_PLANNED}) p) AS {name}")
    digest = _digest_sql("fx_rollouts", "rollout_id", _TEXTS, _OTHERS)
    run = f"SELECT 'run-1' AS run_id, '{MANIFEST_HASH}' AS manifest_hash, '{RUN.config_hash}' AS config_hash, CAST(NULL AS VARCHAR) AS source_git_commit"
    counts = lambda view, column, missing, name: f"SELECT coalesce({column}, '{missing}') AS {name}, count(*) AS n FROM {view} GROUP BY 1"
    parts = [
        ("run", run, (), ("run_id", "manifest_hash", "config_hash", "source_git_commit")),
        ("trajectory_inputs", digest, (), ("digest", "record_count")),
        ("checkpoint_inputs", _digest_sql("fx_checkpoints", "parent_rollout_id", _FORCED_TEXTS, _FORCED_OTHERS), (), ("digest", "record_count")),
        ("totals", totals, (), (
            "problems_attempted", "problems_completed", "problems_planned", "trajectories_planned", "trajectories_recorded",
            "trajectories_completed", "checkpoints_recorded", "base_generated_tokens", "forced_generated_tokens", "total_generated_tokens",
            "w_to_c", "w_to_w", "c_to_c", "c_to_w", "non_evaluable", "evaluation_errors", "failures", "interrupted_unknown",
            "mean_seconds", "median_seconds", "peak_allocated_bytes", "peak_reserved_bytes")),
        ("trajectory_status_counts", counts("fx_rollouts", "status", "UNKNOWN", "status"), ("status",), ("n",)),
        ("checkpoint_receipt_status_counts", counts("fx_checkpoints", "status", "UNKNOWN", "status"), ("status",), ("n",)),
        ("final_evaluation_status_counts", counts("fx_rollouts", "final_status", "NOT_RECORDED", "evaluation_status"), ("evaluation_status",), ("n",)),
        ("checkpoint_evaluation_status_counts", counts("fx_checkpoints", "forced_status", "NOT_RECORDED", "evaluation_status"),
         ("evaluation_status",), ("n",)),
        ("failure_counts_by_kind", RAW_ORACLES["failure_counts_by_kind"], ("error_type",), ("n",)),
        ("checkpoint_counts_by_position", RAW_ORACLES["availability_by_position"], ("checkpoint_token", "metric"), ("n",)),
    ]
    selects = []
    for section, sql, keys, measures in parts:
        key = f"concat_ws('/', {', '.join(f'CAST({k} AS VARCHAR)' for k in keys)})" if keys else "''"
        texts = ", ".join(f"CAST({m} AS VARCHAR)" for m in measures)
        selects.append(f"SELECT '{section}' AS section, {key} AS key, unnest({list(measures)}) AS metric, unnest([{texts}]) AS text FROM ({sql}) q")
    every = " UNION ALL ".join(selects)
    return f"""SELECT section, key, metric, round(TRY_CAST(text AS DOUBLE), 4) AS value,
  CASE WHEN TRY_CAST(text AS DOUBLE) IS NULL THEN text END AS text FROM ({every}) r"""


@query("run_summary", _run_summary_oracle())
def _run_summary(fx):
    """Numbers as doubles, other values as text."""
    rollouts, checkpoints = materialise(fx.rollouts, "rollouts"), materialise(fx.checkpoints, "checkpoints")
    sections = run_summary_sections(rollouts, checkpoints, _planned_scope(fx), POSITIONS, RUN)
    number = F.col("value").try_cast("double")
    return report_rows(sections).select("section", "key", "metric", F.round(number, 4).alias("value"),
                                        F.when(number.isNull(), F.col("value")).alias("text"))


# --- plans and children ------------------------------------------------------

query("plan_validation", """
SELECT rollout_id AS id, CAST(count(*) AS BIGINT) AS rows, 'DUPLICATE_ID' AS violation FROM fx_rollouts GROUP BY 1 HAVING count(*) > 1""")(
    lambda fx: planning.plan_validation(fx.rollouts))

query("unavailable_children", f"""
SELECT 'checkpoint:' || rollout_id || ':token-' || CAST(checkpoint_token AS VARCHAR) AS checkpoint_id, rollout_id AS parent_rollout_id,
  problem_id, rollout_seed, checkpoint_token, 'UNAVAILABLE' AS status,
  CASE WHEN status = 'FAILED' THEN 'PARENT_BASE_FAILED' ELSE 'PARENT_BASE_INTERRUPTED_UNKNOWN' END AS availability_status,
  'no saved base trajectory is available for this child request' AS reason
FROM fx_rollouts, (SELECT unnest([{', '.join(map(str, POSITIONS))}])::BIGINT AS checkpoint_token) p WHERE status <> 'COMPLETED'""")(
    lambda fx: planning.unavailable_children(fx.rollouts, POSITIONS))

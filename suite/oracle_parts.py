"""Shared oracle fragments (DuckDB SQL)."""

from __future__ import annotations

from suite.views import POSITIONS

POS = "(" + ", ".join(str(p) for p in POSITIONS) + ")"
POS_ROWS = "(SELECT unnest([" + ", ".join(f"CAST({p} AS BIGINT)" for p in POSITIONS) + "]) AS checkpoint_token)"
LABELS = "(SELECT unnest(['W_TO_C','W_TO_W','C_TO_C','C_TO_W']) AS label)"
EVAL = "('CORRECT','INCORRECT')"

UNIQ = f"""uniq AS (
  SELECT rollout_id AS base_id, any_value(final_status) AS p_status,
    any_value(CASE WHEN final_status IN {EVAL} THEN final_correct END) AS p_verdict,
    any_value(eligible) AS p_eligible, any_value(eligibility_status) AS p_elig_status, any_value(reason_code) AS p_reason
  FROM fx_rollouts GROUP BY rollout_id HAVING count(*) = 1)"""


def _validated(recorded: str, name: str) -> tuple[str, str]:
    valid = f"coalesce({recorded} IN ('W_TO_C','W_TO_W','C_TO_C','C_TO_W'), FALSE)"
    label = f"CASE WHEN {valid} AND derived IS NOT NULL AND derived <> {recorded} THEN NULL WHEN {valid} THEN {recorded} ELSE derived END"
    status = f"""CASE WHEN {valid} AND derived IS NOT NULL AND derived <> {recorded} THEN {name} || '_AND_DERIVED_TRANSITION_MISMATCH'
      WHEN {valid} AND derived IS NOT NULL THEN {name} || '_AND_DERIVED_TRANSITION' WHEN {valid} THEN {name} || '_TRANSITION_ONLY'
      WHEN derived IS NOT NULL THEN 'DERIVED_TRANSITION' WHEN {recorded} IS NOT NULL THEN 'INVALID_' || {name}
      ELSE 'NON_EVALUABLE_OR_ERROR_TRANSITION' END"""
    return label, status


def facts(source: str) -> str:
    """CTEs up to ``facts``: one row per completed checkpoint at a declared position."""
    p_label, p_status = _validated("transition_label", "'TRANSITION_LABEL'")
    observed = "coalesce(observed_transition_label, transition_label)"
    o_name = "CASE WHEN observed_transition_label IS NOT NULL THEN 'OBSERVED_TRANSITION_LABEL' ELSE 'TRANSITION_LABEL' END"
    o_label, o_status = _validated(observed, o_name)
    return f"""{UNIQ}, joined AS (
  SELECT c.*, u.*, CASE WHEN forced_status IN {EVAL} THEN forced_correct END AS f_verdict,
    CASE WHEN final_ref_status IS NULL THEN p_verdict WHEN final_ref_status IN {EVAL} THEN final_ref_correct END AS final_verdict
  FROM {source} c LEFT JOIN uniq u ON c.parent_rollout_id = u.base_id
  WHERE c.checkpoint_token IN {POS} AND c.status = 'COMPLETED'
), derived AS (
  SELECT *, CASE WHEN f_verdict IS NOT NULL AND final_verdict IS NOT NULL THEN
    (CASE WHEN f_verdict THEN 'C' ELSE 'W' END) || '_TO_' || (CASE WHEN final_verdict THEN 'C' ELSE 'W' END) END AS derived
  FROM joined
), labelled AS (
  SELECT *, {p_label} AS p_label, {p_status} AS p_label_status, {o_label} AS o_label, {o_status} AS o_label_status
  FROM derived
), facts AS (
  SELECT parent_rollout_id, problem_id, checkpoint_token,
    CASE WHEN base_id IS NULL THEN 'MISSING_OR_AMBIGUOUS_PARENT_BASE_RECEIPT' WHEN problem_id IS NULL THEN 'MALFORMED_PROBLEM_ID'
      WHEN NOT eligible THEN 'CHECKPOINT_ANALYTICALLY_EXCLUDED' WHEN NOT p_eligible THEN 'PARENT_BASE_ANALYTICALLY_EXCLUDED'
      WHEN p_label IS NULL THEN 'PRIMARY:' || p_label_status ELSE 'VALID_PRIMARY_ANALYTIC_TRANSITION' END AS stage,
    CASE WHEN base_id IS NOT NULL AND problem_id IS NOT NULL AND eligible AND p_eligible THEN p_label END AS primary_label,
    CASE WHEN base_id IS NOT NULL AND problem_id IS NOT NULL AND eligible AND p_eligible THEN p_label_status END AS primary_label_status,
    CASE WHEN base_id IS NOT NULL AND problem_id IS NOT NULL THEN o_label END AS observed_label,
    CASE WHEN base_id IS NOT NULL AND problem_id IS NOT NULL THEN o_label_status END AS observed_label_status,
    CASE WHEN base_id IS NULL THEN 'MISSING_PARENT_BASE_EXCLUDED' WHEN problem_id IS NULL THEN NULL
      WHEN NOT eligible THEN eligibility_status WHEN NOT p_eligible THEN p_elig_status ELSE 'EFFECTIVELY_ELIGIBLE' END AS effective,
    CASE WHEN base_id IS NULL OR problem_id IS NULL THEN NULL WHEN NOT eligible THEN reason_code WHEN NOT p_eligible THEN p_reason END AS reason
  FROM labelled)"""


def funnel(source: str) -> str:
    return f"""WITH {facts(source)},
early AS (SELECT CASE WHEN checkpoint_token IS NULL OR checkpoint_token NOT IN {POS} THEN 'UNDECLARED_OR_MALFORMED_CHECKPOINT_POSITION'
    ELSE 'CHECKPOINT_RECEIPT_NOT_COMPLETED' END AS key
  FROM {source} WHERE checkpoint_token IS NULL OR checkpoint_token NOT IN {POS} OR status <> 'COMPLETED'),
counters AS (
  SELECT 'stage' AS counter, key FROM early
  UNION ALL SELECT 'stage', stage FROM facts
  UNION ALL SELECT 'observed', CASE WHEN observed_label IS NULL THEN 'OBSERVED:' || observed_label_status ELSE 'VALID_OBSERVED_TRANSITION' END
    FROM facts WHERE observed_label_status IS NOT NULL
  UNION ALL SELECT 'effective_eligibility', effective FROM facts WHERE effective IS NOT NULL
  UNION ALL SELECT 'exclusion_reason', reason FROM facts WHERE reason IS NOT NULL)
SELECT counter, key, CAST(count(*) AS BIGINT) AS n FROM counters GROUP BY 1, 2"""


def rates(source: str, label: str) -> str:
    counts = ", ".join(
        f"CAST(count(*) FILTER (WHERE label = '{n}') AS BIGINT) AS {n.lower()}"
        for n in ("W_TO_C", "W_TO_W", "C_TO_C", "C_TO_W")
    )
    return f"""WITH {facts(source)}, counted AS (
  SELECT p.checkpoint_token, {counts}, CAST(count(f.label) AS BIGINT) AS evaluable_transitions
  FROM {POS_ROWS} p LEFT JOIN (SELECT checkpoint_token, {label} AS label FROM facts WHERE {label} IS NOT NULL) f
    ON p.checkpoint_token = f.checkpoint_token GROUP BY 1)
SELECT checkpoint_token, evaluable_transitions, w_to_c, w_to_w, c_to_c, c_to_w,
  w_to_c / nullif(CAST(evaluable_transitions AS DOUBLE), 0) AS w_to_c_rate,
  w_to_w / nullif(CAST(evaluable_transitions AS DOUBLE), 0) AS w_to_w_rate,
  c_to_c / nullif(CAST(evaluable_transitions AS DOUBLE), 0) AS c_to_c_rate,
  c_to_w / nullif(CAST(evaluable_transitions AS DOUBLE), 0) AS c_to_w_rate,
  w_to_c + w_to_w AS wrong_checkpoint_transitions,
  w_to_c / nullif(CAST(w_to_c + w_to_w AS DOUBLE), 0) AS recovery_rate,
  w_to_w / nullif(CAST(w_to_c + w_to_w AS DOUBLE), 0) AS non_recovery_rate
FROM counted"""


def contrasts(source: str, label: str) -> str:
    metrics = """CAST(count(*) AS BIGINT) AS groups_any,
  CAST(count(*) FILTER (WHERE c > 0) AS BIGINT) AS groups_with_w_to_c, CAST(count(*) FILTER (WHERE w > 0) AS BIGINT) AS groups_with_w_to_w,
  CAST(count(*) FILTER (WHERE c > 0 AND w > 0) AS BIGINT) AS groups_mixed,
  CAST(count(*) FILTER (WHERE c > 0 AND w = 0) AS BIGINT) AS groups_only_w_to_c,
  CAST(count(*) FILTER (WHERE w > 0 AND c = 0) AS BIGINT) AS groups_only_w_to_w,
  CAST(coalesce(sum(c) FILTER (WHERE c > 0 AND w > 0), 0) AS BIGINT) AS w_to_c_in_mixed,
  CAST(coalesce(sum(w) FILTER (WHERE c > 0 AND w > 0), 0) AS BIGINT) AS w_to_w_in_mixed"""
    names = ("groups_any", "groups_with_w_to_c", "groups_with_w_to_w", "groups_mixed",
             "groups_only_w_to_c", "groups_only_w_to_w", "w_to_c_in_mixed", "w_to_w_in_mixed")
    filled = ", ".join(f"coalesce({n}, 0) AS {n}" for n in names)
    return f"""WITH {facts(source)}, g AS (
  SELECT problem_id, checkpoint_token, count(*) FILTER (WHERE {label} = 'W_TO_C') AS c, count(*) FILTER (WHERE {label} = 'W_TO_W') AS w
  FROM facts WHERE {label} IN ('W_TO_C','W_TO_W') GROUP BY 1, 2),
per AS (SELECT checkpoint_token, {metrics} FROM g GROUP BY 1)
SELECT CAST(p.checkpoint_token AS VARCHAR) AS scope, {filled} FROM {POS_ROWS} p LEFT JOIN per USING (checkpoint_token)
UNION ALL SELECT 'all_declared_checkpoints', {metrics.replace(' AS BIGINT) AS ', ' AS BIGINT) AS ')} FROM g"""


def concentration(source: str, label: str) -> str:
    return f"""WITH {facts(source)}, t AS (
  SELECT {label} AS label, problem_id, checkpoint_token FROM facts WHERE {label} IS NOT NULL),
cells AS (SELECT label, problem_id, checkpoint_token, count(*) AS n FROM t GROUP BY 1, 2, 3),
probs AS (SELECT label, problem_id, sum(n) AS n FROM cells GROUP BY 1, 2),
a AS (SELECT label, sum(n) AS events, count(DISTINCT problem_id) AS problems, count(*) AS groups,
    count(DISTINCT checkpoint_token) AS positions, max(n) AS max_group, sum(n * n) AS group_sq FROM cells GROUP BY 1),
b AS (SELECT label, max(n) AS max_problem, sum(n * n) AS problem_sq FROM probs GROUP BY 1)
SELECT l.label, CAST(coalesce(events, 0) AS BIGINT) AS event_count, CAST(coalesce(problems, 0) AS BIGINT) AS distinct_problems,
  CAST(coalesce(groups, 0) AS BIGINT) AS distinct_groups, CAST(coalesce(positions, 0) AS BIGINT) AS distinct_positions,
  CAST(coalesce(max_problem, 0) AS BIGINT) AS max_events_in_problem, max_problem / CAST(events AS DOUBLE) AS max_problem_share,
  CAST(coalesce(max_group, 0) AS BIGINT) AS max_events_in_group, max_group / CAST(events AS DOUBLE) AS max_group_share,
  CAST(problem_sq AS DOUBLE) / (CAST(events AS DOUBLE) * CAST(events AS DOUBLE)) AS herfindahl_by_problem,
  CAST(group_sq AS DOUBLE) / (CAST(events AS DOUBLE) * CAST(events AS DOUBLE)) AS herfindahl_by_group
FROM {LABELS} l LEFT JOIN a USING (label) LEFT JOIN b USING (label)"""


def positions_of(source: str, label: str) -> str:
    return f"""WITH {facts(source)} SELECT {label} AS label, checkpoint_token, CAST(count(*) AS BIGINT) AS event_count
FROM facts WHERE {label} IS NOT NULL GROUP BY 1, 2"""


def distribution(metrics: dict[str, tuple[str, str]]) -> str:
    """Nearest-rank distribution per metric: name -> (value expression, FROM/WHERE)."""
    parts = []
    for name, (value, source) in metrics.items():
        total = "CAST(coalesce(sum(CAST(x AS DECIMAL(38,10))), 0) AS DOUBLE)"
        quantiles = ", ".join(f"quantile_disc(x, {p}) AS p{int(p * 100)}" for p in (0.25, 0.5, 0.75, 0.9))
        parts.append(f"""SELECT '{name}' AS metric, CAST(count(x) AS BIGINT) AS count, {total} AS total,
  {total} / nullif(CAST(count(x) AS DOUBLE), 0) AS mean, min(x) AS min, {quantiles}, max(x) AS max
FROM (SELECT CAST({value} AS DOUBLE) AS x FROM {source}) s""")
    return "\nUNION ALL ".join(parts)


def exact_total(x: str) -> str:
    """The exact total of doubles, NULL without any.

    Counted in units of 2 ** -62 as a HUGEINT; cut to 60 bits, with a bit for what is cut off, it rounds once, to the
    nearest double.
    """
    units = f"sum(CAST(({x}) * 4611686018427387904e0 AS HUGEINT))"
    cut = f"CAST(pow(2, greatest(0, CAST(floor(log2(greatest(CAST({units} AS DOUBLE), 1e0))) AS INTEGER) - 60)) AS HUGEINT)"
    return (f"(CAST(CAST({units} // {cut} AS BIGINT) | CASE WHEN {units} % {cut} <> 0 THEN 1 ELSE 0 END AS DOUBLE)"
            f" * CAST({cut} AS DOUBLE) / 4611686018427387904e0)")

"""Queries over returned requests: receipts of both stages and the verifier hook."""

from __future__ import annotations

from contextlib import ExitStack

from pyspark.sql import functions as F

from suite.registry import query
from suite.views import CUE, EOS, MANIFEST_HASH, MARKER, WORD_POSITIONS
from trailmark.functions.identity import checkpoint_id
from trailmark.operators import receipts_out, trajectory
from trailmark.params import CampaignPlan, Decoding, RunContext
from trailmark.session import kept, scratch_path
from trailmark.sinks import writers
from trailmark.sources import receipts

RUN = RunContext("run-0123", MANIFEST_HASH, "c" * 64, "a" * 64, None)
BASE = Decoding.base(128, 0.6, 0.95, 20, 0.0)
FORCED = Decoding.forced(2)
PLAN = CampaignPlan(positions=WORD_POSITIONS)
TIME = "2026-01-02T03:04:05+00:00"


# --- the verifier hook -------------------------------------------------------


class PartVerifier:
    """Reads the number of a boxed answer; answers of some sizes make it fail in every way it can."""

    name, version = "part-verifier", "1"

    def parse(self, text):
        digits = "".join(c for c in text if c.isdigit())
        number = int(digits or 0)
        if number % 11 == 3:
            raise KeyError(text)
        if number % 11 == 4:
            return number
        return [] if number % 11 == 5 else [number]

    def verify(self, reference, candidate):
        if candidate[0] % 7 == 2:
            return [][0]
        return None if candidate[0] % 7 == 3 else reference == candidate


# Reference: the size plus 0 or 1; candidate: the size in a box.
_VERDICTS = """v AS (SELECT p_partkey AS part_id, p_size AS n, p_size + CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 0 END AS r, p_partkey % 9 = 1 AS blank FROM part),
c AS (SELECT *, CASE WHEN blank THEN 'BLANK' WHEN r % 11 = 3 THEN 'RF' WHEN r % 11 = 4 THEN 'RU' WHEN r % 11 = 5 THEN 'RN' WHEN n % 11 = 3 THEN 'CF' WHEN n % 11 = 4 THEN 'CU'
  WHEN n % 11 = 5 THEN 'CN' WHEN n % 7 = 2 THEN 'VF' WHEN n % 7 = 3 THEN 'VU' ELSE 'V' END AS k FROM v)"""

query("evaluate_with_backend", f"""
WITH {_VERDICTS} SELECT part_id, CASE WHEN k IN ('BLANK', 'RN', 'CN') THEN 'NON_EVALUABLE' WHEN k = 'V' THEN CASE WHEN n = r THEN 'CORRECT' ELSE 'INCORRECT' END ELSE 'ERROR' END AS status,
  CASE left(k, 1) WHEN 'R' THEN 'REFERENCE' WHEN 'C' THEN 'CANDIDATE' WHEN 'V' THEN 'VERIFY' END AS phase, CASE WHEN k = 'V' THEN n = r END AS correct,
  CASE k WHEN 'BLANK' THEN 'missing or empty reference answer' WHEN 'RF' THEN 'reference parsing failed' WHEN 'CF' THEN 'candidate parsing failed'
    WHEN 'RU' THEN 'reference parser returned an unsupported value' WHEN 'CU' THEN 'candidate parser returned an unsupported value'
    WHEN 'RN' THEN 'reference answer did not parse' WHEN 'CN' THEN 'candidate answer did not parse'
    WHEN 'VF' THEN 'symbolic verification failed' WHEN 'VU' THEN 'symbolic verifier returned a non-Boolean value' END AS reason,
  CASE WHEN k IN ('RF', 'CF') THEN 'KeyError' WHEN k = 'VF' THEN 'IndexError' END AS error_type,
  CASE WHEN k = 'RN' THEN 0 WHEN k NOT IN ('BLANK', 'RF', 'RU') THEN 1 END AS parsed_reference_count,
  CASE WHEN k = 'CN' THEN 0 WHEN left(k, 1) = 'V' THEN 1 END AS parsed_candidate_count, 'part-verifier' AS backend_name, '1' AS backend_version FROM c""")(
    lambda fx: receipts_out.evaluate_with(
        fx.table("part").select(
            F.col("p_partkey").alias("part_id"),
            F.when(F.col("p_partkey") % 9 == 1, " \n").otherwise((F.col("p_size") + F.when(F.col("p_partkey") % 4 == 0, 1).otherwise(0)).cast("string")).alias("given"),
            F.concat(F.lit("\\boxed{"), F.col("p_size").cast("string"), F.lit("}")).alias("found")),
        PartVerifier(), "given", "found").select("part_id", "evaluation.*", "phase"))

# --- what came back ----------------------------------------------------------


def _memory(*factors):
    names = ("allocated_bytes", "reserved_bytes", "peak_allocated_bytes", "peak_reserved_bytes")
    values = [F.lit(None).cast("bigint") if f is None else F.col("source_index") * f for f in factors]
    return F.struct(*[v.alias(n) for n, v in zip(names, values)])


def _answer(i, reference):
    """A right, a wrong or no boxed answer."""
    number = F.when(i % 3 == 0, reference).otherwise("n")
    return F.when(i % 7 == 3, "no box").otherwise(F.concat(F.lit("so \\boxed{"), number, F.lit("}")))


def _returned(fx):
    """One sampled completion per document: some failed, before or after the prompt was tokenized, some interrupted."""
    tokens = fx.trajectories.select(F.col("doc_id").alias("source_index"), F.col("token_ids").alias("generated_token_ids"))
    i = F.col("source_index")
    failed = (i % 9 == 0) & (i % 11 != 5)
    return fx.view("fx_problems").join(tokens, "source_index").withColumns({
        "rollout_seed": F.lit(101).cast("bigint"), "user_prompt": F.concat(F.lit("Solve "), "problem_id"),
        "chat_prompt_text": F.concat(F.lit("<user>"), "problem_id"), "interrupted": i % 11 == 5,
        "prompt_token_ids": F.when(~failed | (i % 18 != 0), F.array(i.cast("int"), F.lit(8))),
        "generated_text": _answer(i, F.col("reference_answer")), "elapsed_seconds": i / 100,
        "memory_before": _memory(10, 11, 12, None), "memory_after": F.when(i % 5 != 2, _memory(13, 16, None, 17)),
        "timestamp_utc": F.lit(TIME), "error_type": F.when(failed, "OutOfMemoryError"),
        "message": F.when(failed, F.concat(F.lit("out of memory: "), "problem_id")), "cuda_oom": F.when(failed & (i % 2 == 0), True),
    })


def _base_facts(fx):
    return receipts_out.base_facts(_returned(fx), RUN, MARKER, EOS, BASE)


_M0, _M1 = MARKER
_RUN_JSON = (
    f"'manifest_hash': '{MANIFEST_HASH}'", f"'config_hash': '{'c' * 64}'", f"'runtime_provenance_sha256': '{'a' * 64}'",
    "'source_git_commit': NULL::VARCHAR", "'run_id': 'run-0123'", "'schema_version': 1", "'problem_id': problem_id", "'source_index': i",
    "'rollout_seed': 101", f"'timestamp_utc': '{TIME}'", "'status': status",
)


def _json(*fields: str) -> str:
    """A DuckDB struct with its fields in sorted order."""
    return "{" + ", ".join(sorted(fields, key=lambda f: f.split("'")[1])) + "}"


def _memory_json(*factors) -> str:
    names = ("allocated_bytes", "reserved_bytes", "peak_allocated_bytes", "peak_reserved_bytes")
    return _json(*(f"'{n}': " + ("NULL::BIGINT" if f is None else f"i * {f}") for n, f in zip(names, factors)))


_BEFORE = f"'memory_before': {_memory_json(10, 11, 12, None)}"
_AFTER = f"'memory_after': CASE WHEN i % 5 <> 2 THEN {_memory_json(13, 16, None, 17)} END"
_DELTA = "'memory_delta_bytes': {'allocated': CASE WHEN i % 5 <> 2 THEN i * 3 END, 'reserved': CASE WHEN i % 5 <> 2 THEN i * 5 END}"
_LOST = _json("'error_type': 'INTERRUPTED_UNKNOWN'", "'message': 'prior invocation ended after intent start without a receipt'", "'cuda_oom': FALSE",
              "'elapsed_seconds': NULL::DOUBLE", "'memory_before': NULL::VARCHAR", "'memory_after': NULL::VARCHAR")
_HASH = "sha256('[' || array_to_string({0}, ',') || ']')"
_EXTRACTED = _json(
    "'status': CASE WHEN i % 7 = 3 THEN 'MISSING_BOXED_ANSWER' ELSE 'EXTRACTED' END", "'extracted_text': box",
    "'start_offset': CASE WHEN i % 7 <> 3 THEN 3 END", "'end_offset': 3 + length(box)",
    "'reason': CASE WHEN i % 7 = 3 THEN 'completion contains no boxed expression' END",
)
_GRADE = "CASE WHEN i % 7 = 3 THEN 'NON_EVALUABLE' WHEN i % 3 = 0 THEN 'CORRECT' ELSE 'INCORRECT' END"
_EVALUATED = _json(
    f"'status': {_GRADE}", "'correct': CASE WHEN i % 7 <> 3 THEN i % 3 = 0 END", "'backend_name': 'trailmark-native'", "'backend_version': NULL::VARCHAR",
    "'reason': CASE WHEN i % 7 = 3 THEN 'answer extraction status: MISSING_BOXED_ANSWER' END", "'error_type': NULL::VARCHAR",
    "'parsed_reference_count': CASE WHEN i % 7 <> 3 THEN 1 END", "'parsed_candidate_count': CASE WHEN i % 7 <> 3 THEN 1 END",
)
_BASE_DECODING = _json("'request_kind': 'BASE_STOCHASTIC'", "'max_new_tokens': 128", "'do_sample': TRUE", "'temperature': 0.6::DOUBLE", "'top_p': 0.95::DOUBLE",
                       "'top_k': 20", "'min_p': 0.0::DOUBLE", "'seed': 101")

_BASE_CTE = f"""b AS (SELECT p.*, source_index AS i, token_ids, 'rollout:{MANIFEST_HASH[:16]}:' || problem_id || ':seed-101' AS rollout_id,
    CASE WHEN source_index % 11 = 5 THEN 'INTERRUPTED_UNKNOWN' WHEN source_index % 9 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
    CASE WHEN source_index % 7 = 3 THEN 'no box' ELSE 'so ' || chr(92) || 'boxed{{' || CASE WHEN source_index % 3 = 0 THEN reference_answer ELSE 'n' END || '}}' END AS said,
    CASE WHEN source_index % 7 <> 3 THEN chr(92) || 'boxed{{' || CASE WHEN source_index % 3 = 0 THEN reference_answer ELSE 'n' END || '}}' END AS box,
    CASE WHEN token_ids[-1] = {EOS[0]} THEN 'EOS' WHEN len(token_ids) >= 128 THEN 'MAX_NEW_TOKENS' ELSE 'OTHER_STOP' END AS ended,
    list_filter(range(0, greatest(len(token_ids) - 1, 0)), lambda x: token_ids[x + 1] = {_M0} AND token_ids[x + 2] = {_M1}) AS s
  FROM fx_problems p JOIN fx_trajectories t ON t.doc_id = p.source_index)"""

_PROMPT = _json("'user_prompt': 'Solve ' || problem_id", "'chat_prompt_text': '<user>' || problem_id", "'token_ids': [i, 8]",
                "'token_ids_sha256': sha256('[' || CAST(i AS VARCHAR) || ',8]')")
_BASE_IDENTITY = (
    *_RUN_JSON, "'record_type': 'BASE_ROLLOUT'", "'rollout_id': rollout_id", "'problem': problem", "'problem_sha256': sha256(problem)",
    "'reference_answer': reference_answer", "'reference_answer_sha256': sha256(reference_answer)", "'metadata': {'level': level, 'subject': subject}",
    "'metadata_sha256': sha256('{\"level\":' || coalesce(CAST(level AS VARCHAR), 'null') || ',\"subject\":\"' || subject || '\"}')",
)
_BASE_DONE = _json(
    *_BASE_IDENTITY, f"'prompt': {_PROMPT}", f"'final_extraction': {_EXTRACTED}", f"'final_evaluation': {_EVALUATED}",
    "'generation': " + _json(
        "'input_token_count': 2", "'input_token_ids': [i, 8]", "'input_token_ids_sha256': sha256('[' || CAST(i AS VARCHAR) || ',8]')",
        "'generated_token_ids': token_ids", f"'generated_token_ids_sha256': {_HASH.format('token_ids')}", "'generated_token_count': len(token_ids)",
        "'generated_text': said", "'elapsed_seconds': i / 100", "'termination_status': ended", _BEFORE, _AFTER, _DELTA, f"'decoding': {_BASE_DECODING}"),
    "'thinking_boundary': " + _json(
        f"'coordinate': '{receipts_out.COORDINATE}'", f"'close_think_marker_token_ids': [{_M0}, {_M1}]", f"'close_think_marker_sha256': sha256('[{_M0},{_M1}]')",
        "'first_close_marker_start_zero_based': s[1]", "'close_marker_count': len(s)",
        "'status': CASE len(s) WHEN 0 THEN 'NO_CLOSE_MARKER' WHEN 1 THEN 'ONE_CLOSE_MARKER' ELSE 'MULTIPLE_CLOSE_MARKERS' END"),
)
_BASE_FAILED = _json(
    *_BASE_IDENTITY, "'prompt_rendered': 'Solve ' || problem_id", f"'prompt': CASE WHEN i % 18 <> 0 THEN {_PROMPT} END", f"'requested_decoding': {_BASE_DECODING}",
    "'failure': " + _json("'error_type': 'OutOfMemoryError'", "'message': 'out of memory: ' || problem_id", "'cuda_oom': i % 2 = 0", "'elapsed_seconds': i / 100", _BEFORE, _AFTER),
)

query("base_receipts", f"""
WITH {_BASE_CTE} SELECT rollout_id, status, sha256(CAST(CASE status WHEN 'COMPLETED' THEN to_json({_BASE_DONE}) WHEN 'FAILED' THEN to_json({_BASE_FAILED})
  ELSE to_json({_json(*_BASE_IDENTITY, f"'failure': {_LOST}")}) END AS VARCHAR)) AS receipt_sha256 FROM b""")(
    lambda fx: receipts_out.base_receipts(_base_facts(fx), RUN, MARKER, BASE).select(
        "rollout_id", "status", F.sha2("receipt", 256).alias("receipt_sha256")))

# --- checkpoints -------------------------------------------------------------


def _forced_returned(fx, facts):
    """What came back for available checkpoints: nothing yet for a tenth, failures and interruptions for others."""
    done = facts.where("status = 'COMPLETED'").select("rollout_id", "source_index", "reference_answer", F.col("generated_token_ids").alias("token_ids"))
    cut = trajectory.fixed_checkpoints(done, WORD_POSITIONS, MARKER, EOS).where("availability_status = 'AVAILABLE'")
    i, k = F.col("source_index"), (F.col("source_index") + F.col("checkpoint_token")) % 10
    failed = k == 4
    return cut.where(k != 9).select(
        checkpoint_id(F.col("rollout_id"), F.col("checkpoint_token")).alias("checkpoint_id"), (k == 7).alias("interrupted"),
        F.when(k == 8, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1), F.lit(EOS[0]))).alias("generated_token_ids"),
        _answer(i, F.col("reference_answer")).alias("generated_text"), (i / 100).alias("elapsed_seconds"),
        _memory(10, 11, 12, None).alias("memory_before"), F.when(i % 5 != 2, _memory(13, 16, None, 17)).alias("memory_after"), F.lit(TIME).alias("timestamp_utc"),
        F.when(failed, "RuntimeError").alias("error_type"), F.when(failed, "lost").alias("message"), F.lit(None).cast("boolean").alias("cuda_oom"),
    )


def _checkpoint_facts(fx, facts=None):
    facts = _base_facts(fx) if facts is None else facts
    return receipts_out.checkpoint_facts(facts, _forced_returned(fx, facts), PLAN, MARKER, CUE, EOS, FORCED)


_CUE_TEXT = ",".join(map(str, CUE))
_CHILD_CTE = f"""{_BASE_CTE}, pos AS (SELECT unnest([{', '.join(map(str, WORD_POSITIONS))}])::BIGINT AS p),
cut AS (SELECT * EXCLUDE (status), status AS parent, CASE WHEN status = 'FAILED' THEN 'PARENT_BASE_FAILED' WHEN status <> 'COMPLETED' THEN 'PARENT_BASE_INTERRUPTED_UNKNOWN'
    WHEN p > len(token_ids) THEN 'TRAJECTORY_TOO_SHORT' WHEN s[1] < p THEN 'AFTER_THINK_CLOSE' WHEN list_position(token_ids, {EOS[0]}) BETWEEN 1 AND p THEN 'AFTER_TERMINAL_TOKEN'
    ELSE 'AVAILABLE' END AS av, (i + p) % 10 AS k FROM b, pos),
child AS (SELECT * EXCLUDE (s, token_ids), token_ids[1:p] AS prefix, len(token_ids) AS n, CASE WHEN av <> 'AVAILABLE' THEN 'UNAVAILABLE' WHEN k = 7 THEN 'INTERRUPTED_UNKNOWN' WHEN k = 4 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
    'checkpoint:' || rollout_id || ':token-' || CAST(p AS VARCHAR) AS checkpoint_id, CASE WHEN parent = 'COMPLETED' THEN ended END AS base_ended,
    CASE WHEN parent = 'COMPLETED' THEN s[1] END AS mark, CASE WHEN parent = 'COMPLETED' THEN len(s) END AS marks,
    CASE WHEN parent = 'COMPLETED' THEN {_GRADE} END AS final_status, CASE WHEN parent = 'COMPLETED' AND i % 7 <> 3 THEN i % 3 = 0 END AS final_correct
  FROM cut WHERE av <> 'AVAILABLE' OR k <> 9),
f AS (SELECT *, CASE WHEN status = 'COMPLETED' THEN CASE WHEN k = 8 THEN 'MAX_NEW_TOKENS' ELSE 'EOS' END END AS forced_ended,
    CASE WHEN status = 'COMPLETED' THEN {_GRADE} END AS forced_status FROM child),
c AS (SELECT *, av = 'AVAILABLE' AS c1, coalesce(base_ended = 'EOS', FALSE) AS c2, coalesce(mark >= 0, FALSE) AS c3, coalesce(forced_ended = 'EOS', FALSE) AS c4,
    coalesce(final_status IN ('CORRECT', 'INCORRECT'), FALSE) AS c5, coalesce(forced_status IN ('CORRECT', 'INCORRECT'), FALSE) AS c6,
    CASE WHEN status = 'COMPLETED' AND i % 7 <> 3 THEN CASE WHEN i % 3 = 0 THEN 'C_TO_C' ELSE 'W_TO_W' END END AS observed FROM f)"""
_CHILD_IDENTITY = (
    *_RUN_JSON, "'record_type': 'FORCED_CHECKPOINT'", "'checkpoint_id': checkpoint_id", "'parent_rollout_id': rollout_id", "'checkpoint_token': p", "'availability_status': av",
    "'analytic_eligibility': " + _json(
        "'policy_id': 'p0-primary-label-censoring-v1'", "'eligible': c1 AND c2 AND c3 AND c4 AND c5 AND c6",
        "'criteria': " + _json(
            "'checkpoint_available': {'observed_status': av, 'passed': c1, 'required': TRUE}",
            "'base_terminated_naturally': {'observed_status': base_ended, 'passed': c2, 'required_status': 'EOS'}",
            "'base_has_close_think_marker': {'observed_marker_count': marks, 'observed_marker_start_zero_based': mark, 'passed': c3, 'required': TRUE}",
            "'forced_terminated_naturally': {'observed_status': forced_ended, 'passed': c4, 'required_status': 'EOS'}",
            "'original_final_evaluable': {'allowed_statuses': ['CORRECT', 'INCORRECT'], 'observed_status': final_status, 'passed': c5}",
            "'forced_answer_evaluable': {'allowed_statuses': ['CORRECT', 'INCORRECT'], 'observed_status': forced_status, 'passed': c6}"),
        """'reasons': list_filter([CASE WHEN NOT c1 THEN to_json({'code': 'CHECKPOINT_NOT_AVAILABLE', 'observed_status': av, 'required_status': 'AVAILABLE'}) END,
          CASE WHEN NOT c2 THEN to_json({'code': 'BASE_TERMINATION_NOT_NATURAL_EOS', 'observed_status': base_ended, 'required_status': 'EOS'}) END,
          CASE WHEN NOT c3 THEN to_json({'code': 'BASE_CLOSE_THINK_MARKER_MISSING', 'observed_marker_start_zero_based': mark, 'required': TRUE}) END,
          CASE WHEN NOT c4 THEN to_json({'code': 'FORCED_TERMINATION_NOT_NATURAL_EOS', 'observed_status': forced_ended, 'required_status': 'EOS'}) END,
          CASE WHEN NOT c5 THEN to_json({'allowed_statuses': ['CORRECT', 'INCORRECT'], 'code': 'ORIGINAL_FINAL_NOT_EVALUABLE', 'observed_status': final_status}) END,
          CASE WHEN NOT c6 THEN to_json({'allowed_statuses': ['CORRECT', 'INCORRECT'], 'code': 'FORCED_ANSWER_NOT_EVALUABLE', 'observed_status': forced_status}) END], lambda x: x IS NOT NULL)"""),
)
_LABELS = ("'observed_transition_label': observed", "'transition_label': CASE WHEN c1 AND c2 AND c3 AND c4 AND c5 AND c6 THEN observed END")
_PREFIX = ("'saved_prefix_token_count': p", f"'saved_prefix_sha256': {_HASH.format('prefix')}")
_INPUT_HASH = f"sha256('[' || CAST(i AS VARCHAR) || ',8,' || array_to_string(prefix, ',') || ',{_CUE_TEXT}]')"
_GIVEN = "'forced_answer_input': " + _json(
    *_PREFIX, "'prompt_token_count': 2", "'prompt_sha256': sha256('[' || CAST(i AS VARCHAR) || ',8]')", f"'close_think_cue_token_ids': [{_CUE_TEXT}]",
    f"'close_think_cue_sha256': sha256('[{_CUE_TEXT}]')", f"'input_token_count': p + {2 + len(CUE)}", f"'input_sha256': {_INPUT_HASH}",
)
_FINAL = "'final_evaluation_reference': {'correct': final_correct, 'status': final_status}"
_FORCED_DECODING = _json("'request_kind': 'FORCED_GREEDY'", "'max_new_tokens': 2", "'do_sample': FALSE",
                         *(f"'{n}': NULL::VARCHAR" for n in ("temperature", "top_p", "top_k", "min_p", "seed")))
_SAID = f"CASE WHEN k = 8 THEN [1, 2] ELSE [1, {EOS[0]}] END"
_CHILD_DONE = _json(
    *_CHILD_IDENTITY, *_LABELS, *_PREFIX, _GIVEN, _FINAL, f"'forced_extraction': {_EXTRACTED}", f"'forced_evaluation': {_EVALUATED}",
    "'forced_generation': " + _json(
        f"'input_token_count': p + {2 + len(CUE)}", f"'input_token_ids_sha256': {_INPUT_HASH}", f"'generated_token_ids': {_SAID}",
        f"'generated_token_ids_sha256': {_HASH.format(_SAID)}", "'generated_token_count': 2", "'generated_text': said", "'elapsed_seconds': i / 100",
        "'termination_status': forced_ended", _BEFORE, _AFTER, _DELTA, f"'decoding': {_FORCED_DECODING}"),
)
_CHILD_FAILED = _json(
    *_CHILD_IDENTITY, *_LABELS, *_PREFIX, _GIVEN, _FINAL, f"'requested_decoding': {_FORCED_DECODING}",
    "'failure': " + _json("'error_type': 'RuntimeError'", "'message': 'lost'", "'cuda_oom': FALSE", "'elapsed_seconds': i / 100", _BEFORE, _AFTER),
)
_CHILD_NONE = _json(
    *_CHILD_IDENTITY, *_LABELS, "'base_generated_token_count': CASE WHEN parent = 'COMPLETED' THEN n END",
    """'reason': CASE av WHEN 'TRAJECTORY_TOO_SHORT' THEN 'saved trajectory has ' || CAST(n AS VARCHAR) || ' generated tokens'
      WHEN 'AFTER_THINK_CLOSE' THEN 'requested prefix reaches the original final-answer phase' WHEN 'AFTER_TERMINAL_TOKEN' THEN 'requested prefix contains a terminal token'
      ELSE 'no saved base trajectory is available for this child request' END""",
)

query("checkpoint_receipts", f"""
WITH {_CHILD_CTE} SELECT checkpoint_id, status, sha256(CAST(CASE status WHEN 'COMPLETED' THEN to_json({_CHILD_DONE}) WHEN 'FAILED' THEN to_json({_CHILD_FAILED})
  WHEN 'UNAVAILABLE' THEN to_json({_CHILD_NONE}) ELSE to_json({_json(*_CHILD_IDENTITY, *_LABELS, *_PREFIX, f"'failure': {_LOST}")}) END AS VARCHAR)) AS receipt_sha256 FROM c""")(
    lambda fx: receipts_out.checkpoint_receipts(_checkpoint_facts(fx), RUN, CUE, FORCED).select(
        "checkpoint_id", "status", F.sha2("receipt", 256).alias("receipt_sha256")))


@query("receipts_stored", f"""
WITH {_CHILD_CTE} SELECT 'checkpoint' AS kind, checkpoint_id AS id, status, c1 AND c2 AND c3 AND c4 AND c5 AND c6 AS eligible, av AS availability_status,
  observed AS observed_transition_label FROM c
UNION ALL SELECT 'rollout', rollout_id, status, TRUE, NULL, NULL FROM b""")
def _receipts_stored(fx):
    """Receipts of both stages appended twice, then read back from the store and typed."""
    stored = {}

    def store(kind, key, made):
        path = scratch_path(fx.spark, f"{kind}_receipts")
        for _ in range(2):
            writers.append_once(made, path, key, stored=True)
        stored[kind] = fx.spark.read.schema(made.schema).parquet(path).select("file_name", F.parse_json("receipt").alias("record"))

    # The facts are read three times. Each table goes as soon as nothing reads it.
    with ExitStack() as last:
        with kept(_base_facts(fx), "base_facts") as facts:
            with kept(receipts_out.checkpoint_receipts(_checkpoint_facts(fx, facts), RUN, CUE, FORCED), "checkpoint_made") as made:
                store("checkpoint", "checkpoint_id", made)
            made = last.enter_context(kept(receipts_out.base_receipts(facts, RUN, MARKER, BASE), "rollout_made"))
        store("rollout", "rollout_id", made)
    rollouts, checkpoints = receipts.typed_rollouts(stored["rollout"]), receipts.typed_checkpoints(stored["checkpoint"])
    return checkpoints.select(
        F.lit("checkpoint").alias("kind"), F.col("checkpoint_id").alias("id"), "status", "eligible", "availability_status", "observed_transition_label",
    ).unionByName(rollouts.select(F.lit("rollout").alias("kind"), F.col("rollout_id").alias("id"), "status", "eligible"), allowMissingColumns=True)

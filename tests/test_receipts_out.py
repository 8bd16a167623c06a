"""Receipts of returned requests: shapes, faults, second runs."""

import json

import pytest
from pyspark.sql import functions as F

from trailmark.functions.verifier import judge
from trailmark.operators import receipts_out
from trailmark.params import CampaignPlan, Decoding, RunContext
from trailmark.sinks import writers
from trailmark.sources import receipts

# The known-answer campaign of a problem with marker (90, 91), cue (90, 91, 92) and EOS 2.
RUN = RunContext("run-1", "d" * 64, "c" * 64, "a" * 64, "b" * 40)
MARKER, CUE, EOS = (90, 91), (90, 91, 92), (2,)
BASE, FORCED = Decoding.base(64, 0.6, 0.95, 20, 0.0), Decoding.forced(16)
PLAN = CampaignPlan(positions=(2, 4))
SCHEMA = (
    "problem_id string, source_index long, problem string, reference_answer string, level int, subject string, rollout_seed long, "
    "user_prompt string, chat_prompt_text string, prompt_token_ids array<int>, generated_token_ids array<int>, generated_text string, "
    "elapsed_seconds double, memory_before struct<allocated_bytes:long,reserved_bytes:long,peak_allocated_bytes:long,peak_reserved_bytes:long>, "
    "memory_after struct<allocated_bytes:long,reserved_bytes:long,peak_allocated_bytes:long,peak_reserved_bytes:long>, timestamp_utc string, "
    "error_type string, message string, cuda_oom boolean, interrupted boolean"
)
FORCED_SCHEMA = "checkpoint_id string, " + SCHEMA[SCHEMA.index("generated_token_ids") :]
MEMORY = (10, 20, 30, None)


def base_row(problem="p-1", tokens=(1, 2, 3, 90, 91, 5, 2), text="so \\boxed{4}", error=None, interrupted=None, prompt=(11, 12)):
    return (
        problem, 7, "2+2?", "4", None, 'a "b"\n', 101, "ask", "<ask>", list(prompt) if prompt else None, list(tokens), text, 1.5, MEMORY, (15, 20, 30, 40),
        "2026-01-01T00:00:00+00:00", error, error and "gone", None, interrupted,
    )


def facts_of(spark, *rows, verifier=None):
    return receipts_out.base_facts(spark.createDataFrame(list(rows), SCHEMA), RUN, MARKER, EOS, BASE, verifier)


def forced_row(facts, position, tokens=(7, 2), text="\\boxed{5}", error=None, interrupted=None):
    rollout = facts.head().rollout_id
    return (f"checkpoint:{rollout}:token-{position}", list(tokens), text, 0.5, MEMORY, MEMORY, "2026-01-01T00:01:00+00:00", error, error and "gone", True, interrupted)


def children_of(spark, facts, *rows, verifier=None):
    returned = spark.createDataFrame(list(rows), FORCED_SCHEMA)
    made = receipts_out.checkpoint_facts(facts, returned, PLAN, MARKER, CUE, EOS, FORCED, verifier)
    return receipts_out.checkpoint_receipts(made, RUN, CUE, FORCED)


def records(df):
    return {r[0]: json.loads(r.receipt) for r in df.collect()}


def token_hash(ids):
    import hashlib

    return hashlib.sha256(json.dumps(list(ids), separators=(",", ":")).encode()).hexdigest()


def test_completed_base_receipt(spark):
    made = receipts_out.base_receipts(facts_of(spark, base_row()), RUN, MARKER, BASE)
    (text,) = [r.receipt for r in made.collect()]
    record = json.loads(text)
    assert text == json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert record["rollout_id"] == "rollout:" + "d" * 16 + ":p-1:seed-101" and record["status"] == "COMPLETED"
    assert record["metadata"] == {"level": None, "subject": 'a "b"\n'} and record["record_type"] == "BASE_ROLLOUT"
    generation = record["generation"]
    assert generation["termination_status"] == "MAX_NEW_TOKENS" if BASE.max_new_tokens <= 7 else "EOS"
    assert generation["generated_token_ids_sha256"] == token_hash([1, 2, 3, 90, 91, 5, 2])
    assert generation["memory_delta_bytes"] == {"allocated": 5, "reserved": 0} and generation["decoding"]["seed"] == 101
    assert record["thinking_boundary"]["first_close_marker_start_zero_based"] == 3
    assert record["final_evaluation"]["status"] == "CORRECT" and record["final_extraction"]["extracted_text"] == "\\boxed{4}"
    assert "failure" not in record and "requested_decoding" not in record


def test_failed_base_keeps_its_prompt_and_its_children_are_unavailable(spark):
    facts = facts_of(spark, base_row(error="RuntimeError"))
    (record,) = records(receipts_out.base_receipts(facts, RUN, MARKER, BASE)).values()
    assert record["status"] == "FAILED" and record["prompt"]["token_ids"] == [11, 12] and "generation" not in record
    assert record["failure"] == {
        "error_type": "RuntimeError", "message": "gone", "cuda_oom": False, "elapsed_seconds": 1.5,
        "memory_before": {"allocated_bytes": 10, "reserved_bytes": 20, "peak_allocated_bytes": 30, "peak_reserved_bytes": None},
        "memory_after": {"allocated_bytes": 15, "reserved_bytes": 20, "peak_allocated_bytes": 30, "peak_reserved_bytes": 40},
    }
    children = records(children_of(spark, facts))
    assert len(children) == 2
    for child in children.values():
        assert child["status"] == "UNAVAILABLE" and child["availability_status"] == "PARENT_BASE_FAILED"
        assert not child["analytic_eligibility"]["eligible"] and len(child["analytic_eligibility"]["reasons"]) == 6
    (never,) = records(receipts_out.base_receipts(facts_of(spark, base_row(error="ValueError", prompt=None)), RUN, MARKER, BASE)).values()
    assert never["prompt"] is None and never["prompt_rendered"] == "ask"


def test_children_of_every_status(spark):
    facts = facts_of(spark, base_row(tokens=(1, 5, 3, 6, 90, 91, 2)))
    done = records(children_of(spark, facts, forced_row(facts, 2), forced_row(facts, 4, error="RuntimeError")))
    first, second = (done[k] for k in sorted(done))
    assert first["observed_transition_label"] == first["transition_label"] == "W_TO_C" and first["analytic_eligibility"]["eligible"]
    given = {"input_sha256": token_hash([11, 12, 1, 5, 90, 91, 92]), "saved_prefix_sha256": token_hash([1, 5]), "input_token_count": 7}
    assert given.items() <= first["forced_answer_input"].items()
    assert first["forced_generation"]["input_token_ids_sha256"] == given["input_sha256"] and "input_token_ids" not in first["forced_generation"]
    assert second["status"] == "FAILED" and second["forced_answer_input"]["saved_prefix_token_count"] == 4
    assert second["failure"]["cuda_oom"] is True and second["transition_label"] is None
    late = records(children_of(spark, facts, forced_row(facts, 4, interrupted=True)))  # position 2 is pending
    (lost,) = late.values()
    assert lost["status"] == "INTERRUPTED_UNKNOWN" and lost["failure"]["memory_after"] is None and lost["saved_prefix_token_count"] == 4
    assert [r["code"] for r in lost["analytic_eligibility"]["reasons"]] == ["FORCED_TERMINATION_NOT_NATURAL_EOS", "FORCED_ANSWER_NOT_EVALUABLE"]


def test_base_without_eos_censors_the_label_but_not_the_observation(spark):
    facts = facts_of(spark, base_row(tokens=(1, 5, 3, 90, 91, 6)))
    (child,) = records(children_of(spark, facts, forced_row(facts, 2)).where("status = 'COMPLETED'")).values()
    assert child["observed_transition_label"] == "W_TO_C" and child["transition_label"] is None
    (reason,) = child["analytic_eligibility"]["reasons"]
    assert reason == {"code": "BASE_TERMINATION_NOT_NATURAL_EOS", "required_status": "EOS", "observed_status": "OTHER_STOP"}


def test_a_second_run_changes_nothing(spark, tmp_path):
    facts = facts_of(spark, base_row(), base_row("p-2", error="E"), base_row("p-3", interrupted=True))
    made = receipts_out.base_receipts(facts, RUN, MARKER, BASE)
    path = str(tmp_path / "store")
    writers.append_once(made, path, "rollout_id")
    again = receipts_out.base_receipts(facts.repartition(5), RUN, MARKER, BASE)
    stored = spark.read.parquet(path)
    assert {r.status for r in writers.append_once_status(again, stored, "rollout_id").collect()} == {"UNCHANGED"}
    writers.append_once(again, path, "rollout_id")
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(writers.ConflictError):
        writers.append_once(receipts_out.base_receipts(facts_of(spark, base_row(text="\\boxed{5}")), RUN, MARKER, BASE), path, "rollout_id")
    typed = receipts.typed_rollouts(stored.select("file_name", F.parse_json("receipt").alias("record")))
    assert sorted((r.status, r.final_status, r.generated_token_count) for r in typed.collect()) == [
        ("COMPLETED", "CORRECT", 7), ("FAILED", None, None), ("INTERRUPTED_UNKNOWN", None, None)
    ]


def test_nothing_returned(spark):
    facts = receipts_out.base_facts(spark.createDataFrame([], SCHEMA), RUN, MARKER, EOS, BASE)
    assert receipts_out.base_receipts(facts, RUN, MARKER, BASE).count() == 0
    assert children_of(spark, facts).count() == 0


class Picky:
    name, version = "picky", None

    def parse(self, text):
        if "boom" in text:
            raise ZeroDivisionError
        return {"none": None, "empty": []}.get(text, [text])

    def verify(self, reference, candidate):
        if candidate[0] == "raise":
            raise RuntimeError
        return {"maybe": 1}.get(candidate[0], reference == candidate)


@pytest.mark.parametrize(
    "reference, candidate, wanted",
    [
        ("a", "a", ("CORRECT", "VERIFY", True, None, None, 1, 1)), ("a", "b", ("INCORRECT", "VERIFY", False, None, None, 1, 1)),
        ("boom", "a", ("ERROR", "REFERENCE", None, "reference parsing failed", "ZeroDivisionError", None, None)),
        ("a", "boom", ("ERROR", "CANDIDATE", None, "candidate parsing failed", "ZeroDivisionError", 1, None)),
        ("none", "a", ("ERROR", "REFERENCE", None, "reference parser returned an unsupported value", None, None, None)),
        ("a", "none", ("ERROR", "CANDIDATE", None, "candidate parser returned an unsupported value", None, 1, None)),
        ("empty", "a", ("NON_EVALUABLE", "REFERENCE", None, "reference answer did not parse", None, 0, None)),
        ("a", "empty", ("NON_EVALUABLE", "CANDIDATE", None, "candidate answer did not parse", None, 1, 0)),
        ("a", "raise", ("ERROR", "VERIFY", None, "symbolic verification failed", "RuntimeError", 1, 1)),
        ("a", "maybe", ("ERROR", "VERIFY", None, "symbolic verifier returned a non-Boolean value", None, 1, 1)),
    ],
)
def test_phases_of_a_verifier(reference, candidate, wanted):
    assert judge(Picky(), reference, candidate) == wanted


def test_a_raising_verifier_spoils_its_own_row_only(spark):
    rows = [("a", "a"), ("a", "raise"), ("a", None), (None, "a"), (" ", "a"), ("a", "b")]
    graded = receipts_out.evaluate_with(spark.createDataFrame(rows, "r string, c string").coalesce(1), Picky(), "r", "c")
    found = [(r.evaluation.status, r.evaluation.reason, r.phase) for r in graded.collect()]
    assert found == [
        ("CORRECT", None, "VERIFY"), ("ERROR", "symbolic verification failed", "VERIFY"), ("NON_EVALUABLE", "missing or empty candidate answer", None),
        ("NON_EVALUABLE", "missing or empty reference answer", None), ("NON_EVALUABLE", "missing or empty reference answer", None), ("INCORRECT", None, "VERIFY"),
    ]
    facts = facts_of(spark, base_row(text="\\boxed{boom}"), base_row("p-2"), verifier=Picky())
    status = {r.problem_id: (r.evaluation.status, r.evaluation.error_type, r.evaluation.backend_name) for r in facts.collect()}
    assert status == {"p-1": ("ERROR", "ZeroDivisionError", "picky"), "p-2": ("INCORRECT", None, "picky")}

"""A small hand-built campaign, written as JSON receipts and read back."""

import json

import pytest

from tests.conftest import keyed, rows
from trailmark.operators import accounting, stages, transitions
from trailmark.plans.analysis import analysis_sections, report_rows
from trailmark.sinks.writers import write_summary
from trailmark.sources import inputs, receipts

POSITIONS = (2, 4)


def generation(tokens, elapsed, termination, allocated, reserved):
    return {
        "generated_token_count": tokens, "elapsed_seconds": elapsed, "termination_status": termination,
        "generated_text": "private completion",
        "memory_after": {"peak_allocated_bytes": allocated, "peak_reserved_bytes": reserved},
    }


def verdict(correct, status=None):
    if status:
        return {"status": status, "correct": None}
    return {"status": "CORRECT" if correct else "INCORRECT", "correct": correct}


def base(rollout, problem, correct, tokens, elapsed, termination="EOS", allocated=100, reserved=200, **extra):
    return {
        "rollout_id": rollout, "problem_id": problem, "problem": "private prompt", "status": "COMPLETED",
        "generation": generation(tokens, elapsed, termination, allocated, reserved),
        "final_evaluation": verdict(correct), **extra,
    }


def child(parent, problem, position, forced, final, label, tokens=1, elapsed=0.1, allocated=300, reserved=350, **extra):
    forced_eval = verdict(forced) if isinstance(forced, bool) else verdict(None, forced)
    return {
        "checkpoint_id": f"c-{parent}-{position}", "parent_rollout_id": parent, "problem_id": problem,
        "checkpoint_token": position, "status": "COMPLETED", "availability_status": "AVAILABLE",
        "forced_generation": generation(tokens, elapsed, "EOS", allocated, reserved),
        "forced_evaluation": forced_eval, "final_evaluation_reference": verdict(final),
        "transition_label": label, **extra,
    }


EXCLUDED_BASE = {"eligible": False, "reasons": [{"code": "BASE_TERMINATION_NOT_NATURAL_EOS"}]}
ROLLOUTS = [
    base("r-1", "p-1", True, 10, 1.0, "MAX_NEW_TOKENS", 110, 210),
    base("r-2", "p-1", False, 20, 2.0, allocated=120, reserved=220),
    base("r-3", "p-2", True, 30, 3.0, allocated=130, reserved=230),
    base("r-4", "p-2", True, 40, 4.0, allocated=140, reserved=240, analytic_eligibility=EXCLUDED_BASE),
]
CHECKPOINTS = [
    child("r-1", "p-1", 2, False, True, "W_TO_C", 5, 0.5, 310, 360),
    child("r-2", "p-1", 2, False, False, "W_TO_W", 6, 0.6, 320, 370),
    child("r-3", "p-2", 2, True, True, "C_TO_C", 7, 0.7, 330, 380),
    child("r-4", "p-2", 2, False, True, "W_TO_C", 8, 0.8),
    {"checkpoint_id": "c5", "parent_rollout_id": "r-1", "problem_id": "p-1", "checkpoint_token": 4,
     "status": "UNAVAILABLE", "availability_status": "AFTER_THINK_CLOSE"},
    {"checkpoint_id": "c6", "parent_rollout_id": "r-2", "problem_id": "p-1", "checkpoint_token": 4,
     "status": "FAILED", "availability_status": "AVAILABLE",
     "failure": {"error_type": "OutOfMemoryError", "cuda_oom": True}},
    child("r-3", "p-2", 4, "NON_EVALUABLE", True, None),
]


def write(folder, documents):
    folder.mkdir(parents=True, exist_ok=True)
    for number, document in enumerate(documents):
        (folder / f"{number}.json").write_text(json.dumps(document, indent=2), encoding="utf-8")
    return str(folder)


@pytest.fixture(scope="module")
def campaign(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("campaign")
    rollouts = receipts.typed_rollouts(receipts.read_receipts(spark, write(root / "rollouts", ROLLOUTS)))
    checkpoints = receipts.typed_checkpoints(receipts.read_receipts(spark, write(root / "checkpoints", CHECKPOINTS)))
    land = str(root / "landed")
    receipts.land_receipts(rollouts, land + "/rollouts")
    receipts.land_receipts(checkpoints, land + "/checkpoints")
    planned = spark.createDataFrame([(f"r-{i}",) for i in range(1, 5)], "rollout_id string")
    return spark.read.parquet(land + "/rollouts"), spark.read.parquet(land + "/checkpoints"), planned


def test_accuracy_lengths_and_stages(campaign):
    rollouts, checkpoints, _ = campaign
    accuracy = rows(stages.final_accuracy(rollouts))[0]
    assert (accuracy["correct"], accuracy["evaluable"], accuracy["excluded"]) == (2, 3, 1)
    assert accuracy["accuracy"] == pytest.approx(2 / 3)
    lengths = rows(stages.length_distribution(rollouts))[0]
    assert (lengths["count"], lengths["p50"], lengths["max"], lengths["total"]) == (4, 20.0, 40.0, 100.0)
    assert rows(stages.termination_summary(rollouts))[0]["cap_reached"] == 1
    assert rows(stages.failure_summary(checkpoints))[0]["explicit_oom"] == 1
    performance = rows(stages.generation_performance(rollouts))[0]
    assert performance["token_total"] == 100
    assert performance["tokens_per_second"] == pytest.approx(10.0)
    assert rows(stages.peak_memory(rollouts))[0]["peak_allocated_bytes"] == 140
    assert rows(stages.peak_memory(checkpoints))[0]["peak_reserved_bytes"] == 380
    counts = {(r["counter"], r["key"]): r["n"] for r in rows(stages.eligibility_summary(rollouts))}
    assert counts[("receipts", "EXCLUDED")] == 1
    assert counts[("status", "NOT_DECLARED_LEGACY_ELIGIBLE")] == 3


def test_accounting(campaign):
    _, checkpoints, planned = campaign
    found = {(r["scope"], r["metric"]): r["n"] for r in rows(accounting.checkpoint_accounting(checkpoints, planned, POSITIONS))}
    assert found[("all", "expected")] == 8
    assert found[("all", "recorded")] == 7
    assert found[("all", "missing")] == 1
    assert found[("2", "recorded_receipts")] == 4
    assert found[("4", "receipt_status:FAILED")] == 1


def test_transitions(campaign):
    rollouts, checkpoints, _ = campaign
    facts = transitions.transition_facts(checkpoints, rollouts, POSITIONS)
    primary = transitions.primary_transitions(facts)
    rates = {r["checkpoint_token"]: r for r in rows(transitions.transition_rates_by_checkpoint(primary, POSITIONS))}
    two = rates[2]
    assert [two[k] for k in ("evaluable_transitions", "w_to_c", "w_to_w", "c_to_c", "c_to_w")] == [3, 1, 1, 1, 0]
    assert two["recovery_rate"] == pytest.approx(0.5)
    assert rates[4]["evaluable_transitions"] == 0 and rates[4]["recovery_rate"] is None
    contrasts = {r["scope"]: r for r in rows(transitions.matched_contrasts(primary, POSITIONS))}
    overall = contrasts["all_declared_checkpoints"]
    assert (overall["groups_mixed"], overall["w_to_c_in_mixed"], overall["w_to_w_in_mixed"]) == (1, 1, 1)
    concentration = {r["label"]: r for r in rows(transitions.event_concentration(primary, POSITIONS))}
    assert (concentration["W_TO_C"]["event_count"], concentration["W_TO_C"]["distinct_problems"]) == (1, 1)
    assert concentration["C_TO_W"]["event_count"] == 0 and concentration["C_TO_W"]["max_problem_share"] is None
    observed = transitions.transition_rates_by_checkpoint(transitions.observed_transitions(facts), POSITIONS)
    assert keyed(observed, "checkpoint_token", "w_to_c")[2] == 2
    funnel = {(r["counter"], r["key"]): r["n"] for r in rows(transitions.transition_funnel(checkpoints, rollouts, POSITIONS))}
    assert funnel[("stage", "PARENT_BASE_ANALYTICALLY_EXCLUDED")] == 1
    assert funnel[("exclusion_reason", "BASE_TERMINATION_NOT_NATURAL_EOS")] == 1
    assert funnel[("stage", "CHECKPOINT_RECEIPT_NOT_COMPLETED")] == 2


def test_report_is_content_addressed_and_private(campaign, tmp_path):
    rollouts, checkpoints, planned = campaign
    report = report_rows(analysis_sections(rollouts, checkpoints, planned, POSITIONS))
    first = write_summary(report, str(tmp_path))
    second = write_summary(report.orderBy("metric"), str(tmp_path))
    assert first == second
    text = " ".join(str(v) for r in report.collect() for v in r)
    for private in ("private prompt", "private completion", "r-1", "p-1"):
        assert private not in text


def _single(spark, tmp_path, rollout_extra=None, checkpoint_extra=None):
    rollouts = [base("r-1", "p-1", True, 4, 1.0, **(rollout_extra or {}))]
    checkpoints = [child("r-1", "p-1", 2, False, True, "W_TO_C", **(checkpoint_extra or {}))]
    read = lambda name, docs: receipts.read_receipts(spark, write(tmp_path / name, docs))
    return receipts.typed_rollouts(read("r", rollouts)), receipts.typed_checkpoints(read("c", checkpoints))


def test_malformed_eligibility_fails_closed(spark, tmp_path):
    rollouts, checkpoints = _single(spark, tmp_path, {"analytic_eligibility": "not-a-boolean"})
    assert rows(stages.final_accuracy(rollouts))[0]["evaluable"] == 0
    counts = {(r["counter"], r["key"]): r["n"] for r in rows(stages.eligibility_summary(rollouts))}
    assert counts[("status", "MALFORMED_EXPLICIT_FIELD_EXCLUDED")] == 1
    funnel = {(r["counter"], r["key"]): r["n"] for r in rows(transitions.transition_funnel(checkpoints, rollouts, (2,)))}
    assert funnel[("stage", "PARENT_BASE_ANALYTICALLY_EXCLUDED")] == 1


def test_excluded_checkpoint_keeps_observed_transition(spark, tmp_path):
    excluded = {"eligible": False, "reasons": [{"code": "FORCED_TERMINATION_NOT_NATURAL_EOS"}]}
    rollouts, checkpoints = _single(spark, tmp_path, checkpoint_extra={"analytic_eligibility": excluded})
    facts = transitions.transition_facts(checkpoints, rollouts, (2,))
    assert transitions.primary_transitions(facts).count() == 0
    assert [r["label"] for r in transitions.observed_transitions(facts).collect()] == ["W_TO_C"]
    funnel = {(r["counter"], r["key"]): r["n"] for r in rows(transitions.transition_funnel(checkpoints, rollouts, (2,)))}
    assert funnel[("stage", "CHECKPOINT_ANALYTICALLY_EXCLUDED")] == 1
    assert funnel[("exclusion_reason", "FORCED_TERMINATION_NOT_NATURAL_EOS")] == 1


def test_runtime_contract(spark, tmp_path):
    memory = dict(allocated_bytes=256, reserved_bytes=384, peak_allocated_bytes=448, peak_reserved_bytes=512)
    (tmp_path / "contract.json").write_text(json.dumps({"runtime": {"memory_after_load": memory}}))
    found = rows(inputs.read_runtime_contract(spark, str(tmp_path / "contract.json")))[0]
    assert found == {"status": "RECORDED", **memory}
    absent = rows(inputs.read_runtime_contract(spark, str(tmp_path / "nothing.json")))[0]
    assert absent["status"] == "NOT_RECORDED" and absent["allocated_bytes"] is None

"""Receipts of returned requests: one canonical JSON record per base rollout and per declared checkpoint.

A receipt carries the identity of its run and problem, what was asked, what came back or failed, and for a checkpoint
the labels and the censoring decision with its criteria. Keys are in sorted order at every level and nulls are
written, so equal receipts are equal strings; the time comes with the returned row, so the same rows always
give the same receipts and :func:`trailmark.sinks.writers.append_once` takes them any number of times. Token arrays
of a checkpoint's prefix and input are replaced by their hashes before anything is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.functions.identity import checkpoint_id, lower_escapes, plain_json, rollout_id, safe_name, token_hash
from trailmark.functions.labels import classify_transition
from trailmark.functions.tokens import termination_status, thinking_boundary, token_array
from trailmark.functions.verifier import Verifier, verdict_of
from trailmark.operators import planning, selection, trajectory
from trailmark.operators.grading import evaluate_answers, extract_answers
from trailmark.params import CampaignPlan, CensoringPolicy, Decoding, RunContext

# Recorded receipts carry them.
COORDINATE = "raw generated token IDs after the native chat-template prompt; includes emitted <think> opening token when present"
INTERRUPTED_MESSAGE = "prior invocation ended after intent start without a receipt"
NATIVE_BACKEND = "trailmark-native"
MEMORY = ("allocated_bytes", "peak_allocated_bytes", "peak_reserved_bytes", "reserved_bytes")


def _object(**fields: Column) -> Column:
    return F.struct(*[fields[name].alias(name) for name in sorted(fields)])


def _null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _if(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def answer_records(
    returned: DataFrame, verifier: Verifier | None = None, reference: str = "reference_answer", text: str = "generated_text"
) -> DataFrame:
    """Adds ``extraction`` and ``evaluation`` as receipts carry them, graded natively or by ``verifier``.

    A verifier that raises for a pair makes that row an ERROR with the phase's reason and the error's type.
    """
    extracted = extract_answers(returned, text)
    if verifier is None:
        native = evaluate_answers(extracted, reference)
        e = F.col("evaluation")
        return native.withColumn("evaluation", _evaluation(
            e["status"], e["correct"], e["reason"], _null(), e["parsed_reference_count"], e["parsed_candidate_count"], NATIVE_BACKEND, None))
    return evaluate_with(extracted.withColumn("_candidate", F.col("extraction.extracted_text")), verifier, reference, "_candidate",
                         F.col("extraction.status")).drop("_candidate", "phase")


def _evaluation(status, correct, reason, error_type, references, candidates, name, version) -> Column:
    return _object(
        status=status, correct=correct, reason=reason, error_type=error_type, parsed_reference_count=references,
        parsed_candidate_count=candidates, backend_name=F.lit(name).cast("string"), backend_version=F.lit(version).cast("string"),
    )


def evaluate_with(
    answers: DataFrame, verifier: Verifier, reference: str, candidate: str, extraction_status: Column | None = None
) -> DataFrame:
    """Adds ``evaluation`` and ``phase`` (where a verifier stopped: REFERENCE, CANDIDATE or VERIFY; else NULL).

    Only pairs that can be graded reach Python: answers that were not extracted and missing or blank ones are
    settled before, with the reasons of :func:`trailmark.operators.grading.evaluate_pairs`.
    """
    blank = lambda name: F.coalesce(F.trim(F.regexp_replace(name, r"\s+", " ")) == "", F.lit(True))
    status = F.lit("EXTRACTED") if extraction_status is None else extraction_status
    early = (
        F.when(status == "ERROR", "answer extraction failed")
        .when(status != "EXTRACTED", F.concat(F.lit("answer extraction status: "), status))
        .when(blank(reference), "missing or empty reference answer")
        .when(blank(candidate), "missing or empty candidate answer")
    )
    staged = answers.withColumn("_early", early)
    open_ = F.col("_early").isNull()
    judged = staged.withColumn("_v", verdict_of(verifier, F.when(open_, F.col(reference)), F.when(open_, F.col(candidate))))
    v = F.col("_v")
    settled = F.when(status == "ERROR", "ERROR").when(~open_, "NON_EVALUABLE").otherwise(v["status"])
    evaluation = _evaluation(
        settled, v["correct"], F.coalesce("_early", v["reason"]), v["error_type"], v["parsed_reference_count"],
        v["parsed_candidate_count"], verifier.name, verifier.version,
    )
    return judged.withColumns({"evaluation": evaluation, "phase": v["phase"]}).drop("_early", "_v")


def _run(run: RunContext, record_type: str) -> dict[str, Column]:
    text = lambda value: F.lit(value).cast("string")
    return {
        "schema_version": F.lit(1), "record_type": F.lit(record_type), "run_id": text(run.run_id),
        "manifest_hash": text(run.manifest_hash), "config_hash": text(run.config_hash),
        "runtime_provenance_sha256": text(run.runtime_provenance_sha256), "source_git_commit": text(run.source_git_commit),
    }


def _decoding(decoding: Decoding, seed: Column) -> Column:
    return _object(
        request_kind=F.lit(decoding.request_kind), max_new_tokens=F.lit(decoding.max_new_tokens), do_sample=F.lit(decoding.do_sample),
        temperature=F.lit(decoding.temperature).cast("double"), top_p=F.lit(decoding.top_p).cast("double"),
        top_k=F.lit(decoding.top_k).cast("int"), min_p=F.lit(decoding.min_p).cast("double"), seed=seed if decoding.do_sample else _null("bigint"),
    )


def _memory(name: str) -> Column:
    v = F.col(name)
    return _if(v.isNotNull(), _object(**{field: v[field] for field in MEMORY}))


def _failure() -> Column:
    return _object(
        error_type=F.col("error_type"), message=F.col("message"), cuda_oom=F.coalesce("cuda_oom", F.lit(False)),
        elapsed_seconds=F.col("elapsed_seconds"), memory_before=_memory("memory_before"), memory_after=_memory("memory_after"),
    )


def _interrupted() -> Column:
    none = _if(F.lit(False), _object(**{field: _null("bigint") for field in MEMORY}))
    return _object(
        error_type=F.lit("INTERRUPTED_UNKNOWN"), message=F.lit(INTERRUPTED_MESSAGE), cuda_oom=F.lit(False),
        elapsed_seconds=_null("double"), memory_before=none, memory_after=none,
    )


def _generation(decoding: Decoding, seed: Column, count: Column, digest: Column, **more: Column) -> Column:
    before, after = F.col("memory_before"), F.col("memory_after")
    return _object(
        input_token_count=count, input_token_ids_sha256=digest, generated_token_ids=F.col("generated_token_ids"),
        generated_token_ids_sha256=token_hash(F.col("generated_token_ids")), generated_token_count=F.size("generated_token_ids"),
        generated_text=F.col("generated_text"), elapsed_seconds=F.col("elapsed_seconds"), termination_status=F.col("termination"),
        memory_before=_memory("memory_before"), memory_after=_memory("memory_after"),
        memory_delta_bytes=_object(
            allocated=after["allocated_bytes"] - before["allocated_bytes"], reserved=after["reserved_bytes"] - before["reserved_bytes"]
        ),
        decoding=_decoding(decoding, seed), **more,
    )


def base_facts(
    returned: DataFrame, run: RunContext, marker: Sequence[int], eos_ids: Sequence[int], decoding: Decoding, verifier: Verifier | None = None
) -> DataFrame:
    """Returned base requests with identity, status, termination, marker search, extraction and evaluation.

    ``returned`` has problem_id, source_index, problem, reference_answer, level, subject, rollout_seed, user_prompt,
    chat_prompt_text, prompt_token_ids (NULL if the prompt was never tokenized), generated_token_ids, generated_text,
    elapsed_seconds, memory_before, memory_after, timestamp_utc, and of a failed request error_type, message and
    cuda_oom; ``interrupted`` may mark a started request of which nothing came back. One row per request.
    """
    named = selection.content_hashes(returned).withColumn(
        "rollout_id", rollout_id(F.lit(run.manifest_hash), F.col("problem_id"), F.col("rollout_seed"))
    )
    interrupted = F.coalesce("interrupted", F.lit(False)) if "interrupted" in returned.columns else F.lit(False)
    status = F.when(interrupted, "INTERRUPTED_UNKNOWN").when(F.col("error_type").isNotNull(), "FAILED").otherwise("COMPLETED")
    done = F.col("status") == "COMPLETED"
    facts = named.withColumn("status", status)
    facts = facts.withColumns({
        "generated_text": _if(done, F.col("generated_text")), "generated_token_ids": _if(done, F.col("generated_token_ids")),
    })
    searched = facts.withColumns({
        "termination": _if(done, termination_status(F.col("generated_token_ids"), eos_ids, decoding.max_new_tokens)),
        "boundary": _if(done, thinking_boundary(F.col("generated_token_ids"), marker)),
    })
    return answer_records(searched, verifier)


def base_receipts(facts: DataFrame, run: RunContext, marker: Sequence[int], decoding: Decoding) -> DataFrame:
    """rollout_id, file_name, status and the receipt of every row of :func:`base_facts`."""
    ids, seed = F.col("prompt_token_ids"), F.col("rollout_seed")
    identity = _run(run, "BASE_ROLLOUT") | {
        name: F.col(name)
        for name in ("rollout_id", "problem_id", "source_index", "problem", "reference_answer", "rollout_seed", "timestamp_utc", "status", *selection.HASHES)
    }
    identity["metadata"] = _object(level=F.col("level"), subject=F.col("subject"))
    prompt = _object(user_prompt=F.col("user_prompt"), chat_prompt_text=F.col("chat_prompt_text"), token_ids=ids, token_ids_sha256=token_hash(ids))
    boundary = F.col("boundary")
    thinking = _object(
        coordinate=F.lit(COORDINATE), close_think_marker_token_ids=token_array(marker), close_think_marker_sha256=token_hash(token_array(marker)),
        first_close_marker_start_zero_based=boundary["first_close_marker_start"], close_marker_count=boundary["close_marker_count"],
        status=boundary["marker_status"],
    )
    completed = _object(
        **identity, prompt=prompt, generation=_generation(decoding, seed, F.size(ids), token_hash(ids), input_token_ids=ids),
        thinking_boundary=thinking, final_extraction=_sorted(F.col("extraction"), EXTRACTION), final_evaluation=F.col("evaluation"),
    )
    failed = _object(
        **identity, prompt_rendered=F.col("user_prompt"), prompt=_if(ids.isNotNull(), prompt), requested_decoding=_decoding(decoding, seed),
        failure=_failure(),
    )
    interrupted = _object(**identity, failure=_interrupted())
    return _written(facts, "rollout_id", completed, failed, interrupted)


EXTRACTION = ("end_offset", "extracted_text", "reason", "start_offset", "status")


def _sorted(value: Column, names: Sequence[str]) -> Column:
    return _object(**{name: value[name] for name in names})


def _written(facts: DataFrame, key: str, completed: Column, failed: Column, interrupted: Column, unavailable: Column | None = None) -> DataFrame:
    status = F.col("status")
    receipt = F.when(status == "COMPLETED", plain_json(completed)).when(status == "FAILED", plain_json(failed))
    if unavailable is not None:
        receipt = receipt.when(status == "UNAVAILABLE", plain_json(unavailable))
    receipt = lower_escapes(receipt.otherwise(plain_json(interrupted)))
    return facts.select(key, safe_name(F.col(key)).alias("file_name"), "status", receipt.alias("receipt"))


def checkpoint_facts(
    base: DataFrame,
    returned: DataFrame,
    plan: CampaignPlan,
    marker: Sequence[int],
    cue: Sequence[int],
    eos_ids: Sequence[int],
    decoding: Decoding,
    verifier: Verifier | None = None,
) -> DataFrame:
    """Every declared checkpoint of ``base`` (rows of :func:`base_facts`) with what came back for it.

    ``returned`` has checkpoint_id, generated_token_ids, generated_text, elapsed_seconds, memory_before,
    memory_after, timestamp_utc, error_type, message, cuda_oom and may have ``interrupted``; one row per forced request.
    A checkpoint that could be asked for but has no row there is still pending and is left out. Checkpoints
    that cannot be asked for, and those of rollouts that did not complete, are UNAVAILABLE with the reason.
    """
    parent = base.select(
        "rollout_id", "problem_id", "source_index", "rollout_seed", "reference_answer", "status", "prompt_token_ids",
        F.col("generated_token_ids").alias("token_ids"), F.col("termination").alias("base_termination"),
        F.col("boundary.first_close_marker_start").alias("close_marker_start"), F.col("boundary.close_marker_count").alias("close_marker_count"),
        F.col("evaluation.status").alias("final_status"), F.col("evaluation.correct").alias("final_correct"),
        F.col("timestamp_utc").alias("base_timestamp"),
    )
    done = F.col("status") == "COMPLETED"
    cut = trajectory.fixed_checkpoints(
        parent.where(done).withColumn("base_generated_token_count", F.size("token_ids")), plan.positions, marker, eos_ids
    )
    asked = trajectory.forced_input(cut, cue).drop("input_token_ids")
    children = asked.unionByName(cut.where("availability_status <> 'AVAILABLE'"), allowMissingColumns=True).drop("prefix_token_ids", "prompt_token_ids", "status")
    children = children.withColumn("checkpoint_token", F.col("checkpoint_token").cast("bigint"))
    stopped = planning.unavailable_children(parent, plan.positions, keep=("source_index", "base_timestamp"))
    stopped = stopped.drop("checkpoint_id", "status").withColumnRenamed("parent_rollout_id", "rollout_id")
    children = children.unionByName(stopped, allowMissingColumns=True)
    children = children.withColumn("checkpoint_id", checkpoint_id(F.col("rollout_id"), F.col("checkpoint_token")))
    met = children.join(returned.withColumn("_met", F.lit(True)), "checkpoint_id", "left")
    available = F.col("availability_status") == "AVAILABLE"
    interrupted = F.coalesce("interrupted", F.lit(False)) if "interrupted" in returned.columns else F.lit(False)
    status = (
        F.when(~available, "UNAVAILABLE").when(interrupted, "INTERRUPTED_UNKNOWN")
        .when(F.col("error_type").isNotNull(), "FAILED").otherwise("COMPLETED")
    )
    met = met.where(~available | F.col("_met")).withColumn("status", status).drop("_met")
    done = F.col("status") == "COMPLETED"
    met = met.withColumns({
        "generated_text": _if(done, F.col("generated_text")), "generated_token_ids": _if(done, F.col("generated_token_ids")),
        "timestamp_utc": F.coalesce("timestamp_utc", "base_timestamp"),
    })
    met = met.withColumn("termination", _if(done, termination_status(F.col("generated_token_ids"), eos_ids, decoding.max_new_tokens)))
    return answer_records(met, verifier).withColumns({
        "forced_status": _if(done, F.col("evaluation.status")), "forced_correct": _if(done, F.col("evaluation.correct")),
    })


def eligibility_record(policy: CensoringPolicy) -> Column:
    """The censoring decision over the columns of :func:`checkpoint_facts`, with every criterion and reason.

    The reasons have different keys, so each is a VARIANT.
    """
    sure = lambda condition: F.coalesce(condition, F.lit(False))
    allowed = F.array(*[F.lit(s) for s in policy.evaluable_statuses])
    start = F.col("close_marker_start")
    status = lambda required, column: {"required_status": F.lit(required), "observed_status": F.col(column)}
    evaluable = lambda column: {"allowed_statuses": allowed, "observed_status": F.col(column)}
    marker = {"required": F.lit(policy.require_close_marker), "observed_marker_start_zero_based": start}
    # Criterion -> code, whether it holds, what a reason shows, what the criterion shows in its place.
    criteria = {
        "checkpoint_available": (
            "CHECKPOINT_NOT_AVAILABLE", sure(F.col("availability_status") == "AVAILABLE"), status("AVAILABLE", "availability_status"),
            {"required": F.lit(policy.require_checkpoint_available), "observed_status": F.col("availability_status")},
        ),
        "base_terminated_naturally": (
            "BASE_TERMINATION_NOT_NATURAL_EOS", sure(F.col("base_termination") == policy.required_base_termination),
            status(policy.required_base_termination, "base_termination"), None,
        ),
        "base_has_close_think_marker": (
            "BASE_CLOSE_THINK_MARKER_MISSING", sure(start >= 0), marker, marker | {"observed_marker_count": F.col("close_marker_count")},
        ),
        "forced_terminated_naturally": (
            "FORCED_TERMINATION_NOT_NATURAL_EOS", sure(F.col("termination") == policy.required_forced_termination),
            status(policy.required_forced_termination, "termination"), None,
        ),
        "original_final_evaluable": (
            "ORIGINAL_FINAL_NOT_EVALUABLE", sure(F.col("final_status").isin(*policy.evaluable_statuses)), evaluable("final_status"), None,
        ),
        "forced_answer_evaluable": (
            "FORCED_ANSWER_NOT_EVALUABLE", sure(F.col("forced_status").isin(*policy.evaluable_statuses)), evaluable("forced_status"), None,
        ),
    }
    shown = {name: _object(**(seen or given), passed=ok) for name, (_, ok, given, seen) in criteria.items()}
    reasons = [
        F.when(~ok, F.parse_json(plain_json(_object(code=F.lit(code), **given)))) for code, ok, given, _ in criteria.values()
    ]
    passed = [ok for _, ok, _, _ in criteria.values()]
    eligible = passed[0]
    for ok in passed[1:]:
        eligible = eligible & ok
    return _object(
        policy_id=F.lit(policy.policy_id), eligible=eligible, criteria=_object(**shown),
        reasons=F.filter(F.array(*reasons), lambda reason: reason.isNotNull()),
    )


def checkpoint_receipts(
    facts: DataFrame, run: RunContext, cue: Sequence[int], decoding: Decoding, policy: CensoringPolicy = CensoringPolicy()
) -> DataFrame:
    """checkpoint_id, file_name, status and the receipt of every row of :func:`checkpoint_facts`."""
    decided = facts.withColumns({
        "decision": eligibility_record(policy),
        "observed": classify_transition(F.col("forced_status"), F.col("forced_correct"), F.col("final_status"), F.col("final_correct")),
    })
    identity = _run(run, "FORCED_CHECKPOINT") | {
        name: F.col(name)
        for name in ("checkpoint_id", "problem_id", "source_index", "rollout_seed", "checkpoint_token", "status", "availability_status", "timestamp_utc")
    }
    identity |= {"parent_rollout_id": F.col("rollout_id"), "analytic_eligibility": F.col("decision")}
    labels = {
        "observed_transition_label": F.col("observed"), "transition_label": F.when(F.col("decision.eligible"), F.col("observed")),
    }
    no_labels = {"observed_transition_label": _null(), "transition_label": _null()}
    prefix = {"saved_prefix_token_count": F.col("checkpoint_token"), "saved_prefix_sha256": F.col("prefix_sha256")}
    cue_ids = token_array(cue)
    given = _object(
        prompt_token_count=F.col("prompt_token_count"), prompt_sha256=F.col("prompt_sha256"),
        saved_prefix_token_count=F.col("saved_prefix_token_count"), saved_prefix_sha256=F.col("prefix_sha256"),
        close_think_cue_token_ids=cue_ids, close_think_cue_sha256=F.col("cue_sha256"),
        input_token_count=F.col("input_token_count"), input_sha256=F.col("input_sha256"),
    )
    reference = _object(status=F.col("final_status"), correct=F.col("final_correct"))
    seed = _null("bigint")
    completed = _object(
        **identity, **labels, **prefix, forced_answer_input=given, final_evaluation_reference=reference,
        forced_generation=_generation(decoding, seed, F.col("input_token_count"), F.col("input_sha256")),
        forced_extraction=_sorted(F.col("extraction"), EXTRACTION), forced_evaluation=F.col("evaluation"),
    )
    failed = _object(
        **identity, **no_labels, **prefix, forced_answer_input=given, final_evaluation_reference=reference,
        requested_decoding=_decoding(decoding, seed), failure=_failure(),
    )
    interrupted = _object(**identity, **no_labels, **prefix, failure=_interrupted())
    unavailable = _object(
        **identity, **no_labels, reason=F.col("reason"), base_generated_token_count=F.col("base_generated_token_count")
    )
    return _written(decided, "checkpoint_id", completed, failed, interrupted, unavailable)

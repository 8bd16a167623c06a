"""Ledger, recovery, planning, sinks, quantiles and streaming on small tables."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import keyed, rows
from trailmark.operators import accounting, ledger, planning, selection, stages, summary
from trailmark.plans.campaign import base_requests, prepare_manifest
from trailmark.params import CampaignPlan
from trailmark.sinks import writers
from trailmark.sources import inputs, receipts
from trailmark.streaming import live


def _events(spark, histories):
    codes = {"S": "INTENT_STARTED", "C": "BASE_COMPLETED", "F": "CHECKPOINT_FAILED", "I": "INTERRUPTED_UNKNOWN", "n": "NOTE"}
    data = [(seq, name, codes[c]) for name, text in histories.items() for seq, c in enumerate(text)]
    return spark.createDataFrame(data, "seq int, intent_id string, event_type string").repartition(4)


HISTORIES = {
    "S": ("STARTED_UNKNOWN", None), "SC": ("COMPLETED", None), "SnF": ("FAILED", None), "SI": ("INTERRUPTED_UNKNOWN", None),
    "C": (None, "TERMINAL_WITHOUT_START"), "CS": (None, "TERMINAL_WITHOUT_START"), "SS": (None, "DUPLICATE_START"),
    "SCS": (None, "DUPLICATE_START"), "SCC": (None, "DUPLICATE_TERMINAL"), "SSC": (None, "DUPLICATE_START"),
    "SCSSSS": (None, "DUPLICATE_START"), "SCFS": (None, "DUPLICATE_TERMINAL"),
}


def test_intent_states(spark):
    events = _events(spark, {h: h for h in HISTORIES})
    found = {r["intent_id"]: (r["state"], r["violation"]) for r in rows(ledger.intent_states(events))}
    assert found == HISTORIES
    with pytest.raises(Exception, match="TERMINAL_WITHOUT_START"):
        ledger.intent_states(_events(spark, {"C": "C"}), strict=True).collect()
    streamed = {r["intent_id"]: (r["state"], r["is_violation"]) for r in rows(live.stream_intent_states(events))}
    assert streamed == {h: (s, v is not None) for h, (s, v) in HISTORIES.items()}


def test_dangling_intent_is_closed_once(spark):
    events = _events(spark, {"a": "S", "b": "SC"})
    closing = rows(ledger.interrupted_intents(events))
    assert [(r["intent_id"], r["event_type"]) for r in closing] == [("a", "INTERRUPTED_UNKNOWN")]
    after = _events(spark, {"a": "SI", "b": "SC"})
    assert keyed(ledger.intent_states(after), "intent_id", "state")["a"] == "INTERRUPTED_UNKNOWN"
    assert ledger.interrupted_intents(after).count() == 0


def test_recovery_events_are_appended_once(spark, tmp_path):
    events = _events(spark, {"intent:a": "S", "intent:b": "S", "intent:c": "SC"})
    stored = spark.createDataFrame([("b", "FAILED"), ("c", "COMPLETED")], "receipt_id string, status string")
    recovery = ledger.intent_receipt_recovery(ledger.intent_states(events), stored)
    due = ledger.recovery_events(events, recovery, "CHECKPOINT")
    last = events.agg(F.max("seq")).head()[0]
    assert sorted(r["seq"] for r in rows(due)) == [last + 1, last + 2]
    assert keyed(due, "intent_id", "event_type") == {"intent:a": "INTERRUPTED_UNKNOWN", "intent:b": "CHECKPOINT_FAILED"}
    path = str(tmp_path / "ledger")
    writers.append_ledger(events.withColumn("payload", F.parse_json(F.lit("{}"))), path)
    writers.append_ledger(due, path)
    after = inputs.read_ledger(spark, path)
    states = keyed(ledger.intent_states(after), "intent_id", "state")
    assert states == {"intent:a": "INTERRUPTED_UNKNOWN", "intent:b": "FAILED", "intent:c": "COMPLETED"}
    again = ledger.intent_receipt_recovery(ledger.intent_states(after), stored.unionByName(
        spark.createDataFrame([("a", "INTERRUPTED_UNKNOWN")], stored.schema)))
    assert ledger.recovery_events(after, again, "CHECKPOINT").count() == 0


def test_replay_without_a_full_order_does_not_depend_on_partitions(spark):
    events = spark.createDataFrame(
        [("a", None, "BASE_COMPLETED"), ("a", None, "INTENT_STARTED"), ("b", 4, "BASE_FAILED"), ("b", 4, "INTENT_STARTED"),
         ("c", None, "INTENT_STARTED"), ("c", 2, "BASE_COMPLETED")], "intent_id string, seq long, event_type string")
    expected = {"a": "COMPLETED", "b": "FAILED", "c": None}
    for parts in (1, 3, 7):
        dealt = events.repartition(parts)
        assert keyed(ledger.intent_states(dealt), "intent_id", "state") == expected
        assert keyed(live.stream_intent_states(dealt), "intent_id", "state") == expected


def test_strict_ledger_needs_seq(spark, tmp_path):
    path = tmp_path / "events"
    path.mkdir()
    (path / "a.json").write_text('{"seq": 1, "event_type": "INTENT_STARTED", "intent_id": "a"}\n{"event_type": "BASE_COMPLETED", "intent_id": "a"}\n')
    with pytest.raises(Exception, match="seq"):
        inputs.read_ledger(spark, str(path)).count()
    assert inputs.read_ledger(spark, str(path), strict_mode=False).count() == 2


@pytest.mark.parametrize("n", [0, 3])
def test_manifest_larger_than_its_source_fails(spark, n):
    problems = spark.range(n).select(
        F.col("id").cast("string").alias("problem_id"), F.col("id").alias("source_index"), F.lit("p").alias("problem"),
        F.lit("a").alias("reference_answer"), F.lit(1).alias("level"), F.lit("s").alias("subject"))
    with pytest.raises(Exception, match="10 problems asked for"):
        selection.selection_manifest(problems, 1, 10).collect()
    if n:
        assert selection.selection_manifest(problems, 1, n).count() == n


def test_declared_positions_stay_without_receipts(spark):
    given = spark.createDataFrame([(256, "AVAILABLE", "COMPLETED"), (99, None, None)],
                                     "checkpoint_token long, availability_status string, status string")
    found = rows(accounting.availability_by_position(given, (256, 512)), "checkpoint_token", "metric")
    assert [(r["checkpoint_token"], r["metric"], r["n"]) for r in found] == [
        (256, "AVAILABLE", 1), (256, "receipt_COMPLETED", 1), (512, None, 0), (99, "UNKNOWN", 1), (99, "receipt_UNKNOWN", 1)]


def test_landing_again_doubles_nothing(spark, tmp_path):
    typed = spark.createDataFrame([("r1", "run-1"), ("r2", "run-1")], "rollout_id string, run string")
    other = spark.createDataFrame([("r9", "run-2")], "rollout_id string, run string")
    path = str(tmp_path / "landed")
    for df in (typed, other, typed):
        receipts.land_receipts(df, path, ("run",))
    assert sorted(r["rollout_id"] for r in rows(spark.read.parquet(path))) == ["r1", "r2", "r9"]


def test_recovery_actions(spark):
    states = ledger.intent_states(_events(spark, {
        "intent:a": "S", "intent:b": "S", "intent:c": "SC", "intent:d": "SI", "intent:e": "SC", "intent:f": "S", "intent:g": "SS"}))
    stored = spark.createDataFrame([("b", "COMPLETED"), ("e", "COMPLETED"), ("f", "WEIRD"), ("x", "COMPLETED"), ("u", "UNAVAILABLE")],
                                   "receipt_id string, status string")
    found = keyed(ledger.intent_receipt_recovery(states, stored), "intent_id", "action")
    assert found == {
        "intent:a": "MARK_INTERRUPTED", "intent:b": "RECOVER_COMPLETED", "intent:c": "ERROR_TERMINAL_WITHOUT_RECEIPT",
        "intent:d": "SYNTHESISE_INTERRUPTED_RECEIPT", "intent:e": "KEEP", "intent:f": "ERROR_UNSUPPORTED_RECEIPT_STATUS",
        "intent:g": "ERROR_INVALID_HISTORY", "intent:x": "ERROR_RECEIPT_WITHOUT_INTENT"}


def test_staged_campaign_runs_only_missing_rollouts(spark):
    manifest = spark.createDataFrame([("p-1",), ("p-2",)], "problem_id string")
    plan = CampaignPlan(seeds=(101, 102))
    none = spark.createDataFrame([], "seq int, intent_id string, event_type string")
    everything = base_requests(manifest, none, plan, "a" * 64)
    assert everything.count() == 4
    first = everything.where("problem_id = 'p-1' AND rollout_seed = 101").select("rollout_id").head()[0]
    assert first == "rollout:" + "a" * 16 + ":p-1:seed-101"
    done = spark.createDataFrame([(1, "intent:" + first, "INTENT_STARTED")], "seq int, intent_id string, event_type string")
    assert base_requests(manifest, done, plan, "a" * 64).count() == 3


def test_failed_parent_makes_every_child_unavailable(spark):
    parents = spark.createDataFrame([("r1", "p", 1, "FAILED"), ("r2", "p", 2, "INTERRUPTED_UNKNOWN"), ("r3", "p", 3, "COMPLETED"), ("r4", "p", 4, None)],
                                    "rollout_id string, problem_id string, rollout_seed long, status string")
    found = rows(planning.unavailable_children(parents, (2, 4)))
    assert len(found) == 6
    assert {(r["parent_rollout_id"], r["availability_status"]) for r in found} == {
        ("r1", "PARENT_BASE_FAILED"), ("r2", "PARENT_BASE_INTERRUPTED_UNKNOWN"), ("r4", "PARENT_BASE_INTERRUPTED_UNKNOWN")}


def _problems(spark, n=20):
    data = [(str(i), i, f"problem {i}", str(i), i % 3, "algebra") for i in range(n)]
    return spark.createDataFrame(data, "problem_id string, source_index long, problem string, reference_answer string, level int, subject string")


def test_manifest_tampering_is_found(spark):
    problems = _problems(spark)
    manifest = prepare_manifest(problems, CampaignPlan(), 5)
    assert selection.verify_manifest(manifest, problems).count() == 0
    assert selection.verify_rank_order(manifest, problems, 20260926, 5).count() == 0
    first = manifest.head()["source_index"]
    changed = manifest.withColumn("problem_sha256", F.when(F.col("source_index") == first, "0").otherwise(F.col("problem_sha256")))
    assert rows(selection.verify_manifest(changed, problems)) == [{"source_index": first, "violation": "MISMATCH:problem_sha256"}]
    doubled = manifest.unionByName(manifest.where(F.col("source_index") == first))
    assert [r["violation"] for r in rows(selection.verify_manifest(doubled, problems))] == ["REPEATED_SOURCE_INDEX"]
    with pytest.raises(Exception, match="exceeds the reviewed manifest"):
        selection.bounded_scope(manifest, 6).collect()
    assert selection.bounded_scope(manifest, 2).count() == 2
    blank = problems.withColumn("problem", F.when(F.col("source_index") == 3, " ").otherwise(F.col("problem")))
    with pytest.raises(Exception, match="INVALID_PROBLEM"):
        prepare_manifest(blank, CampaignPlan(), 5).collect()


def test_problem_table_contract(spark):
    table = spark.createDataFrame([("p", "text", "4", 0)], "uid string, q string, a string, i int")
    assert inputs.read_problems(table, "uid", "q", "a", "i").columns == [
        "problem_id", "source_index", "problem", "reference_answer", "level", "subject"]
    with pytest.raises(ValueError, match="answer"):
        inputs.read_problems(table, "uid", "q", "answer", "i")
    with pytest.raises(ValueError, match="empty"):
        inputs.read_problems(table.limit(0), "uid", "q", "a", "i")


def test_append_once(spark, tmp_path):
    store = str(tmp_path / "store")
    first = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    writers.append_once(first, store, "id")
    writers.append_once(first.select("n", "id").select("id", "n"), store, "id")
    writers.append_once(spark.createDataFrame([("c", 3), ("c", 3)], "id string, n int"), store, "id")
    assert keyed(spark.read.parquet(store), "id", "n") == {"a": 1, "b": 2, "c": 3}
    assert spark.read.parquet(store).count() == 3
    with pytest.raises(writers.ConflictError):
        writers.append_once(spark.createDataFrame([("a", 9), ("d", 4)], "id string, n int"), store, "id")
    assert spark.read.parquet(store).count() == 3
    assert writers.read_store(spark, store).columns == ["id", "n"]


def test_append_once_edges(spark, tmp_path):
    store, schema = str(tmp_path / "store"), "id long, payload string"
    writers.append_once(spark.createDataFrame([], schema), store, "id")
    writers.append_once(spark.createDataFrame([(1, None), (2, "")], schema), store, "id")
    writers.append_once(spark.createDataFrame([(2, "")] * 3 + [(3, "é")], schema), store, "id")
    assert keyed(writers.read_store(spark, store), "id", "payload") == {1: None, 2: "", 3: "é"}
    for rows_ in ([(1, "")], [(4, "a"), (4, "b")]):
        with pytest.raises(writers.ConflictError):
            writers.append_once(spark.createDataFrame(rows_, schema), store, "id")
    with pytest.raises(ValueError, match="without id"):
        writers.append_once(spark.createDataFrame([(None, "x"), (9, "y")], schema), store, "id")
    with pytest.raises(ValueError, match="may not have"):
        writers.append_once(spark.createDataFrame([(5, 1)], "id long, _bucket int"), store, "id")
    assert writers.read_store(spark, store).count() == 3


def test_files_that_no_append_wrote_are_not_doubled(spark, tmp_path):
    path = str(tmp_path / "plain")
    spark.createDataFrame([(1, "x")], "id long, payload string").write.parquet(path)
    with pytest.raises(writers.ConflictError):
        writers.append_once(spark.createDataFrame([(1, "x")], "id long, payload string"), path, "id")


def test_ledger_round_trip_and_rejects(spark, tmp_path):
    path = str(tmp_path / "ledger")
    events = spark.createDataFrame([(1, "INTENT_STARTED", "i"), (2, "RUN_INVOCATION_STARTED", None)], "seq long, event_type string, intent_id string")
    writers.append_ledger(events.withColumn("payload", F.struct(F.lit("v").alias("invocation_id"))), path)
    writers.append_ledger(events.withColumn("seq", F.col("seq") + 2).withColumn("payload", F.lit(None).cast("string")), path)
    found = rows(inputs.read_ledger(spark, path), "seq")
    assert [(r["seq"], r["intent_id"], r["invocation_id"]) for r in found] == [(1, "i", "v"), (2, None, "v"), (3, "i", None), (4, None, None)]
    assert all(r["timestamp_utc"] is not None for r in found)
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"seq":1}\n\n{"seq":2}}\n[1]\nnot json\n')
    problems = [r["problem"] for r in rows(inputs.read_ledger(spark, str(bad), strict_mode=False))]
    assert sorted(p for p in problems if p) == ["BLANK_LINE", "MALFORMED_JSON", "MALFORMED_JSON", "NOT_AN_OBJECT"]
    with pytest.raises(Exception, match="in bad.jsonl"):
        inputs.read_ledger(spark, str(bad)).collect()


def test_receipt_directories(spark, tmp_path):
    assert receipts.read_receipts(spark, str(tmp_path / "absent")).count() == 0
    (tmp_path / "a.json").write_text(json.dumps({"b": 1, "a": 2}))
    (tmp_path / "b.json").write_text('{"a":2,\n "b":1}')
    (tmp_path / "note.txt").write_text("ignored")
    found = rows(receipts.receipt_content_hash(receipts.read_receipts(spark, str(tmp_path))), "file_name")
    assert [r["file_name"] for r in found] == ["a.json", "b.json"]
    assert found[0]["content_hash"] == found[1]["content_hash"]
    usage = rows(inputs.artifact_disk_usage(spark, str(tmp_path)))[0]
    assert usage == {"files": 3, "bytes": sum(p.stat().st_size for p in tmp_path.iterdir())}
    assert rows(inputs.artifact_disk_usage(spark, str(tmp_path / "absent")))[0] == {"files": 0, "bytes": 0}


def test_manifest_document_checks(spark, tmp_path):
    record = {"problem_id": "p", "source_index": 0, "selection_rank": "r", "problem_sha256": "a", "reference_answer_sha256": "b", "metadata_sha256": "c"}
    document = {"schema_version": 1, "config_hash": "c", "selection_size": 2, "dataset": {"selection_seed": 7}, "records": [record]}
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(document))
    loaded = inputs.read_document(spark, str(path))
    assert rows(inputs.manifest_records(loaded)) == [{"manifest_ordinal": 1, **record}]
    fields = {r["field"] for r in rows(inputs.manifest_header_violations(loaded, {"config_hash": "c", "dataset.selection_seed": 8}))}
    assert fields == {"dataset.selection_seed", "dataset.resolved_revision", "selection_size"}
    for broken in ({**document, "schema_version": True}, {**document, "records": []}, {**document, "records": {}}):
        path.write_text(json.dumps(broken))
        with pytest.raises(Exception, match="selection.manifest"):
            inputs.manifest_records(inputs.read_document(spark, str(path))).collect()


def test_quantiles_match_nearest_rank(spark):
    rng = random.Random(11)
    for n in (0, 1, 2, 3, 7, 100, 1500):
        values = [rng.choice([rng.random() * 1e6, 5.0, float(rng.randint(0, 9))]) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
        found = rows(stages.numeric_distribution(df, {"m": F.col("v")}))[0]
        assert found["count"] == n
        ordered = sorted(values)
        for p in (0.25, 0.5, 0.75, 0.9):
            expected = ordered[max(0, math.ceil(p * n) - 1)] if n else None
            assert found[f"p{int(p * 100)}"] == expected, (n, p)
        timed = df.select(F.lit("COMPLETED").alias("status"), F.col("v").alias("elapsed_seconds"))
        median = rows(stages.runtime_mean_median(timed))[0]["median_seconds"]
        middle = None if not n else (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
        assert median == pytest.approx(middle) if n else median is None


def test_digest_ignores_order_and_sees_changes(spark):
    data = [(f"f{i}", f"h{i % 50}") for i in range(2000)] + [("hot", "same")] * 1000 + [("hot", f"h{i}") for i in range(1000)]
    digest = lambda d: rows(summary.batch_digest(spark.createDataFrame(d, "name string, h string"), "name", "h"))[0]
    first = digest(data)
    random.Random(1).shuffle(data)
    assert digest(data) == first and first["record_count"] == 4000
    assert digest(data[1:])["digest"] != first["digest"]


def test_stage_gate(spark):
    schema = "status string, cuda_oom boolean, peak_reserved_bytes long, elapsed_seconds double, availability_status string"
    base = spark.createDataFrame([("COMPLETED", False, 100, 200.0, None)] * 40, schema)
    forced = spark.createDataFrame([("COMPLETED", False, 120, 100.0, "AVAILABLE")] * 99 + [("FAILED", False, None, None, "AVAILABLE")], schema)
    gate = rows(summary.stage_gate(base, forced, 10**9, 80))[0]
    assert gate["extend"] and gate["forced_failure_share"] == pytest.approx(0.01)
    assert gate["projected_hours"] == pytest.approx((40 * 200 + 99 * 100) / 40 * 80 / 3600)
    assert not rows(summary.stage_gate(base, forced, 200, 80))[0]["memory_headroom"]
    assert not rows(summary.stage_gate(base, forced, 10**9, 80, setup_failures=1))[0]["extend"]

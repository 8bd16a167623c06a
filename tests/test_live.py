"""Exact replay of a stream: any arrival order, restarts, few emitted rows, compaction."""

import itertools
import json
import os

import pytest

from tests.conftest import rows
from trailmark.operators import ledger
from trailmark.sinks import writers
from trailmark.sources import inputs
from trailmark.streaming import live

KINDS = {"S": "INTENT_STARTED", "C": "BASE_COMPLETED", "F": "BASE_FAILED", "I": "INTERRUPTED_UNKNOWN", "N": "NOTE"}
SCHEMA = "seq long, intent_id string, event_type string"


def land(folder, number, events):
    """One file, in place at once; its time orders it among the others."""
    folder.mkdir(exist_ok=True)
    text = "".join(json.dumps({"seq": s, "intent_id": i, "event_type": KINDS[k]}) + "\n" for s, i, k in events)
    (folder / f"{number}.json").write_text(text)
    os.utime(folder / f"{number}.json", (1_700_000_000 + number, 1_700_000_000 + number))


def run(spark, folder, path):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    live.run_available(live.stream_intent_histories(stream), path, "update")


def batch(spark, folder):
    return rows(ledger.intent_states(spark.read.schema(SCHEMA).json(str(folder))), "intent_id")


@pytest.mark.parametrize("order", [1, -1])
def test_every_short_history_in_both_orders(spark, tmp_path, order):
    histories = ["".join(h) for n in range(1, 5) for h in itertools.product("SCF", repeat=n)]
    by_place = [[(place + 1, h, h[place]) for h in histories if place < len(h)] for place in range(4)]
    for number, events in enumerate(by_place[::order]):
        land(tmp_path / "in", number, events)
    path = str(tmp_path / "out")
    run(spark, tmp_path / "in", path)
    assert rows(live.latest_updates(spark, path, "intent_id"), "intent_id") == batch(spark, tmp_path / "in")


def test_restart_emits_changes_only_and_compacts(spark, tmp_path):
    folder, path = tmp_path / "in", str(tmp_path / "out")
    big = 2**60 + 1  # beyond what a double can tell apart
    land(folder, 0, [(1, "a", "S"), (big, "b", "C"), (3, "c", "S"), (9, "c", "N"), (None, None, "S"), (None, "d", "S")])
    land(folder, 1, [(2, "a", "N"), (big - 1, "b", "S")])
    run(spark, folder, path)
    emitted = lambda: sorted((r["batch"], r["intent_id"]) for r in rows(spark.read.parquet(f"{path}/rows")))
    assert emitted() == [(0, "a"), (0, "b"), (0, "c"), (0, "d"), (1, "b")]
    assert rows(live.latest_updates(spark, path, "intent_id"), "intent_id") == batch(spark, folder)
    live.compact_updates(spark, path, "intent_id")
    live.compact_updates(spark, path, "intent_id")
    land(folder, 2, [(5, "a", "C"), (6, "c", "F"), (7, "c", "C"), (8, "c", "C"), (None, "d", "F")])
    run(spark, folder, path)
    run(spark, folder, path)
    assert [e for e in emitted() if e[0] > 1] == [(2, "a"), (2, "c"), (2, "d")]
    found = rows(live.latest_updates(spark, path, "intent_id"), "intent_id")
    assert found == batch(spark, folder)
    assert {r["intent_id"]: r["violation"] or r["state"] for r in found} == {
        "a": "COMPLETED", "b": "COMPLETED", "c": "DUPLICATE_TERMINAL", "d": "FAILED"}
    (tmp_path / "out" / "compacted" / "upto-2").mkdir()  # an unfinished table is not read
    assert rows(live.latest_updates(spark, path, "intent_id"), "intent_id") == found
    live.compact_updates(spark, path, "intent_id")
    assert rows(live.latest_updates(spark, path, "intent_id"), "intent_id") == found


def test_interrupted_intents_can_be_appended(spark, tmp_path):
    events = spark.createDataFrame([(4, "a", KINDS["S"]), (5, "b", KINDS["S"]), (6, "b", KINDS["C"]), (None, "c", KINDS["S"])], SCHEMA)
    due = ledger.interrupted_intents(events)
    assert sorted(r["seq"] for r in rows(due)) == [7, 8]
    path = str(tmp_path / "ledger")
    writers.append_ledger(due, path)
    written = inputs.read_ledger(spark, path)
    assert {(r["intent_id"], r["event_type"]) for r in rows(written.select("intent_id", "event_type"))} == {
        ("a", "INTERRUPTED_UNKNOWN"), ("c", "INTERRUPTED_UNKNOWN")}
    assert written.selectExpr("variant_get(payload, '$.reason', 'string') r").distinct().head()[0] == ledger.INTERRUPTED_REASON
    assert ledger.interrupted_intents(events.limit(0)).count() == 0

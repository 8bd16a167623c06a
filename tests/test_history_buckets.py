"""Python replays buckets of intents, not single ones."""

import pandas as pd
from pyspark.sql import functions as F

from tests.conftest import rows
from trailmark.operators import ledger
from trailmark.streaming import live


def test_python_is_called_for_buckets_of_intents():
    class State:
        exists, kept = False, None

        def update(self, values):
            self.exists, self.kept = True, values

        @property
        def get(self):
            return self.kept

    frame = lambda events: pd.DataFrame(events, columns=["intent_id", "unplaced", "seq", "code"])
    state = State()
    first = [frame([(f"i{n}", False, n, 0)]) for n in range(5)]
    (found,) = live._replay((0,), iter(first), state)
    assert list(found["intent_id"]) == [f"i{n}" for n in range(5)] and set(found["state"]) == {"STARTED_UNKNOWN"}
    (found,) = live._replay((0,), iter([frame([("i1", False, 9, 1), ("i2", False, 0, 2), ("i3", True, 0, 0)])]), state)
    assert found.set_index("intent_id").astype(object).where(lambda t: t.notna(), None).to_dict("index") == {
        "i1": {"state": "COMPLETED", "violation": None},
        "i2": {"state": None, "violation": "TERMINAL_WITHOUT_START"},
        "i3": {"state": None, "violation": "DUPLICATE_START"},
    }
    assert not list(live._replay((0,), iter([frame([("i2", False, 1, 2)])]), state))


def test_few_buckets_give_the_same_histories(spark, tmp_path):
    events = spark.range(3000).select(
        F.when(F.col("id") % 7 != 0, F.col("id") * 31 % 997).alias("seq"), F.concat(F.lit("i"), (F.col("id") % 211).cast("string")).alias("intent_id"),
        F.element_at(F.array(*map(F.lit, ("INTENT_STARTED", "NOTE", "BASE_COMPLETED", "BASE_FAILED"))), (F.col("id") * 17 % 13 % 4 + 1).cast("int")).alias("event_type"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.run_available(live.stream_intent_histories(stream, buckets=3), str(tmp_path / "out"), "update")
    assert rows(live.latest_updates(spark, str(tmp_path / "out"), "intent_id"), "intent_id") == rows(ledger.intent_states(events), "intent_id")

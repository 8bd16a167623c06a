"""A JSON text is parsed once, and its check cannot be pruned."""

import pytest

from trailmark.sources import inputs, receipts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_line_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"seq":1,"intent_id":"a","event_type":"INTENT_STARTED"}\n')
    events = inputs.read_ledger(spark, str(tmp_path))
    assert plan_of(events).count("parseJson(") == 1
    assert plan_of(events.select("intent_id")).count("parseJson(") == 1
    assert plan_of(receipts.typed_rollouts(receipts.read_receipts(spark, str(tmp_path)))).count("parseJson(") == 1


def test_the_check_of_a_line_is_never_pruned(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"seq":1}}')
    with pytest.raises(Exception, match="MALFORMED_JSON in a.json"):
        receipts.read_receipts(spark, str(tmp_path)).count()

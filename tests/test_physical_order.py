"""Line numbers over splits and files, and ordinals without a single task."""

import json
import os

import pytest
from pyspark.sql import functions as F

from trailmark.operators import ledger, selection
from trailmark.sources import inputs
from trailmark.sources.documents import numbered_lines


@pytest.fixture
def small_splits(spark):
    """Splits of 300 bytes, several of them packed into a task."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(name) for name in names]
    spark.conf.set(names[0], "300")
    spark.conf.set(names[1], "1")
    yield
    for name, value in zip(names, before):
        spark.conf.set(name, value)


def write(folder, name, lines, age):
    path = folder / name
    path.write_text("".join(f"{line}\n" for line in lines))
    os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))


def event(i, kind="INTENT_STARTED", intent="a"):
    return json.dumps({"event_type": kind, "intent_id": intent, "payload": {"n": i, "pad": "x" * (i * 37 % 90)}})


def test_lines_of_many_splits_and_files(spark, tmp_path, small_splits):
    first, second = ([event(i) for i in range(n)] for n in (150, 70))
    first[20], first[21], second[3] = "", "not json", "[1]"
    write(tmp_path, "z-older.json", first, 0)
    write(tmp_path, "a-newer.json", second, 10)
    lines = numbered_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 4 or lines.select("value").count() == 220
    found = sorted((r.position, r.file_name, r.line_number, r.value) for r in lines.collect())
    wanted = [("z-older.json", i, t) for i, t in enumerate(first, 1)] + [("a-newer.json", i, t) for i, t in enumerate(second, 1)]
    assert found == [(i, *w) for i, w in enumerate(wanted, 1)]

    audit = inputs.read_ledger(spark, str(tmp_path), strict_mode=False, physical_order=True)
    bad = sorted((r.seq, r.file_name, r.line_number, r.problem) for r in audit.where("problem is not null").collect())
    assert bad == [(21, "z-older.json", 21, "BLANK_LINE"), (22, "z-older.json", 22, "MALFORMED_JSON"), (154, "a-newer.json", 4, "NOT_AN_OBJECT")]
    with pytest.raises(Exception, match=r"(BLANK_LINE|MALFORMED_JSON) in z-older.json:2[12]|NOT_AN_OBJECT in a-newer.json:4"):
        inputs.read_ledger(spark, str(tmp_path), physical_order=True).collect()


def test_replay_by_physical_order(spark, tmp_path, small_splits):
    """A terminal event before its start is a violation where lines are numbered; a start after it hides it nowhere."""
    lines = []
    for i in range(40):
        kinds = ["INTENT_STARTED", "BASE_COMPLETED"] if i % 2 else ["BASE_COMPLETED", "INTENT_STARTED"]
        lines += [event(i, kind, f"i{i}") for kind in kinds]
    write(tmp_path, "ledger.jsonl", lines, 0)
    states = ledger.intent_states(inputs.read_ledger(spark, str(tmp_path), physical_order=True))
    found = {r.intent_id: (r.state, r.violation) for r in states.collect()}
    assert all(found[f"i{i}"] == (("COMPLETED", None) if i % 2 else (None, "TERMINAL_WITHOUT_START")) for i in range(40))


def test_no_ledger_and_empty_files(spark, tmp_path):
    assert inputs.read_ledger(spark, str(tmp_path / "none"), physical_order=True).count() == 0
    write(tmp_path, "empty.json", [], 0)
    assert numbered_lines(spark, str(tmp_path)).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def problems(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("p-"), "id").alias("problem_id"), F.col("id").alias("source_index"), F.lit("text").alias("problem"),
        F.col("id").cast("string").alias("reference_answer"), F.lit(1).alias("level"), F.lit("s").alias("subject"),
    )


@pytest.mark.parametrize("size", [1, 17, 4096, 9999, 10000])
def test_ordinals_equal_a_sort(spark, size):
    rows = problems(spark, 10_000).repartition(7)
    manifest = selection.selection_manifest(rows, 11, size)
    found = [(r.manifest_ordinal, r.problem_id) for r in manifest.orderBy("manifest_ordinal").collect()]
    ranked = selection.selection_rank(rows, 11).orderBy("selection_rank", "source_index").limit(size).collect()
    assert found == [(i, r.problem_id) for i, r in enumerate(ranked, 1)]


def test_ordinal_windows_are_partitioned(spark):
    manifest = selection.selection_manifest(problems(spark, 10_000), 11, 5_000)
    plan = plan_of(manifest)
    assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan
    unpartitioned = [line for line in plan.splitlines() if "Window [" in line and "_rows" not in line and "row_number" in line and "[_range" not in line]
    assert unpartitioned == []


def test_too_few_problems_and_repeated_ranks(spark):
    for rows in (problems(spark, 5), problems(spark, 0)):
        with pytest.raises(Exception, match="6 problems asked for, available: [05]"):
            selection.selection_manifest(rows, 11, 6).collect()
    twice = spark.createDataFrame([("aa", 1), ("aa", 1), ("ab", 0), (None, 3)], "selection_rank string, source_index long")
    found = sorted((r.manifest_ordinal, r.selection_rank) for r in selection.manifest_ordinal(twice).collect())
    assert found == [(1, None), (2, "aa"), (3, "aa"), (4, "ab")]

"""The whole report: no sorts in its big joins, one shuffle of the facts for both views."""

from pyspark.sql import functions as F

from tests.conftest import rows
from trailmark.operators import accounting, transitions
from trailmark.operators.exact import totals_with
from trailmark.operators.skew import salted_left_join
from trailmark.plans import analysis

POSITIONS = (256, 512)
FACTS = "problem_id string, checkpoint_token long, primary_label string, observed_label string"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_accounting_and_parent_join_hash_their_unique_side(spark):
    seen = spark.createDataFrame(
        [("a", 256, "COMPLETED", "AVAILABLE"), ("a", 256, "FAILED", "AVAILABLE"), ("a", 256, "FAILED", None), ("a", 512, None, "AVAILABLE"),
         ("a", 300, "COMPLETED", "AVAILABLE"), ("x", 256, "COMPLETED", "AVAILABLE"), ("x", 256, "COMPLETED", "AVAILABLE"),
         (None, 256, "COMPLETED", "AVAILABLE"), ("b", None, "COMPLETED", "AVAILABLE")],
        "parent_rollout_id string, checkpoint_token long, status string, availability_status string")
    planned = spark.createDataFrame([("a",), ("a",), ("b",)], "rollout_id string")
    found = accounting.checkpoint_accounting(seen, planned, POSITIONS)
    assert {(r["scope"], r["metric"]): r["n"] for r in rows(found)} == {
        ("all", "expected"): 4, ("all", "recorded"): 9, ("all", "recorded_unique_expected"): 2, ("all", "missing"): 2,
        ("all", "unexpected"): 3, ("all", "duplicate_logical"): 3, ("all", "malformed_identity"): 2,
        ("256", "expected_receipts"): 2, ("256", "recorded_receipts"): 3, ("256", "recorded_unique_expected_receipts"): 1,
        ("256", "missing_expected_receipts"): 1, ("256", "receipt_status:COMPLETED"): 1, ("256", "receipt_status:FAILED"): 2,
        ("256", "availability_status:AVAILABLE"): 2, ("256", "availability_status:UNKNOWN"): 1,
        ("512", "expected_receipts"): 2, ("512", "recorded_receipts"): 1, ("512", "recorded_unique_expected_receipts"): 1,
        ("512", "missing_expected_receipts"): 1, ("512", "receipt_status:UNKNOWN"): 1, ("512", "availability_status:AVAILABLE"): 1}
    joined = salted_left_join(seen, planned.distinct(), "parent_rollout_id", "rollout_id", ["status"])
    for df in (found, joined):
        plan = plan_of(df)
        assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Window" not in plan


def test_groups_of_both_views_give_the_sections_of_the_cubes(spark):
    labels = ("W_TO_C", "W_TO_W", "C_TO_C", "C_TO_W", None)
    facts = spark.createDataFrame(
        [(f"p{i % 7}", POSITIONS[i % 2], labels[i % 5], labels[i % 3 if i % 4 else i % 5]) for i in range(120)] + [(None, 256, None, None)], FACTS)
    groups = transitions.transition_groups(facts)
    assert plan_of(groups).count("Exchange hashpartitioning") == 1
    for view, plain in (("primary", transitions.primary_transitions(facts)), ("observed", transitions.observed_transitions(facts))):
        seen = transitions.groups_of_view(groups, view)
        cube = transitions.cube_of_groups(seen)
        same = lambda a, b: sorted(map(str, rows(a.select(*b.columns)))) == sorted(map(str, rows(b)))
        assert same(cube, transitions.transition_cube(plain))
        assert same(transitions.transition_rates_by_checkpoint(seen, POSITIONS), transitions.transition_rates_by_checkpoint(plain, POSITIONS))
        assert same(transitions.matched_contrasts(seen, POSITIONS), transitions.matched_contrasts(plain, POSITIONS))
        assert same(transitions.event_concentration(cube, POSITIONS), transitions.event_concentration(plain, POSITIONS))
        assert same(transitions.concentration_positions(cube), transitions.concentration_positions(plain))


def test_report_lands_the_facts_that_sections_use(spark, monkeypatch):
    landed = {}
    monkeypatch.setattr(analysis, "materialise", lambda df, name: landed.setdefault(name, df))
    shared = """problem_id string, status string, generation_recorded boolean, generated_token_count long, elapsed_seconds double,
        termination_status string, peak_allocated_bytes long, peak_reserved_bytes long, error_type string, cuda_oom boolean,
        eligible boolean, eligibility_status string, reason_codes array<string>"""
    rollouts = spark.createDataFrame([], f"{shared}, rollout_id string, final_status string, final_correct boolean")
    checkpoints = spark.createDataFrame([], f"""{shared}, parent_rollout_id string, checkpoint_token long, availability_status string,
        forced_status string, forced_correct boolean, final_ref_status string, final_ref_correct boolean, transition_label string,
        observed_transition_label string""")
    analysis.analysis_sections(rollouts, checkpoints, rollouts.select("rollout_id"), POSITIONS)
    assert list(landed) == ["facts", "groups"] and landed["facts"].columns == list(analysis.FACTS)


def test_totals_are_summed_as_integers(spark):
    values = [1e16, 1.0, -1e16, 3e-12, 0.1, 0.1, -0.3, 5e-324, -5e-324, 0.0, -2.5, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = totals_with(df, "v", {"total": F.lit(True), "negative": F.col("v") < 0, "none": F.lit(False)}, [F.count("*").alias("n")])
    from fractions import Fraction

    exact = lambda some: float(sum((Fraction(v) for v in some), Fraction(0)))
    known = [v for v in values if v is not None]
    assert rows(found) == [{"n": 12, "total": exact(known), "negative": exact(v for v in known if v < 0), "none": None}]
    scan = plan_of(found)
    assert "decimal" not in scan[scan.rindex("HashAggregate"):].lower()

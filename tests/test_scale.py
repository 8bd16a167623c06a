"""Plan shapes and skew: hot keys, copies, pushdown, bounded windows."""

from pyspark.sql import functions as F

from suite.views import Fixtures
from trailmark.functions.receipts import is_completed
from trailmark.operators import ledger, selection, stages, summary, transitions
from trailmark.operators.skew import hot_keys, salted_left_join
from trailmark.sinks import writers

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_parent_is_spread_and_nothing_is_lost(spark):
    n = 30000
    ids = spark.range(n)
    parent = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit("r"), "id"))
    left = ids.select("id", parent.alias("k"))
    right = ids.select(F.concat(F.lit("r"), "id").alias("rk"), F.col("id").alias("v")).unionByName(
        spark.range(1).select(F.lit("hot").alias("rk"), F.lit(-1).cast("long").alias("v")))
    assert left.select(hot_keys(left, "k").alias("h")).head()["h"] in (["hot"], ["hot", None], [None, "hot"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = salted_left_join(left, right, "k", "rk", ["id"])
        sizes = [r["n"] for r in joined.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == n and max(sizes) < n / 4
        assert joined.where("k = 'hot' AND v = -1").count() == n / 3
        assert joined.where("k IS NULL AND v IS NULL").count() == n / 3
        assert joined.where("k LIKE 'r%' AND v = id").count() == n / 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_identical_copies_of_a_hot_key_are_split_by_the_runtime_planner(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rollouts = spark.range(20000).select(
            F.concat(F.lit("r"), "id").alias("rollout_id"), F.lit("CORRECT").alias("final_status"), F.lit(True).alias("final_correct"),
            F.lit(True).alias("eligible"), F.lit("X").alias("eligibility_status"), F.array(F.lit("a")).alias("reason_codes"))
        copies = spark.range(0, 60000, 1, 8).select(
            F.when(F.col("id") % 2 == 0, "r7").otherwise(F.concat(F.lit("r"), F.col("id") % 20000)).alias("parent_rollout_id"),
            F.when(F.col("id") % 2 == 0, "p").otherwise(F.col("id").cast("string")).alias("problem_id"),
            F.lit(256).cast("bigint").alias("checkpoint_token"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
        joined = transitions.checkpoint_parent_join(copies, rollouts)
        # Every even id, and the odd ids 7, 20007 and 40007.
        assert joined.where("parent_rollout_id = 'r7' AND parent_found").count() == 30003
        result = joined.select("payload", "parent_verdict")
        result.collect()
        assert "skew=true" in plan_of(result)
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    fx = Fixtures(spark, SF)
    path = str(tmp_path / "rollouts")
    fx.rollouts.write.parquet(path)
    landed = spark.read.parquet(path)
    plan = plan_of(stages.length_distribution(landed))
    assert "PushedFilters: [EqualNullSafe(status,COMPLETED)]" in plan
    assert "ReadSchema: struct<status:string,generated_token_count:bigint>" in plan
    rates_input = plan_of(transitions.unique_base_index(landed).select("base_id", "parent_verdict", "parent_eligible"))
    assert "SortAggregate" not in rates_input and "eligibility_status" not in rates_input
    assert "PushedFilters" in plan_of(landed.where(is_completed()))


def test_first_events_are_limited_before_the_shuffle(spark):
    events = Fixtures(spark, SF).view("fx_ledger")
    plan = plan_of(ledger.intent_states(events))
    before_exchange = plan[plan.rindex("Exchange hashpartitioning(intent_id"):]
    assert "WindowGroupLimit" in before_exchange
    assert plan.count("Exchange hashpartitioning") == 1


def test_selection_is_a_top_k_without_a_full_sort(spark):
    problems = Fixtures(spark, SF).view("fx_problems")
    assert "TakeOrderedAndProject" in plan_of(selection.selection_manifest(problems, 1, 10))


def test_no_cross_joins_in_reports(spark):
    fx = Fixtures(spark, SF)
    facts = transitions.transition_facts(fx.checkpoints, fx.rollouts, (256, 512))
    for df in (
        transitions.transition_rates_by_checkpoint(transitions.primary_transitions(facts), (256, 512)),
        transitions.matched_contrasts(transitions.primary_transitions(facts), (256, 512)),
        transitions.event_concentration(transitions.primary_transitions(facts), (256, 512)),
        summary.operational_summary(fx.rollouts, fx.checkpoints),
        stages.generation_distributions(fx.checkpoints),
    ):
        plan = plan_of(df)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_an_append_reads_ids_and_hashes_of_its_own_folders_only(spark, tmp_path):
    path = str(tmp_path / "store")
    records = spark.range(5000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    writers.append_once(records, path, "id")
    assert 1 < spark.read.parquet(path).select(writers.BUCKET).distinct().count() <= writers.BUCKETS
    wanted = records.where("id < 3")
    buckets = [r["b"] for r in wanted.select(writers.bucket_of("id").alias("b")).distinct().collect()]
    stored = writers.stored_versions(spark, path, records, "id", buckets)
    plan = plan_of(stored)
    assert "PartitionFilters: [(_bucket" in plan and f"ReadSchema: struct<id:bigint,{writers.CONTENT_HASH}:string>" in plan
    read = {f for f, in stored.select(F.input_file_name()).distinct().collect()}
    assert len(read) <= len(buckets) and {int(f.split("_bucket=")[1].split("/")[0]) for f in read} == set(buckets)
    writers.append_once(records.where("id >= 4990").unionByName(spark.range(5000, 5010).select("id", F.lit("new").alias("payload"))), path, "id")
    assert writers.read_store(spark, path).count() == 5010

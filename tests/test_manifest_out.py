"""Manifest documents, scope and identity, the run summary's inputs, and artifacts on disk."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from trailmark.operators import manifest_out, selection
from trailmark.params import ManifestHeader, RunContext
from trailmark.plans.analysis import report_rows
from trailmark.plans.run_summary import receipts_digest, run_summary_sections
from trailmark.sinks import writers
from trailmark.sources import inputs
from suite.views import Fixtures

HEADER = ManifestHeader("protocol", "c" * 64, "data", "train", "rev", "hash-rank", 7)
SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_digest(texts, fan_out):
    nodes = [sha(t) for t in texts]
    for _ in range(manifest_out.LEVELS):
        nodes = [sha("".join(nodes[i : i + fan_out])) for i in range(0, len(nodes), fan_out)]
    return sha("".join(nodes))


def problems(spark, n):
    found = [(f"p{i}", i, f"text {i}", str(i), None, "algebra") for i in range(n)]
    return spark.createDataFrame(found, "problem_id string, source_index bigint, problem string, reference_answer string, level string, subject string")


@pytest.mark.parametrize("n,fan_out", [(0, 4), (1, 4), (4, 4), (5, 4), (300, 4), (300, 1024)])
def test_ordered_digest(spark, n, fan_out):
    texts = [f"text {i % 7}" for i in range(n)]
    table = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "place bigint, text string")
    for parts in (1, 5):
        found = rows(manifest_out.ordered_digest(table.repartition(parts), "place", F.col("text"), fan_out))
        assert found == [{"digest": plain_digest(texts, fan_out), "row_count": n}]


def test_order_null_and_repeated_places(spark):
    digest = lambda data: rows(manifest_out.ordered_digest(spark.createDataFrame(data, "place bigint, text string"), "place", F.col("text")))
    assert digest([(1, "a"), (2, "b")]) != digest([(1, "b"), (2, "a")])
    assert digest([(1, None)]) == digest([(1, "")])
    assert digest([(1, "a"), (1, "b")]) == digest([(1, "b"), (1, "a")])


def test_header_is_canonical_json(spark):
    manifest = selection.selection_manifest(problems(spark, 40), 7, 25)
    found = manifest_out.manifest_header(manifest, HEADER).head()
    header = json.loads(found["header"])
    assert found["header"] == json.dumps(header, sort_keys=True, separators=(",", ":"))
    assert header["selection_size"] == 25 and header["dataset"]["requested_revision"] is None
    records = [r.asDict() for r in manifest.orderBy("manifest_ordinal").drop("manifest_ordinal").collect()]
    texts = [json.dumps(r, sort_keys=True, separators=(",", ":")) for r in records]
    assert header["records_digest"] == plain_digest(texts, 1024)
    assert found["manifest_hash"] == sha(found["header"])


def test_identity_follows_scope_only(spark):
    manifest = selection.selection_manifest(problems(spark, 40), 7, 25)
    identity = lambda m, h=HEADER, s=(1, 2), p=(8, 16): rows(manifest_out.campaign_identity(m, h, s, p))[0]
    first = identity(manifest)
    assert first == identity(manifest.repartition(7))
    assert first["manifest_hash"] == manifest_out.manifest_header(manifest, HEADER).head()["manifest_hash"]
    others = [identity(manifest, s=(2, 1)), identity(manifest, p=(8,)), identity(selection.selection_manifest(problems(spark, 40), 7, 24))]
    assert len({first["run_id"], *(o["run_id"] for o in others)}) == 4
    with pytest.raises(ValueError, match="seeds and positions"):
        manifest_out.campaign_identity(manifest, HEADER, (), (8,))
    with pytest.raises(ValueError, match="resolved revision"):
        ManifestHeader("protocol", "c", "data", "train", "", "hash-rank", 7)


def test_manifest_is_written_once(spark, tmp_path):
    manifest = selection.selection_manifest(problems(spark, 40), 7, 25)
    path = str(tmp_path / "manifest")
    digest = writers.write_manifest(manifest, HEADER, path)
    before = {f: os.stat(f"{path}/records/{f}").st_mtime_ns for f in os.listdir(f"{path}/records")}
    assert writers.write_manifest(manifest, HEADER, path) == digest
    assert before == {f: os.stat(f"{path}/records/{f}").st_mtime_ns for f in os.listdir(f"{path}/records")}
    with pytest.raises(writers.ConflictError):
        writers.write_manifest(selection.selection_manifest(problems(spark, 40), 7, 24), HEADER, path)
    document, records = inputs.read_manifest(spark, path)
    assert rows(records, "problem_id") == rows(manifest, "problem_id")
    check = lambda r, **wanted: {v["field"] for v in rows(inputs.manifest_header_violations(document, wanted, r))}
    assert check(records, config_hash="c" * 64) == set()
    assert check(records.limit(24), config_hash="d") == {"config_hash", "selection_size"}


def test_interrupted_manifest_is_written_anew(spark, tmp_path):
    path = str(tmp_path / "manifest")
    problems(spark, 3).write.json(f"{path}/records")  # no header: never finished
    manifest = selection.selection_manifest(problems(spark, 40), 7, 25)
    writers.write_manifest(manifest, HEADER, path)
    assert inputs.read_manifest(spark, path)[1].count() == 25


def test_finished_report_is_never_replaced(spark, tmp_path):
    report = lambda value: spark.createDataFrame([("s", "k", "n", value)], "section string, key string, metric string, value string")
    path = writers.write_summary(report("1"), str(tmp_path))
    report("2").write.mode("overwrite").parquet(path)
    with pytest.raises(writers.ConflictError):
        writers.write_summary(report("1"), str(tmp_path))
    assert spark.read.parquet(path).head()["value"] == "2"
    os.remove(f"{path}/_SUCCESS")  # as an interrupted write leaves it
    assert writers.write_summary(report("1"), str(tmp_path)) == path
    assert spark.read.parquet(path).head()["value"] == "1"


def test_disk_usage_counts_hidden_files(spark, tmp_path):
    (tmp_path / "a" / "_b").mkdir(parents=True)
    for name, size in (("x", 10), ("_y", 20), (".z", 30), ("a/_b/deep", 40), ("empty", 0)):
        (tmp_path / name).write_bytes(b"x" * size)
    assert rows(inputs.artifact_disk_usage(spark, str(tmp_path))) == [{"bytes": 100, "files": 5}]
    assert rows(inputs.artifact_disk_usage(spark, str(tmp_path / "missing"))) == [{"bytes": 0, "files": 0}]


def test_digest_covers_every_column(spark):
    receipts = spark.createDataFrame([("r1", "A", 1.5, None), ("r2", None, None, True)], "id string, status string, s double, ok boolean")
    first = rows(receipts_digest(receipts, "id"))
    assert first == rows(receipts_digest(receipts.repartition(3).select("ok", "s", "status", "id"), "id"))
    for column, value in (("status", "B"), ("s", 2.5), ("ok", False)):
        assert rows(receipts_digest(receipts.withColumn(column, F.lit(value)), "id")) != first
    assert rows(receipts_digest(receipts.union(receipts.limit(1)), "id")) != first
    assert rows(receipts_digest(receipts.limit(0), "id"))[0]["record_count"] == 0


def test_summary_of_nothing(spark):
    fx = Fixtures(spark, SF)
    run = RunContext("run", "m", "c", "d" * 64)
    planned = fx.rollouts.select("problem_id", "rollout_id")
    usage = spark.createDataFrame([(5, 1)], "bytes bigint, files bigint")
    sections = run_summary_sections(fx.rollouts.limit(0), fx.checkpoints.limit(0), planned, (256, 512), run, usage)
    found = {(r["section"], r["key"], r["metric"]): r["value"] for r in rows(report_rows(sections))}
    assert found["totals", "", "problems_attempted"] == "0" and found["totals", "", "mean_seconds"] is None
    assert found["totals", "", "problems_planned"] == str(planned.select("problem_id").distinct().count())
    assert found["totals", "", "trajectories_planned"] == str(planned.select("rollout_id").distinct().count())
    assert found["checkpoint_counts_by_position", "256", "n"] == "0"
    assert found["artifact_disk_usage", "", "bytes"] == "5" and found["run", "", "run_id"] == "run"

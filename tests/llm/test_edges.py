"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailmark.llm import (
    dart_minhash, decontamination, disclosure, language_id, mixture, secret_scan, text_blocks, token_store, top_k, toxicity,
)
from trailmark.llm.shared import scratch_path

SF = "/root/testdata/sf0.001"
LONG = "word other third " * 40_000
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, key int, id string, row array<int>, bands map<string,int>, "
    "score double, rank int, tokens string, leaf string, __key int"
)


def full(*rows):
    return [(*r, 7, "x", [1], {"a": 1}, 0.5, 1, "t", "l", 1) for r in rows]


ROWS = full(
    (None, None, None, None, None), (1, None, "en", "src1", 0), (2, "", "en", None, 0), (3, "   ", None, "src2", 3), (4, "12 34 !", "en", "nowhere", 7),
    (5, "the same five words here and more of them", "en", "src1", 1), (5, "the same five words here and more of them", "en", "src1", 1),
    (6, "the same five words here and more of them", "xx", "src1", 1), (7, LONG, "en", "src12", len(LONG)), (None, "a text without id", "en", "src1", 2),
    (5, "another text with a repeated id", "de", "src3", 2), (8, "퟿🙂 é", "fr", "src4", 4),
)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def bench(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id bigint, text string")


def test_dedup(odd, nothing):
    found = dart_minhash.near_duplicate_classes(odd).collect()
    assert len(found) == len(ROWS)
    by_size = sorted((r.doc_id or 0, r.class_id or 0, r.class_size) for r in found)
    assert by_size.count((5, 5, 3)) == 2 and (6, 5, 3) in by_size  # the same text under three rows
    assert (1, 1, 3) in by_size and (2, 1, 3) in by_size  # null and empty texts are alike
    kept = dart_minhash.keep_one(odd)
    assert kept.schema == odd.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "3", "4", "5", "7", "None", "5", "8"])
    assert dart_minhash.keep_one(nothing).count() == 0 == dart_minhash.near_duplicate_classes(nothing).count()


def test_pages(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "<p>" * 50_000 + "deep " * 30, 3)], "page_id bigint, url string, html string, text int")
    found = sorted(text_blocks.extract(pages).collect(), key=lambda r: r.n_chars)
    assert [r.text for r in found] == ["", "", ("deep " * 30).strip()]
    assert text_blocks.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("report", [disclosure.span_report, secret_scan.secret_report])
def test_spans(odd, nothing, report):
    found = report(odd).collect()
    assert len(found) == len(ROWS) and all(r.spans == "" for r in found)
    assert report(nothing).count() == 0


def test_tokens(spark, odd, nothing):
    folder = scratch_path(spark, "odd_tokens")
    files = token_store.write_tokens(odd, folder, block=50)
    found = sorted(token_store.read_tokens(files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, None, 1, 2, 3, 4, 5, 5, 5, 6, 7, 8]  # whole documents, nulls first
    assert files.count() > 1 and files.agg(F.sum("n_tokens")).first()[0] == sum(r.n_tokens for r in found)
    start = 0
    for r in found:
        assert r.start == start and len(r.ids) == r.n_tokens and r.ids[-1] == 1
        start += r.n_tokens
    assert found[2].ids == [1]
    assert token_store.token_digests(token_store.write_tokens(nothing, scratch_path(spark, "no_tokens"))).count() == 0


def test_mixture(odd, nothing):
    found = mixture.mixed(odd)
    assert found.schema == odd.schema
    rows = found.collect()
    assert sum(r.doc_id == 7 for r in rows) >= 1  # the only text of its leaf
    assert mixture.mixed(nothing).count() == 0


def test_equal_rows_at_the_cut(spark):
    """A third of a leaf is one row repeated; the budget still ends on a single row."""
    rows = [(1, "one two three four", "en", "src1")] * 50 + [(i, "a b c d", "en", "src1") for i in range(2, 102)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for budget in (0.1, 0.37, 0.5, 0.81, 1.0, 1.35):
        mix = mixture.Mix(domains={"d": {"src1": 1.0}}, languages={"en": 1.0}, budget=budget)
        assert mixture.mixed(docs, mix).count() == math.ceil(int(budget * 600) / 4)


def test_language(odd, nothing):
    model = language_id.fit(odd)
    found = {(r.doc_id, r.lang_pred, r.rejected) for r in language_id.predict(odd, model).collect()}
    assert {(1, "und", True), (2, "und", True), (3, "und", True), (4, "und", True)} <= found
    assert all(lang in model.languages + ["und"] for _, lang, _ in found)
    assert language_id.accepted(odd, model).schema == odd.schema
    unlearned = language_id.fit(nothing)
    assert language_id.accepted(odd, unlearned).count() == 0 and language_id.predict(nothing, model).count() == 0


def test_toxicity(spark, odd, nothing):
    labels = spark.createDataFrame([(5, 0, 1), (6, 0, None), (7, 1, 0), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(toxicity.train_part(odd, labels, 4, 9))
    found = toxicity.toxic_scores(odd, model).collect()
    assert len(found) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert toxicity.toxic_scores(nothing, model).count() == 0
    assert {r.score for r in toxicity.toxic_scores(odd, toxicity.fit(toxicity.train_part(nothing, labels))).collect()} == {0.0}


def test_decontamination(spark, odd):
    items = bench(spark, (1, None), (2, ""), (None, "the same five words here and more of them"), (3, "the same five words here and more of them"), (4, "short"))
    found = decontamination.contaminated(odd, items).collect()
    assert sorted(((r.doc_id, r.item_id or 0, r.edits) for r in found)) == [(5, 0, 0), (5, 0, 0), (5, 3, 0), (5, 3, 0), (6, 0, 0), (6, 3, 0)]
    kept = decontamination.clean(odd, items)
    assert kept.schema == odd.schema and kept.count() == len(ROWS) - 3
    assert decontamination.contaminated(odd, bench(spark, (1, None)).limit(0)).count() == 0
    assert decontamination.clean(odd, bench(spark, (1, None)).limit(0)).count() == len(ROWS)


def test_blocks_of_items(spark, odd, monkeypatch):
    items = bench(spark, *[(i, f"number {i} of the items that nobody has seen yet") for i in range(40)], (99, "another text with a repeated id"))
    whole = decontamination.contaminated(odd, items).collect()
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 300)
    assert decontamination.contaminated(odd, items).collect() == whole and [r.item_id for r in whole] == [99]


def test_neighbours(spark):
    rows = [(0, [1.0, None]), (100, None), (200, [1.0, float("nan")]), (300, [float("inf"), 0.0]), (None, [1.0, 1.0]), (400, [0.5, 0.5]), (1, [1.0, 2.0]), (500, [3.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert sorted(map(tuple, top_k.top_k(table, F.col("vec_id") % 100 == 0).collect())) == [(400, 1, 1, 1536 * 1024)]
    assert top_k.top_k(table.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_stages_keep_the_columns(spark, tmp_path):
    folder = str(tmp_path)
    table = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{table}/documents.parquet").withColumn("score", F.lit(1)).withColumn("id", F.col("doc_id"))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, table)
        assert found.columns == docs.columns, name
        found.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    assert 0 < docs.distinct().count() <= before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, table).count() == docs.count()
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, table).count() == 0


def test_held_out_accuracy(spark):
    """Languages and toxicity on rows that were not learned from."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = language_id.fit(language_id.train_part(docs, 5))
    found = language_id.predict(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0), model).join(docs.select("doc_id", "lang"), "doc_id")
    right, rejected, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int")), F.count("*")).first()
    assert n > 1500 and right >= 0.98 and rejected <= 0.01
    scores = toxicity.toxic_scores(docs, toxicity.fit(toxicity.train_part(docs, labels))).join(labels, "doc_id")
    held = scores.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2).collect()
    toxic, clean = [r.score for r in held if r.toxic], [r.score for r in held if not r.toxic]
    assert sum(a > b for a in toxic for b in clean) / (len(toxic) * len(clean)) >= 0.95


def test_sample_does_not_follow_partitions(spark):
    """The same rows after a reshuffle, within both bounds; copies count once."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")
    rows = rows.unionAll(rows)
    first = {tuple(r) for r in language_id.sample_rows(rows, 50, "text")}
    again = language_id.sample_rows(rows.repartition(13), 50, "text")
    assert {tuple(r) for r in again} == first and len(again) == len(first) == 50
    fewer = language_id.sample_rows(rows.repartition(3), 50, "text", chars=20_000)
    assert {tuple(r) for r in fewer} < first and sum(len(r.text) for r in fewer) <= 20_000
    assert language_id.sample_rows(rows.limit(0), 50, "text") == []


def test_toxic_sample_comes_from_the_labels(spark):
    """At most the bound of labelled ids, and no exchange of the texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    part = toxicity.train_part(docs, labels, bound=20)
    assert 0 < part.count() <= 20
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_numerals_are_no_letters(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs, 60)
    odd = spark.createDataFrame([(1, "½ ² ³ ①"), (2, "12 ٣"), (3, "x² is a letter")], "doc_id long, text string")
    found = {r.doc_id: r.lang_pred for r in language_id.predict(odd, model).collect()}
    assert found[1] == found[2] == "und" and found[3] != "und"


def test_long_runs_of_zeros_in_an_address():
    text = "a 10.0.0." + "0" * 5000 + " b " + "0" * 5000 + ".1.1.1 c 1.2.3." + "9" * 5000
    assert [(a, b - a) for k, a, b in disclosure.typed_spans(text) if k == "ip"] == [(2, 5007), (5012, 5006)]


def test_token_folder_names(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two."), (2, None)], "doc_id long, text string")
    for name in (f"file:{tmp_path}/a", f"file://{tmp_path}/b", f"{tmp_path}/c"):
        files = token_store.write_tokens(docs, name)
        assert [r.n_tokens for r in token_store.token_digests(files).orderBy("doc_id").collect()] == [4, 1]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b", "c"]

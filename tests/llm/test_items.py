"""Benchmark items of few characters and of the lengths at which a gram of eight allows too few edits."""

import pytest

from trailmark.llm import decontamination


def search(text, *items):
    return next(decontamination._search([text], decontamination.build(list(enumerate(items)))))


@pytest.mark.parametrize("length", range(24, 82))
def test_a_tenth_of_every_length(length):
    item = "".join(chr(97 + (i * i * 7 + i * 3 + i // 5) % 26) for i in range(length))
    allowed = length // 10
    codes = list(item)
    for n in range(allowed):
        codes[(n + 1) * length // (allowed + 1)] = "0"
    found = search("Before, 1 2 3. " + "".join(codes) + " and after", item)
    assert [(i, edits) for i, edits, _, _ in found] == [(0, allowed)]


@pytest.mark.parametrize(
    "text, item, place",
    [
        ("So: Who wrote Hamlet? Nobody knows.", "who wrote hamlet", (4, 20)),
        ("2 + 2 = 4 they say", "2+2=4", (0, 9)),
        ("他问：「光速是多少？」没人答。", "光速是多少", (4, 9)),
        ("我想知道光速是多少的答案", "光速是多少?", (4, 9)),
        ("日本の首都はどこですか。", "首都はどこですか", (3, 11)),
        ("我用GPT模型", "gpt", (2, 5)),
        ("unchanged art", "art", (10, 13)),
    ],
)
def test_short_items(text, item, place):
    assert search(text, item) == [(0, 0, *place)]


@pytest.mark.parametrize("text, item", [("cartwheel", "art"), ("who wrote hamlets", "who wrote hamlet"), ("awho wrote hamlet", "who wrote hamlet"), ("text", "?!"), ("", "a")])
def test_short_items_that_are_not_there(text, item):
    assert search(text, item) == []


def test_queries_find_short_items(spark):
    docs = spark.createDataFrame([(1, "So, who wrote Hamlet?"), (2, "光速是多少"), (3, "nothing here")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "Who wrote Hamlet?"), (8, "光速是多少?"), (9, "whowrote")], "item_id bigint, text string")
    assert sorted((r.doc_id, r.item_id, r.edits) for r in decontamination.contaminated(docs, bench).collect()) == [(1, 7, 0), (2, 8, 0)]
    assert [r.doc_id for r in decontamination.clean(docs, bench).collect()] == [3]


def test_single_words_are_reported_but_remove_nothing(spark):
    docs = spark.createDataFrame([(1, "So the tale ends"), (2, "So who wrote hamlet"), (3, "光速"), (4, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(7, "The"), (8, "Who wrote Hamlet?"), (9, "光速"), (10, "光"), (11, None)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()} == {(1, 7), (2, 8), (3, 9), (3, 10)}
    kept = lambda *more: [r.doc_id for r in decontamination.clean(docs, bench, *more).orderBy("doc_id").collect()]
    assert kept() == [1, 4] and kept(1) == [4]

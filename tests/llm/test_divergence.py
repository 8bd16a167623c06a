"""Source divergence against dense sums in plain integers."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from trailmark.llm import source_divergence as sd

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least=10, top=10):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows, every term of every group in turn."""
    counts, holders, groups = defaultdict(Counter), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"(?:[a-z]|[^\x00-\x7f])+", lower)
        groups.add((lang, source))
        counts[lang, source].update(terms)
        holders.update({(lang, t) for t in terms})
    kept = defaultdict(list)
    for (lang, term), n in holders.items():
        if n >= least:
            kept[lang].append(term)

    def shares(found, lang):
        total = sum(found[t] for t in kept[lang]) + 2 * len(kept[lang])
        return {t: 1 + 10**9 * (found[t] + 2) // total for t in kept[lang]}

    own = {g: shares(counts[g], g[0]) for g in groups}
    langs = {lang: shares(sum((counts[g] for g in groups if g[0] == lang), Counter()), lang) for lang, _ in groups}
    f = lambda p, q: (p - q) ** 2 // (p + q)
    found = []
    for g in groups:
        pairs = [(sum(f(own[g][t], own[h][t]) for t in kept[g[0]]), h[1]) for h in groups if h[0] == g[0] and h != g]
        terms = [(f(own[g][t], langs[g[0]][t]), t) for t in kept[g[0]] if counts[g][t] and own[g][t] > langs[g[0]][t]]
        for part, items in (("pair", pairs), ("term", terms)):
            ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))
            found += [(*g, part, item, value, i) for i, (value, item) in enumerate(ranked[: top if part == "term" else None], 1)]
    return sorted(found)


def result(df, **options):
    found = sd.divergence(df, **options).select("lang", "source", "part", "item", "value", "rank").collect()
    return sorted(tuple(r) for r in found)


@pytest.mark.parametrize("least", [3, 10])
def test_given_documents(spark, least):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("text", "lang", "source").collect()]
    assert result(docs, least_docs=least) == plain(rows, least)


def test_nulls_ties_and_groups_without_terms(spark):
    words = "Ab ab! ÄB äb x9y `z` 你好 a\u0000b " * 2
    rows = [(i, words, "en", f"s{i % 3}") for i in range(12)] + [(20, "ab only ab", "en", None), (21, None, "en", "none")]
    rows += [(22, "few words", None, "p"), (23, "", None, "q"), (24, None, None, None), (25, "rare", "xx", "alone")]
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame(rows, SCHEMA)
    found = result(df)
    assert found == plain([r[1:] for r in rows])
    assert ("", "p", "pair", "q", 0, 2) in found and not any(r[0] == "xx" for r in found)
    assert not any(r[2] == "term" and r[1] == "none" for r in found)


def test_empty_table_and_clashing_columns(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
    df = spark.createDataFrame([(i, "one two", "en", f"s{i % 2}", 1, "x", 2) for i in range(20)], SCHEMA + ", n long, term string, value long")
    assert result(df) == plain([("one two", "en", f"s{i % 2}") for i in range(20)])


def test_accumulators_by_tiles(monkeypatch):
    """Groups in tiles of 3 and postings in slices of 7 give what a dense sum gives."""
    monkeypatch.setattr(sd, "TILE", 3)
    monkeypatch.setattr(sd, "ENTRIES", 7)
    random = np.random.default_rng(5)
    shares = random.integers(1, 10**9, (40, 8)) * (random.random((40, 8)) < 0.5)
    zero = random.integers(1, 1000, 8)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    wanted = defaultdict(int)
    rows = []
    for term in shares:
        held = np.flatnonzero(term).tolist()
        for g in held:
            for h in held:
                p, q, z, y = (int(x) for x in (term[g], term[h], zero[g], zero[h]))
                wanted[g, h] += f(p, q) - f(p, y) - f(z, q) + f(z, y)
        postings = [{"peer": h, "p": int(term[h]), "z": int(zero[h])} for h in held]
        rows += [{"lang": "en", "tile": t, "peers": 8, "postings": postings} for t in sorted({h // 3 for h in held})]
    rows.sort(key=lambda r: r["tile"])
    kind = pa.list_(pa.struct([("peer", pa.int32()), ("p", pa.int64()), ("z", pa.int64())]))
    schema = pa.schema([("lang", pa.string()), ("tile", pa.int32()), ("peers", pa.int32()), ("postings", kind)])
    batches = [pa.RecordBatch.from_pylist(rows[i : i + 11], schema=schema) for i in range(0, len(rows), 11)]
    found = {(r["peer"], r["other"]): r["value"] for b in sd._accumulated(iter(batches)) for r in b.to_pylist()}
    assert found == {k: v for k, v in wanted.items() if v}


def test_shares_of_large_counts(spark):
    df = spark.createDataFrame([(9 * 10**17, 10**18 + 7), (0, 0), (5, 7)], "n long, total long")
    from pyspark.sql import functions as F

    found = [r[0] for r in df.select(sd.share(F.col("n"), F.col("total"))).collect()]
    assert found == [1 + 10**9 * (9 * 10**17 + 2) // (10**18 + 7), None, 1 + 10**9]

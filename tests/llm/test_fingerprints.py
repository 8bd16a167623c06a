"""Piecewise fingerprints against the same rules byte by byte."""

import hashlib

import numpy as np
import pytest
import xxhash

from trailmark.llm import document_fingerprints as fp

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


def plain_hash(data, i):
    value = 0
    for j in range(fp.WINDOW):
        value += (data[i - j] if i >= j else 0) * pow(0x2F0B4C47, j, 1 << 32)
    value %= 1 << 32
    return (value ^ value >> 15) * 0x9E3779B1 % (1 << 32)


def plain_fingerprint(text):
    data, first = text.encode(), {}
    for i in range(len(data)):
        first.setdefault(plain_hash(data, i), i)
    at = lambda level: sorted(i for h, i in first.items() if h < 2 ** (32 - level))
    level = next(k for k in range(33) if len(at(k)) <= fp.PIECES)
    parts = [str(level)]
    for k in range(level, level + fp.SIZES):
        cuts = [0, *(i + 1 for i in at(k))]
        pieces = [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)])]
        parts.append("".join(fp.LETTERS[xxhash.xxh32_intdigest(x) >> 26] for x in pieces if x))
    return ":".join(parts)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(above[j - 1] if x == y else 1 + min(above[j], row[j - 1]))
    return row[-1]


@pytest.fixture(scope="module")
def texts(spark):
    return [r[0] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]


def test_fingerprint_byte_by_byte(texts):
    odd = ["", "a", "äöü", "ab" * 2000, "one line, again\n" * 300, "\x00" * 100, "x" * 64]
    for text in [*odd, *(t for t in texts if len(t) < 4000)]:
        assert fp.fingerprint(text) == plain_fingerprint(text)


def test_segments_do_not_matter(texts, monkeypatch):
    whole = [fp.fingerprint(t) for t in texts]
    monkeypatch.setattr(fp, "SEGMENT", 100)
    assert [fp.fingerprint(t) for t in texts] == whole
    assert (fp.rolled(b"abcdefghijkl", 9, 12) == fp.rolled(b"abcdefghijkl", 0, 12)[9:]).all()


def test_edit_distance():
    random = np.random.default_rng(3)
    for _ in range(200):
        a, b = ("".join(random.choice(list("ABCD"), random.integers(0, 70))) for _ in range(2))
        assert len(a) + len(b) - 2 * fp.shared_letters(a, b) == plain_distance(a, b)


def test_likeness():
    random = np.random.default_rng(4)
    words = [" ".join("".join(random.choice(list("abcdefghij"), 6)) for _ in range(400)) for _ in range(2)]
    a, b = words
    middle = a[:1200] + " put in " + a[1210:]
    near = fp.likeness(fp.fingerprint(a), fp.fingerprint(middle))
    assert near > 0.85 and near == fp.likeness(fp.fingerprint(middle), fp.fingerprint(a))
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(b)) < 0.1
    assert 0.4 < fp.likeness(fp.fingerprint(a), fp.fingerprint(fp.edited(a, b))) < 0.75
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint(a[:1200])) > 0.5
    assert fp.likeness(fp.fingerprint(a), fp.fingerprint("")) == 0 and fp.likeness("0::::", "0::::") == 1
    assert fp.likeness(fp.fingerprint("short"), fp.fingerprint(a)) == 0


def expected(rows):
    """Rows of (doc_id, text) with the one that follows."""
    key = lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest())
    ordered = sorted(rows, key=key)
    found = []
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        text, after = text or "", after or ""
        changed = text[: (len(text) + 1) // 2] + after[: len(text) // 2]
        own, other = fp.fingerprint(text), fp.fingerprint(changed)
        found.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other, fp.likeness(own, other), fp.likeness(own, fp.fingerprint(after))))
    return sorted(found, key=str)


def result(df):
    return sorted((tuple(r) for r in fp.fingerprints(df).collect()), key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_neighbours_across_ranges(spark, parts):
    df = spark.read.parquet(f"{SF}/documents.parquet").repartition(parts)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    assert result(df) == expected(rows)


def test_nulls_repeats_and_few_rows(spark):
    rows = [(5, "five five five five"), (5, "other five"), (5, "other five"), (None, "no id at all"), (3, None), (2, ""), (9, "n" * 50), (None, None)]
    assert result(spark.createDataFrame(rows, SCHEMA)) == expected(rows)
    assert result(spark.createDataFrame([(1, "alone here")], SCHEMA)) == expected([(1, "alone here")])
    assert result(spark.createDataFrame([], SCHEMA)) == []
    more = spark.createDataFrame([(1, "a b c", "x", 1), (2, "d e f", "y", 2)], SCHEMA + ", fingerprint string, part int")
    assert result(more) == expected([(1, "a b c"), (2, "d e f")])


def test_long_text(spark):
    text = "".join(np.random.default_rng(1).choice(list("abcdefgh \n"), 3_000_000))
    found = result(spark.createDataFrame([(1, text), (2, "tail " * 10)], SCHEMA))
    assert found == expected([(1, text), (2, "tail " * 10)])
    assert len(found[0][3]) < 200

"""The prefix trie against a plain trie of tuples."""

import hashlib
import re
from collections import defaultdict
from zlib import crc32

import pytest

from trailmark.llm import prefix_trie

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, (role, text)))
    turns = {c: [t[3] for t in sorted(own[c])] for c in own}
    members, ends = defaultdict(list), defaultdict(list)
    for c, mine in turns.items():
        h = crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        seq = tuple(turns.get(base, [])[:h] + mine[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    found = []

    def below(path):
        saved = (len(members[path]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        n_leaves = 0 if children[path] else 1
        for child in children[path]:
            s, n = below(child)
            saved, n_leaves = saved + s, n_leaves + n
        sha = hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()
        parent = min(members[path[:-1]]) if path else None
        found.append((min(members[path]), len(path), parent, len(members[path]), len(children[path]), n_leaves, saved, sha))
        return saved, n_leaves

    if members:
        below(())
    return sorted(found, key=str)


def result(df):
    return sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=str)


@pytest.mark.parametrize("parts", [1, 9])
def test_given_conversations(spark, parts):
    df = spark.read.parquet(f"{SF}/conversations.parquet").repartition(parts)
    assert result(df) == plain([tuple(r) for r in df.collect()])


def test_hot_first_turn_and_copies(spark):
    """A third of all conversations are one, another third share their first turns, ends lie on inner nodes."""
    rows = []
    for c in range(300):
        if c % 3 == 0:
            texts = ["same", "as all", "others"]
        elif c % 3 == 1:
            texts = ["same", f"then {c}", "x y  z"][: 1 + c % 2 + c % 4 // 2]
        else:
            texts = [f"own {c % 7}", "two\twords", "", "end"][: 1 + c % 4]
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", text) for t, text in enumerate(texts)]
    assert result(spark.createDataFrame(rows, SCHEMA).repartition(7)) == plain(rows)


def test_nulls_ties_and_conversations_without_turns(spark):
    rows = [(1, 0, "user", "one turn, may be cut")] * 2  # repeated rows
    rows += [(c, 0, "user", "only turn") for c in range(21, 40)]  # no conversation 20: some lose their only turn
    rows += [(40, None, None, "null first"), (40, 2, "user", None), (40, 2, "user", "tie"), (40, 1, "", "")]
    rows += [(c, i, "user", f"t{i}") for c in (41, 42, 43, -41, -40) for i in range(4)]
    rows += [(None, 0, "user", "no conversation"), (2**62, 0, "a", "large id")]
    found = result(spark.createDataFrame(rows, SCHEMA))
    assert found == plain(rows)
    root = next(r for r in found if r[1] == 0)
    assert root[7] != hashlib.sha256(b"").hexdigest()  # some are turnless


def test_empty_long_and_clashing(spark):
    assert result(spark.createDataFrame([], SCHEMA)) == []
    long = [(7, i, "user", f"turn {i}") for i in range(700)] + [(8, i, "user", f"turn {i}") for i in range(500)]
    assert result(spark.createDataFrame(long, SCHEMA)) == plain(long)
    more = spark.createDataFrame([(3, 0, "user", "a", "x", 1, 2), (4, 0, "user", "a", "y", 1, 2)], SCHEMA + ", key string, depth long, seq long")
    assert result(more) == plain([(3, 0, "user", "a"), (4, 0, "user", "a")])


def test_end_lists_in_blocks(spark):
    ids = [5, 511, 512, 513, 100000, -3, 7]
    chains = spark.createDataFrame([(i, "k") for i in ids] + [(99, "other")], "conv_id long, end string")
    found = {r.key: r.ends_sha256 for r in prefix_trie.end_hashes(chains).collect()}
    joined = lambda x: hashlib.sha256(",".join(map(str, sorted(x))).encode()).hexdigest()
    assert found == {"k": joined(ids), "other": joined([99])}

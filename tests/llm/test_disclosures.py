"""Disclosing terms against plain loops over a small corpus, values of one text included."""

import math
from collections import Counter

import numpy as np
import pytest

from trailmark.llm import disclosure


def plain(texts, significance=disclosure.SIGNIFICANCE, generalise=disclosure.GENERALISE):
    own, terms, both = Counter(), Counter(), Counter()
    for text in texts:
        spans = disclosure.typed_spans(text or "")
        own.update({disclosure.entity(k, text[a:b]) for k, a, b in spans})
        both.update({c[:2] for c in disclosure.clues(text or "", spans)})
        terms.update(set(disclosure._WORD.findall((text or "").lower())))
    n, found = len(texts), {}
    for (entity, term), k in both.items():
        e, t = own[entity], terms[term]
        q, p = k / e, t / n
        if e == n or q <= p:
            continue
        exponent = e * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0))
        share = math.log(q / p) / math.log(n / e)
        if exponent >= -math.log(significance) and share > generalise:
            found[entity, term] = share
    return found


@pytest.mark.parametrize("seed", range(2))
def test_against_plain_loops(spark, seed):
    random = np.random.default_rng(seed)
    words = np.array([f"{a}{b}word" for a in "abcdefghijklmnopqrst" for b in "abcdefghijklmnopqrst"])
    share = 1.0 / np.arange(1, len(words) + 1)
    texts = []
    for i in range(1200):
        own = list(random.choice(words, 14, p=share / share.sum()))
        if i % 7 == 0:
            user = int(random.integers(60)) ** 2 // 60
            place = int(random.integers(14))
            own[place:place] = [f"user{user}@ex.org", "nick" + chr(97 + user // 26) + chr(97 + user % 26)][: 1 + i % 2]
        if i % 7 == 0 and i % 3 == 0:
            own.insert(0, "hotline +49 30 1234567")
        texts.append(" ".join(own))
    texts += [None, "", texts[0], "solo@ex.org by onlyhere"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    found = {(r.entity, r.term): r.share for r in disclosure.disclosures(disclosure.mentions(docs), docs).collect()}
    wanted = plain(texts)
    assert set(found) == set(wanted) and len(wanted) > 20
    assert all(found[k] == pytest.approx(wanted[k]) for k in wanted)
    assert found["email:solo@ex.org", "onlyhere"] == pytest.approx(1.0)


def test_a_value_of_one_text(spark):
    """A word met nowhere else beside it is removed, a frequent one stays."""
    texts = ["the mail of the office came late"] * 2000 + ["the mail of bernadine kim@ex.org came late"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    hidden = {r.doc_id: r.text for r in disclosure.masked(docs).collect()}
    assert hidden[2000] == "the mail of  [EMAIL] came late" and hidden[0] == texts[0]

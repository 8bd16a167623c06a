"""Secrets that the first form of the scan could not see."""

import random
import string

import pytest

from trailmark.llm import secret_scan

VALUE = "9fK2xQ7LmZ8vR4tYp1Wc6NbHs3"
PADDED = "q8Zt3LxV0nR7yGd2+Kw9/Sb5JmP1uHc6TfE4aXo7vYi3NzQ0rDk8WlB2sMgj5p=="


@pytest.mark.parametrize(
    "text, value",
    [
        (f"DB_AUTH={VALUE}\nMODE=prod", VALUE),
        (f"https://host/x?sig={VALUE}&v=2", VALUE),
        (f"https://host/x?v=2&sig={VALUE}", VALUE),
        (f"AccountName=a;AccountKey={PADDED};EndpointSuffix=core", PADDED),
        (f"A_LONG_NAME_OF_A_VARIABLE={VALUE}", VALUE),
        (f"{VALUE}=on", VALUE),
        (f"auth: {VALUE}", VALUE),
    ],
)
def test_tokens_beside_an_equals_sign(text, value):
    assert value in [m[0] for m in secret_scan._TOKEN.finditer(text)]


def test_assigned_secrets_are_discoveries(spark):
    rng = random.Random(5)
    words = ["configuration", "distribution-of-values", "src/main/java/com/example/application", "an_ordinary_name_of_a_file"]
    texts, planted = [], {}
    for i in range(200):
        value = "".join(rng.choices(string.ascii_letters + string.digits, k=32))
        if i % 10 < 3:
            planted[i] = value + ("==" if i % 10 == 2 else "")
            texts.append(f"{('DB_AUTH=', 'see https://host/p?sig=', 'AccountKey=')[i % 10]}{planted[i]} {words[i % 4]}")
        else:
            texts.append(f"PATH_NAME={words[i % 4]}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [texts[r.doc_id][t.start : t.end] for t in r.tokens] for r in secret_scan.scan(docs).collect()}
    assert {i: v for i, v in found.items() if v} == {i: [v] for i, v in planted.items()}


@pytest.mark.parametrize("alphabet, size", [(string.ascii_lowercase, 32), (string.ascii_uppercase, 32), (string.digits, 100)])
def test_random_tokens_of_one_class(spark, alphabet, size):
    """Letters of one case and digits alone, among prose, long words and ordinary long numbers."""
    rng = random.Random(11)
    prose = (
        "the report of the committee was read on the morning of the second day and nobody there had anything to add because most of them "
        "thought that it would be better to wait for the answer of the other members who were still in the country in 2001 and 2003 or 2010 "
    )
    ordinary = {
        string.ascii_lowercase: "thereportofthecommitteewasreadonthemorning",
        string.ascii_uppercase: "NOBODYTHEREHADANYTHINGTOADDBECAUSEMOST",
        string.digits: "200120032010" * 9,
    }[alphabet]
    texts, planted = [], {}
    for i in range(120):
        if i % 4 == 0:
            planted[i] = "".join(rng.choices(alphabet, k=size))
        texts.append(f"{prose} key: {planted.get(i, ordinary)} {prose}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [texts[r.doc_id][t.start : t.end] for t in r.tokens] for r in secret_scan.scan(docs).collect()}
    good = {i for i, v in found.items() if v == [planted.get(i)]}
    assert {i for i, v in found.items() if v} == good and len(good) >= 0.95 * len(planted)


def test_neighbours_of_short_tokens_only(spark):
    docs = spark.createDataFrame([("ab", ), ("Ab 12", ), (None, ), ("ab" * 30, ), ("é b", )], "text string")
    ratio = secret_scan.ordinary(docs).ratio
    pairs = secret_scan.np.zeros((38, 38))
    pairs[0, 1], pairs[27, 28] = 2, 1
    assert (ratio == secret_scan.Ordinary(pairs).ratio).all()

"""Words whose normal form is not letters only, before punctuation, against the library."""

import random

import pytest

from trailmark.llm import token_store


@pytest.fixture(scope="module")
def encoder():
    return token_store.Encoder(token_store.tokenizer_path())


WORDS = ["GELDİ", "İ", "হয়", "কড়", "ड़", "कड़", "क़क", "Straße", "ﬁn", "ª", "xͅ", "한국어", "naïve", "ᾳ", "ŉ"]


@pytest.mark.parametrize("word", WORDS)
def test_word_before_punctuation(encoder, word):
    for tail in [".", ",", ";", ":", "!", "?", "...", "?!", ""]:
        for text in (word + tail, f"one {word}{tail} two", f"{word}{tail} {word} {word}{tail}"):
            wanted = encoder.library.encode(text, add_special_tokens=False).ids
            fresh = token_store.Encoder(token_store.tokenizer_path()) if tail == "." else encoder
            assert token_store._ids(fresh.encode([text])[0], fresh.kind is token_store.np.uint32).tolist() == wanted, text


def test_letters_of_all_scripts_before_punctuation(encoder):
    rng = random.Random(3)
    letters = [chr(c) for c in range(0x80, 0x30000) if chr(c).isalpha()]
    letters = [c for c in letters if ord(c) < 0x3400 or 0xA000 <= ord(c) < 0xAC00 or ord(c) > 0xD7A3 and ord(c) < 0x1F000] + rng.sample(letters, 2000)
    texts = [f"a{c}{tail}" for c in letters for tail in rng.sample([".", ",", "?!", ":"], 2)]
    found = [token_store._ids(raw, encoder.kind is token_store.np.uint32).tolist() for raw in encoder.encode(texts)]
    wanted = [one.ids for one in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, found, wanted) if a != b] == []

"""Language of whole texts: averaged hashed subword vectors, linear softmax, calibrated rejection.

The model is fitted on at most ``SAMPLE`` distinct labelled texts of ``SAMPLE_CHARS`` code points together, the first
by a hash of the row, in numpy on the driver. A tenth of the sample is kept apart to calibrate: a temperature makes the
softmax an honest probability, and a text is rejected if its calibrated score is lower than that
of all but the share ``REJECTED`` of right calibration texts, or if its words are of
a kind the model hardly knows: if the share of their n-grams that the fit has met, and three standard errors
more, lies below nine tenths of that of all but as many calibration texts of the language. Prediction sees the text only and runs in Arrow batches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.shared import batches, fold_column
from trailmark.llm.subword import MAX_CACHED_WORDS, WORD, Model, WordScores, buckets_of, softmax, train

SAMPLE = 2000  # bound of the labelled texts that are fitted
SAMPLE_CHARS = 30_000_000  # and of their code points together
SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 16
DIMENSION = 8
EPOCHS = 3
CALIBRATION = 10
REJECTED = 0.0005
KNOWN_SIZES = (2, 3)
KNOWN_BITS = 1 << 22
KNOWN_LEVEL = 0.9  # of the quantile: two hundred texts say little about the rarest words of a language
LEAST_SPREAD = 0.1
UNKNOWN = "und"
BATCH_CHARS = 1_000_000  # of texts whose words are counted at once


@dataclass
class LanguageModel:
    languages: list[str]
    network: Model | None
    temperature: float = 1.0
    least: float = 0.0  # scores below are rejected
    met: np.ndarray | None = None  # bitmap of the n-grams of the fit
    spread: float = 0.0  # of the known share of single words
    least_known: np.ndarray | None = None  # for each language


class KnownShares(dict):
    """word -> share of its n-grams that the fit has met; unknown words are added in batches by :meth:`learn`."""

    def __init__(self, met: np.ndarray):
        super().__init__()
        self.met = np.unpackbits(met).astype(bool)

    def learn(self, words: set[str]) -> None:
        if len(self) > MAX_CACHED_WORDS:
            self.clear()
        new = [w for w in words if w not in self]
        for begin in range(0, len(new), 20_000):
            part = new[begin : begin + 20_000]
            found, counts = buckets_of(part, KNOWN_SIZES, KNOWN_BITS)
            ends = np.cumsum(counts)
            self.update(zip(part, (np.add.reduceat(self.met[found], ends - counts, dtype=np.float64) / counts).tolist()))

    def of(self, words) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


def _met(words: list[str]) -> np.ndarray:
    met = np.zeros(KNOWN_BITS, bool)
    for begin in range(0, len(words), 20_000):
        met[buckets_of(words[begin : begin + 20_000], KNOWN_SIZES, KNOWN_BITS)[0]] = True
    return np.packbits(met)


def words_of(text: str) -> list[str]:
    """Lower-cased words; numerals that Python takes for word characters are none."""
    return [w for w in WORD.findall(text.lower()) if w.isascii() or w.isalpha() or any(map(str.isalpha, w))]


def sample_rows(rows: DataFrame, bound: int, text: str | None = None, chars: int = SAMPLE_CHARS) -> list:
    """The first distinct rows by a hash of their columns: ``bound`` of them, and ``chars`` code points of ``text`` at most.

    The hash and the rows alone decide, so every run finds the same ones. A count tells which share of the hash
    range to look at; hashes of about four times the bound are shuffled, and texts only of rows that are taken.
    """
    total = rows.count()
    share = min(1.0, 4.0 * bound / total) if total else 0.0
    size = F.length(text) if text else F.lit(0)
    hashed = rows.select("*", F.xxhash64(*rows.columns).alias("_hash"), size.alias("_size"))
    near = hashed.where(F.pmod("_hash", F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    first = near.select("_hash", "_size").distinct().orderBy("_hash", "_size").limit(bound).collect()
    taken, used = 0, 0
    while taken < len(first) and used + first[taken]["_size"] <= chars:
        used += first[taken]["_size"]
        taken += 1
    if not taken:
        return []
    return near.where(F.col("_hash") <= first[taken - 1]["_hash"]).drop("_hash", "_size").distinct().collect()


def fit(labelled: DataFrame, bound: int = SAMPLE, seed: int = 7) -> LanguageModel:
    """Learn from columns text and lang; rows without a label or a letter are left out.

    Without a labelled row the model knows no language and rejects every text.
    """
    rows = sample_rows(labelled.select("text", "lang").where("lang IS NOT NULL AND text IS NOT NULL"), bound, "text")
    rows = [(text, lang) for lang, text in sorted((r.lang, r.text) for r in rows) if WORD.search(text)]
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return LanguageModel([], None)
    np.random.default_rng(seed).shuffle(order := np.arange(len(rows)))
    index: dict[str, int] = {}
    bags, labels = [], []
    for i in order:
        bags.append(np.fromiter((index.setdefault(w, len(index)) for w in words_of(rows[i][0])), np.int32))
        labels.append(languages.index(rows[i][1]))
    words, labels = list(index), np.array(labels)
    # A long text is several bags, so that short texts are met too.
    held = max(1, len(bags) // CALIBRATION) if len(bags) > 1 else 0
    parts, owners = [], []
    for i, bag in enumerate(bags[held:], held):
        for cut in np.array_split(bag, max(1, min(8, len(bag) // 24))):
            parts.append(cut)
            owners.append(labels[i])
    network = train(
        words, parts, np.array(owners), len(languages), sizes=SIZES, buckets=BUCKETS, dimension=DIMENSION, epochs=EPOCHS, rate=0.1, seed=seed
    )
    model = LanguageModel(languages, network)
    if held:
        scores = np.stack([network.word_scores([words[w] for w in bag]).mean(axis=0) + network.bias for bag in bags[:held]])
        right = labels[:held]
        grid = np.geomspace(0.25, 8, 41)
        loss = [-np.log(softmax(scores / t)[np.arange(held), right] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(scores / model.temperature)
        good = p[np.arange(held), right][p.argmax(axis=1) == right]
        # The quantile of the right ones, and never more than what a clear majority reaches.
        model.least = float(min(np.quantile(good, REJECTED), 0.5)) if len(good) else 0.0
        fitted = np.zeros(len(words), bool)
        for bag in bags[held:]:
            fitted[bag] = True
        model.met = _met([w for w, use in zip(words, fitted) if use])
        known = KnownShares(model.met)
        known.learn(set(words))
        shares = [known.of([words[w] for w in bag]) for bag in bags[:held]]
        model.spread = max(LEAST_SPREAD, float(np.concatenate(shares).std()))
        lengths = np.array([len(one) for one in shares])
        level = np.array([one.mean() for one in shares]) + 3 * model.spread / np.sqrt(lengths)
        own = [level[right == i] for i in range(len(languages))]
        model.least_known = np.array([KNOWN_LEVEL * np.quantile(one if len(one) else level, REJECTED) for one in own])
    return model


def predictor(model: LanguageModel):
    """Function from texts to (language, score, rejected); unknown for texts without a letter."""
    scores_of = WordScores(model.network) if model.network else None
    known = KnownShares(model.met) if model.met is not None else None

    def predict(texts: list[str]) -> list[tuple[str, float, bool]]:
        counters = [Counter(words_of(text)) for text in texts] if scores_of is not None else [None] * len(texts)
        if scores_of is not None:
            scores_of.learn(words := set().union(*counters))
            if known is not None:
                known.learn(words)
        found = []
        for counted in counters:
            if not counted:
                found.append((UNKNOWN, 0.0, True))
                continue
            times = np.fromiter(counted.values(), np.float64, len(counted))
            score = times @ scores_of.table[scores_of.rows(counted)] / times.sum() + model.network.bias
            p = softmax(score[None, :] / model.temperature)[0]
            best = int(p.argmax())
            rejected = p[best] < model.least
            if known is not None and not rejected:
                n = times.sum()
                rejected = times @ known.of(counted) / n + 3 * model.spread / np.sqrt(n) < model.least_known[best]
            found.append((model.languages[best], float(p[best]), bool(rejected)))
        return found

    return predict


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row of ``docs`` (columns doc_id, text).

    Null, empty and letterless texts are ``und`` with score 0 and rejected. Repeated rows and null ids stay;
    other columns are neither read nor returned.
    """
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, fixed by BUCKETS and DIMENSION

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = predictor(sent.value)
        for batch in batches(source, chars=BATCH_CHARS):
            done = of([t or "" for t in batch.column("text").to_pylist()])
            lang, score, rejected = zip(*done)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=schema.names
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def accepted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns as they are."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = predictor(sent.value)
        for batch in batches(source, chars=BATCH_CHARS):
            done = of([t or "" for t in batch.column("text").to_pylist()])
            yield batch.filter(pa.array([not rejected for _, _, rejected in done], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def train_part(docs: DataFrame, parts: int = 5) -> DataFrame:
    """Rows that may be learned from: the fold of the id is not 0."""
    return docs.where(fold_column(F.col("doc_id"), parts) != 0)

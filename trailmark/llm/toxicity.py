"""Toxicity of whole texts: subword-bag vectors, linear softmax, trained on labelled texts only.

A text is cut into overlapping bags of ``BAG`` words, so a few bad words do not drown in a long text. Each
bag's vector is the mean of its words' vectors, a word's the mean of its hashed character n-grams', so
a misspelling never seen shares most of its vectors with the known spelling. Labels belong to
texts, not bags: training starts with all bags of toxic texts as positive and then, for a
few rounds, keeps of each toxic text the bags that the model itself finds toxic. The text's score
is that of its worst bags, mapped to a probability by a logistic curve fitted on texts the network
has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.language_id import sample_rows, words_of
from trailmark.llm.shared import batches, fold_column
from trailmark.llm.subword import WORD, Model, WordScores, train

SAMPLE = 5000  # bound of the labelled texts that are fitted
CLEAN_BAGS = 20_000  # bags of clean texts in a round, or six for each toxic bag if that is more
BAG = 8
SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIMENSION = 8
ROUNDS = (2, 2, 3)  # epochs between two choices of bags
CALIBRATION = 5
THRESHOLD = 0.3


@dataclass
class ToxicityModel:
    network: Model | None
    slope: np.ndarray | None = None  # logistic curve over the features of a text


def pooled(word_scores: np.ndarray) -> np.ndarray:
    """Features of a text from the toxic-minus-clean score of each of its words, in order: its
    worst bag, its second worst that shares no word with it, and its length."""
    n = len(word_scores)
    if not n:
        return np.array([-20.0, -20.0, 0.0])
    bags = bag_means(word_scores)
    worst = int(bags.argmax())
    apart = np.abs(np.arange(len(bags)) - worst) >= 2  # bags advance by half their length
    second = bags[apart].max() if apart.any() else bags.min()
    return np.array([bags[worst], second, np.log1p(n)])


def bag_means(values: np.ndarray) -> np.ndarray:
    """Means over bags of BAG words that advance by half a bag; the last one may be shorter."""
    sums = np.concatenate([[0.0], np.cumsum(values)])
    starts = np.arange(0, max(1, len(values) - BAG // 2), BAG // 2)
    ends = np.minimum(starts + BAG, len(values))
    return (sums[ends] - sums[starts]) / (ends - starts)


def fit(labelled: DataFrame, bound: int = SAMPLE, seed: int = 7) -> ToxicityModel:
    """Learn from columns text and toxic; without both labels every text scores 0."""
    rows = sample_rows(labelled.select("text", "toxic").where("toxic IS NOT NULL AND text IS NOT NULL"), bound, "text")
    rows = sorted((int(r.toxic), r.text) for r in rows)
    rows = [(text, label) for label, text in rows if WORD.search(text)]
    if len({label for _, label in rows}) < 2:
        return ToxicityModel(None)
    random = np.random.default_rng(seed)
    random.shuffle(order := np.arange(len(rows)))
    index: dict[str, int] = {}
    texts = [np.fromiter((index.setdefault(w, len(index)) for w in words_of(rows[i][0])), np.int32) for i in order]
    labels = np.array([rows[i][1] for i in order])
    words = list(index)
    held = len(texts) // CALIBRATION
    bags, owners = [], []
    for i in range(held, len(texts)):
        for start in range(0, max(1, len(texts[i]) - BAG // 2), BAG // 2):
            bags.append(texts[i][start : start + BAG])
            owners.append(i)
    owners = np.array(owners)
    positive = labels[owners] == 1
    chosen = positive.copy()
    model = None
    options = dict(sizes=SIZES, buckets=BUCKETS, dimension=DIMENSION, batch=256)
    for number, epochs in enumerate(ROUNDS):
        # All chosen bags of toxic texts, and as many clean ones as keeps both sides near.
        clean = np.nonzero(~positive)[0]
        clean = random.permutation(clean)[: max(CLEAN_BAGS, 6 * int(chosen.sum()))]
        use = np.concatenate([np.nonzero(chosen)[0], clean])
        model = train(
            words, [bags[i] for i in use], chosen[use].astype(np.int64), 2, epochs=epochs, rate=0.2, seed=seed + number, model=model, **options
        )
        margin = _margins(model, words)
        score = np.array([margin[b].mean() for b in bags])
        chosen = np.zeros(len(bags), bool)
        if number + 1 < len(ROUNDS):
            limit = np.quantile(score[~positive], 0.995)
            best: dict[int, int] = {}
            for i in np.nonzero(positive)[0]:
                if score[i] > limit:
                    chosen[i] = True
                if owners[i] not in best or score[i] > score[best[owners[i]]]:
                    best[owners[i]] = i
            if number == 0:  # later, texts without any bad bag are taken for wrongly labelled
                chosen[list(best.values())] = True
    features = np.stack([pooled(margin[t]) for t in texts[:held]]) if held else np.zeros((0, 3))
    return ToxicityModel(model, _logistic(features, labels[:held]))


def _margins(model: Model, words: list[str]) -> np.ndarray:
    scores = np.concatenate([model.word_scores(words[i : i + 20_000]) for i in range(0, len(words), 20_000)])
    return scores[:, 1] - scores[:, 0]


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Newton's method with a small ridge; mean, spread, and the coefficients with the constant last."""
    if len(x) < 10 or len(set(y)) < 2:
        return np.array([[0.0] * 3 + [0.0], [1.0] * 3 + [1.0], [1.0, 0.0, 0.0, 0.0]])
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.5 * np.eye(len(w)), z.T @ (y - p) - 0.5 * w)
    return np.vstack([np.append(mean, 0.0), np.append(spread, 1.0), w])


def scorer(model: ToxicityModel):
    scores_of = WordScores(model.network) if model.network else None

    def score(texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        if scores_of is None:
            return out
        mean, spread, weights = model.slope
        found = [words_of(text) for text in texts]
        scores_of.learn(set().union(*found))
        margins = scores_of.table[:, 1] - scores_of.table[:, 0]
        for i, words in enumerate(found):
            if words:
                z = (pooled(margins[scores_of.rows(words)]) - mean[:3]) / spread[:3]
                out[i] = 1 / (1 + np.exp(-np.clip(z @ weights[:3] + weights[3], -30, 30)))
        return out

    return score


def toxic_scores(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (0 or 1) of every row of ``docs`` (columns doc_id, text).

    Null, empty and letterless texts score 0. Repeated rows and null ids stay; other columns are left out.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, fixed by BUCKETS and DIMENSION

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(sent.value)
        for batch in batches(source):
            found = of([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32))], names=schema.names
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def train_part(docs: DataFrame, labels: DataFrame, parts: int = 4, out: int = 2, bound: int = SAMPLE) -> DataFrame:
    """text, toxic of ``bound`` labelled ids at most whose fold is not ``out``.

    The sample is drawn from the labels alone, at once; its ids are few and are broadcast, so no text is shuffled. Ids
    without a document or with a null text count against the bound. A null id is in fold 0 and joins nothing.
    """
    own = labels.where(fold_column(F.col("doc_id"), parts) != out).select("doc_id", "toxic")
    own = own.where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    spark = docs.sparkSession
    ids = spark.createDataFrame(sample_rows(own, bound), own.schema)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")

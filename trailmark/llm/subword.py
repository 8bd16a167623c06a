"""Subword features and a small network: mean of hashed n-gram vectors, then a linear softmax.

Words repeat, so each distinct word is turned into its n-gram buckets once, and after training
into its class scores once (:class:`WordScores`); a text is then a weighted sum over its words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

WORD = re.compile(r"[^\W\d_]+")
MAX_CACHED_WORDS = 150_000


def buckets_of(words: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the n-grams of all words in turn, and how many each word has.

    Words are bounded by "<" and ">"; a word shorter than every size has itself as one n-gram.
    """
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - starts[word]
    found, owner = [], []
    prime = np.uint64(0x100000001B3)
    for size in sizes:
        own = place + size <= lengths[word]
        at = np.nonzero(own)[0]
        hashed = np.full(len(at), size, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(size):
            hashed = (hashed ^ codes[at + i]) * prime
            hashed ^= hashed >> np.uint64(29)
        found.append(hashed)
        owner.append(word[at])
    short = np.nonzero(lengths < min(sizes))[0]
    if len(short):
        hashed = np.full(len(short), 7, np.uint64)
        for i in range(min(sizes)):
            inside = i < lengths[short]
            hashed[inside] = (hashed[inside] ^ codes[starts[short][inside] + i]) * prime
        found.append(hashed)
        owner.append(short)
    every, whose = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(whose, kind="stable")
    mixed = every[order] ^ (every[order] >> np.uint64(32))
    return (mixed % np.uint64(buckets)).astype(np.int64), np.bincount(whose, minlength=len(words))


@dataclass
class Model:
    vectors: np.ndarray  # buckets x dimension
    weights: np.ndarray  # dimension x classes
    bias: np.ndarray
    sizes: tuple[int, ...]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Class scores of single words before the bias; bags are means of these."""
        found, counts = buckets_of(words, self.sizes, len(self.vectors))
        scores = (self.vectors @ self.weights)[found]
        ends = np.cumsum(counts)
        return np.add.reduceat(scores, ends - counts) / counts[:, None]


class WordScores(dict):
    """word -> row in ``table``; unknown words are added in batches by :meth:`learn`."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.product = model, (model.vectors @ model.weights).astype(np.float64)
        self.table = np.empty((1024, model.weights.shape[1]))

    def learn(self, words: set[str]) -> None:
        """Make sure that every word has a row; earlier row numbers may change."""
        if len(self) > MAX_CACHED_WORDS:
            self.clear()
        new = [w for w in words if w not in self]
        for begin in range(0, len(new), 20_000):
            part = new[begin : begin + 20_000]
            found, counts = buckets_of(part, self.model.sizes, len(self.model.vectors))
            ends = np.cumsum(counts)
            scores = np.add.reduceat(self.product[found], ends - counts) / counts[:, None]
            used = len(self)
            if used + len(part) > len(self.table):
                self.table = np.concatenate([self.table[:used], np.empty((used + 2 * len(part), scores.shape[1]))])
            self.table[used : used + len(part)] = scores
            self.update(zip(part, range(used, used + len(part))))

    def rows(self, words) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def softmax(scores: np.ndarray) -> np.ndarray:
    z = np.exp(scores - scores.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train(
    words: list[str], bags: list[np.ndarray], labels: np.ndarray, classes: int, *, sizes: tuple[int, ...], buckets: int, dimension: int,
    epochs: int, rate: float, batch: int = 64, seed: int = 7, weight: np.ndarray | None = None, model: Model | None = None,
) -> Model:
    """Stochastic gradient descent with Adagrad steps on the vectors and the softmax together.

    ``bags`` hold numbers of ``words``; a bag's vector is the mean of its words' vectors, a word's the
    mean of its n-grams'. ``weight`` scales the loss of each bag.
    """
    random = np.random.default_rng(seed)
    if model is None:
        model = Model(
            random.normal(0, 0.1, (buckets, dimension)).astype(np.float32), random.normal(0, 0.1, (dimension, classes)).astype(np.float32),
            np.zeros(classes, np.float32), sizes,
        )
    # In parts: the hashes of all words at once would need ten times the memory of their buckets.
    parts = [buckets_of(words[i : i + 20_000], sizes, buckets) for i in range(0, len(words), 20_000)]
    found, counts = np.concatenate([f.astype(np.int32) for f, _ in parts]), np.concatenate([c for _, c in parts])
    first = np.cumsum(counts) - counts
    seen = np.full(buckets, 1e-6, np.float32)
    seen_w, seen_b = np.full(model.weights.shape, 1e-6, np.float32), np.full(classes, 1e-6, np.float32)
    weight = np.ones(len(bags), np.float32) if weight is None else weight.astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        order = random.permutation(len(bags)).astype(np.int32)
        for begin in range(0, len(order), batch):
            chosen = order[begin : begin + batch]
            sizes_of = np.fromiter((len(bags[i]) for i in chosen), np.int64, len(chosen))
            flat = np.concatenate([bags[i] for i in chosen])
            own, place = np.unique(flat, return_inverse=True)
            # share of each distinct word in each bag
            cell = np.repeat(np.arange(len(chosen)) * len(own), sizes_of) + place
            share = np.bincount(cell, np.repeat(1 / sizes_of, sizes_of), len(chosen) * len(own))
            share = share.reshape(len(chosen), -1).astype(np.float32)
            lengths = counts[own]
            ends = np.cumsum(lengths)
            grams = found[np.repeat(first[own] - (ends - lengths), lengths) + np.arange(ends[-1])]
            of_word = np.add.reduceat(model.vectors[grams], ends - lengths) / lengths[:, None]
            hidden = share @ of_word
            p = softmax(hidden @ model.weights + model.bias)
            p[np.arange(len(chosen)), labels[chosen]] -= 1
            p *= weight[chosen, None] / len(chosen)
            grad_w, grad_b = hidden.T @ p, p.sum(axis=0)
            grad_word = share.T @ (p @ model.weights.T) / lengths[:, None]
            grad = np.repeat(grad_word, lengths, axis=0)
            order_of = np.argsort(grams)
            at, begins = np.unique(grams[order_of], return_index=True)
            total = np.add.reduceat(grad[order_of], begins)
            seen[at] += (total**2).mean(axis=1)
            model.vectors[at] -= step * total / np.sqrt(seen[at])[:, None]
            seen_w += grad_w**2
            seen_b += grad_b**2
            model.weights -= step * grad_w / np.sqrt(seen_w)
            model.bias -= step * grad_b / np.sqrt(seen_b)
    return model

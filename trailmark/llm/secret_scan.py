"""Secrets: patterns, and a battery of randomness tests with false-discovery control.

Every long token of a text is a candidate. Its encoding is inferred (decimal, hex, base32, base36,
base62, base64), and three statistics compare it with what that alphabet gives at random: chi-
squared uniformity of its symbols, the number of runs above and below the median symbol, and the
serial correlation of neighbours. Each becomes a p-value of the hypothesis "random"; the least of
the three, corrected for three tests, measures how far the token is from random. A token that
looks random is no discovery yet: short ordinary words may look so too. So a second p-value, of
the hypothesis "ordinary text of this length", bounds how often words and file names change
between small letters, capitals and digits; the longer the token, the smaller it gets. A token of one class
changes nowhere; there it bounds how likely ordinary neighbours are to be as unlike those of
ordinary words and numbers as the token's, by the likelihood ratio of its pairs of neighbours under the
corpus-wide counts of short tokens against uniform ones. The second p-value is
controlled by the Benjamini-Hochberg rule within each encoding and length band, over all
candidates of the corpus: the counts per band and p-value step are one small table whose size does
not depend on the data.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.shared import batches, map_text, materialise
from trailmark.llm.spans import digest, joined

LEAST = 20  # characters of a candidate
RANDOM = 1e-3  # least corrected p-value of a token that may be random
DISCOVERY_RATE = 0.01
STEPS_A_DECADE = 4
DECADES = 75

# Fixed order and patterns of the typed spans; a run of a class is tried only from its start.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
# "=" is padding at the end only: what stands on either side of NAME=value is a token of its own.
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?(?![A-Za-z0-9+/_-])")
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)

# The alphabets of common encodings, in their own order.
ALPHABETS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("letters", "abcdefghijklmnopqrstuvwxyz"),
    ("LETTERS", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_SETS = [(name, frozenset(alphabet), {c: i for i, c in enumerate(alphabet)}) for name, alphabet in ALPHABETS]


def typed_spans(text: str) -> list[tuple[str, int, int]]:
    """Valid spans by start, then kind; code points, end exclusive."""
    found = []
    if _KEYWORD.search(text):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def inferred(token: str) -> tuple[str, dict[str, int]] | None:
    """The smallest encoding whose alphabet holds every symbol of the token but its padding."""
    symbols = set(token.rstrip("="))
    return next(((name, index) for name, alphabet, index in _SETS if symbols <= alphabet), None)


def _tail(z: float) -> float:
    """Upper tail of the standard normal."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, ordinary: Ordinary | None = None) -> tuple[str, float, float] | None:
    """Encoding, p-value of "random" and p-value of "ordinary text", None if no encoding fits.

    Wilson and Hilferty's cube root turns chi-squared into a normal value. Against ordinary text the
    number of changes between letters of either case and digits counts: words seldom change the
    class of a symbol, random ones do at a rate known from the alphabet. A token of one class is
    held against ``ordinary`` pairs of letters or digits.
    """
    found = inferred(token)
    if found is None:
        return None
    name, index = found
    symbols = np.fromiter(map(index.__getitem__, token.rstrip("=")), np.int64)
    n, k = len(symbols), len(index)
    if n < LEAST:
        return None
    counts = np.bincount(symbols, minlength=k)
    chi = float(((counts - n / k) ** 2).sum() * k / n)
    df = k - 1
    uniform = _tail(((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))

    above = symbols >= k / 2
    p = (k - math.ceil(k / 2)) / k
    mean, spread = 1 + 2 * (n - 1) * p * (1 - p), math.sqrt(max(1e-9, 2 * (n - 1) * p * (1 - p) * (1 - 2 * p * (1 - p))))
    runs = 1 + int((above[1:] != above[:-1]).sum())
    runs_p = min(1.0, 2 * _tail(abs(runs - mean) / spread))

    centred = symbols - (k - 1) / 2
    variance = (k * k - 1) / 12
    serial = float((centred[1:] * centred[:-1]).sum()) / (variance * math.sqrt(n - 1))
    serial_p = min(1.0, 2 * _tail(abs(serial)))
    random_p = min(1.0, 3 * min(uniform, runs_p, serial_p))

    classes = np.array([0 if c.islower() else 1 if c.isupper() else 2 for c in token.rstrip("=")])
    changes = int((classes[1:] != classes[:-1]).sum())
    return name, random_p, ordinary.tail(token.rstrip("=")) if ordinary and not changes else _changes_tail(changes, n - 1)


# Letters of either case are 0 to 25, digits 26 to 35, other symbols of a token 36, all else 37.
_CODE = np.full(256, 37, np.uint8)
_CODE[[*b"+/_-="]] = 36
_CODE[[*b"abcdefghijklmnopqrstuvwxyz"]] = _CODE[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = np.arange(26)
_CODE[[*b"0123456789"]] = np.arange(26, 36)
UNIFORM = 0.1  # least share of ordinary neighbours taken as uniform, so no pair is impossible
PRIOR = 30.0  # uniform pairs of each kind that count beside those met, so a small corpus tells little


class Ordinary:
    """Log-ratios of uniform to ordinary for the pairs of neighbours, of letters and of digits apart."""

    def __init__(self, pairs: np.ndarray):
        self.ratio = np.zeros((36, 36))
        for part in (slice(0, 26), slice(26, 36)):
            met = pairs[part, part].astype(np.float64)
            k = len(met)
            single = (met.sum(axis=0) + PRIOR) / (met.sum() + PRIOR * k)
            share = (met + PRIOR * single) / (met.sum(axis=1, keepdims=True) + PRIOR)
            sure = (1 - UNIFORM) * met.sum() / (met.sum() + PRIOR * k * k)
            self.ratio[part, part] = -np.log(k * (sure * share + (1 - sure) / k))

    def tail(self, token: str) -> float:
        """Bound of the chance that ordinary neighbours are so much likelier under uniform ones (Markov's inequality)."""
        codes = _CODE[np.frombuffer(token.encode(), np.uint8)]
        if codes.max() >= 36:  # digits parted by symbols
            return 1.0
        return math.exp(min(0.0, -float(self.ratio[codes[:-1], codes[1:]].sum())))


def ordinary(docs: DataFrame) -> Ordinary:
    """Counts of neighbours over all tokens of ``docs`` too short for a candidate; at most 38 * 38 rows reach the driver."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(38 * 38, np.int64)
        for batch in batches(source):
            column = pa.chunked_array([batch.column("text")]).cast(pa.large_binary()).combine_chunks()
            column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
            if not len(column) or column.buffers()[2] is None:
                continue
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            codes = _CODE[np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
            if not len(codes):
                continue
            cut = codes[1:] == 37  # between places: a run begins or ends
            cut |= codes[:-1] == 37
            inner = ends[1:-1] - ends[0]
            cut[inner[(inner > 0) & (inner < len(codes))] - 1] = True
            runs = np.diff(np.concatenate([[0], np.nonzero(cut)[0] + 1, [len(codes)]]))
            use = ~cut & np.repeat(runs < LEAST, runs)[:-1]
            for at in range(0, len(use), 1 << 20):
                own = use[at : at + (1 << 20)]
                first, second = codes[at : at + len(own)][own], codes[at + 1 : at + 1 + len(own)][own]
                total += np.bincount(first.astype(np.int64) * 38 + second, minlength=38 * 38)
        met = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["pair", "n"])

    counted = docs.select("text").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = np.zeros(38 * 38, np.int64)
    for row in counted.collect():
        pairs[row.pair] = row.n
    return Ordinary(pairs.reshape(38, 38))


ORDINARY_CHANGES = 0.06  # share of neighbours in ordinary text, file names and links that differ in class


def _changes_tail(changes: int, places: int, rate: float = ORDINARY_CHANGES) -> float:
    """Chernoff bound of the chance that ordinary text changes its class so often."""
    q = changes / places
    if q <= rate:
        return 1.0
    if q >= 1:
        return rate**places
    return math.exp(-places * (q * math.log(q / rate) + (1 - q) * math.log((1 - q) / (1 - rate))))


def _step(p: float) -> int:
    return min(DECADES * STEPS_A_DECADE, int(-math.log10(max(p, 1e-300)) * STEPS_A_DECADE))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, typed ``spans`` and ``tokens`` (start, end, encoding, length band, p-value step, may be random)."""
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    token = T.ArrayType(
        T.StructType(
            [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("encoding", T.StringType()),
             T.StructField("band", T.IntegerType()), T.StructField("step", T.IntegerType()), T.StructField("random", T.BooleanType())]
        )
    )
    null = ordinary(docs)  # some 10 KB

    def work(texts: list[str]) -> dict[str, object]:
        spans, tokens = [], []
        for text in texts:
            base = typed_spans(text)
            spans.append([dict(zip(("kind", "start", "end"), s)) for s in base])
            row = []
            for match in _TOKEN.finditer(text):
                tested = battery(match[0], null)
                if tested:
                    band = min(8, (match.end() - match.start()).bit_length())
                    row.append(dict(start=match.start(), end=match.end(), encoding=tested[0], band=band, step=_step(tested[2]), random=tested[1] >= RANDOM))
            tokens.append(row)
        return {"spans": spans, "tokens": tokens}

    return map_text(docs.select("doc_id", "text"), [("spans", kind), ("tokens", token)], work)


def thresholds(found: DataFrame, rate: float = DISCOVERY_RATE) -> DataFrame:
    """Least step that is a discovery, for each encoding and length band, over all candidates.

    Benjamini and Hochberg: the largest p-value with p * m / rank <= rate. Ranks come from counts per
    step; a step's p-value is its upper end, so rounding never lets more in.
    """
    counts = found.select(F.explode("tokens").alias("t")).groupBy("t.encoding", "t.band", "t.step").agg(F.count("*").alias("n"))
    group = Window.partitionBy("encoding", "band")
    ranked = counts.select(
        "encoding", "band", "step", F.sum("n").over(group).alias("m"), F.sum("n").over(group.orderBy(F.desc("step"))).alias("rank")
    )
    value = F.pow(F.lit(10.0), -F.col("step") / F.lit(float(STEPS_A_DECADE)))
    return ranked.where(value * F.col("m") <= rate * F.col("rank")).groupBy("encoding", "band").agg(F.min("step").alias("least"))


def scan(docs: DataFrame, rate: float = DISCOVERY_RATE) -> DataFrame:
    """One row per row of ``docs``: doc_id, typed ``spans`` and ``tokens`` found random (start, end, encoding).

    Null and empty texts have none; repeated rows count as so many candidates; null ids stay null; other
    columns are left out.
    """
    found = materialise(candidates(docs), "secret_candidates")
    limits = {f"{r.encoding}:{r.band}": r.least for r in thresholds(found, rate).collect()}  # at most 11 * 9 rows
    least = F.create_map(*[F.lit(x) for pair in (limits or {"": 0}).items() for x in pair])
    good = F.filter("tokens", lambda t: t.random & (t.step >= least[F.concat_ws(":", t.encoding, t.band.cast("string"))]))
    tokens = F.transform(good, lambda t: F.struct(t.start, t.end, t.encoding))
    return found.select("doc_id", "spans", tokens.alias("tokens"))


def secret_report(docs: DataFrame, rate: float = DISCOVERY_RATE) -> DataFrame:
    """Counts and digests of :func:`scan` for each row of ``docs``."""
    schema = T.StructType(
        [docs.schema["doc_id"], *(T.StructField("n_" + k, T.LongType()) for k in KINDS), T.StructField("base_sha256", T.StringType()),
         T.StructField("spans", T.StringType()), T.StructField("n_random", T.LongType())]
    )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows: list[list] = [[] for _ in range(len(KINDS) + 3)]
            for typed, tokens in zip(batch.column("spans").to_pylist(), batch.column("tokens").to_pylist()):
                base = [(s["kind"], s["start"], s["end"]) for s in typed]
                kinds = Counter(k for k, _, _ in base)
                more = [("random", t["start"], t["end"]) for t in tokens or []]
                every = sorted(base + more, key=lambda s: (s[1], (*KINDS, "random").index(s[0])))
                for column, value in zip(rows, [*(kinds[k] for k in KINDS), digest(base), joined(every), len(more)]):
                    column.append(value)
            arrays = [pa.array(r, pa.string() if i in (len(KINDS), len(KINDS) + 1) else pa.int64()) for i, r in enumerate(rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=schema.names)

    return scan(docs, rate).mapInArrow(run, schema)

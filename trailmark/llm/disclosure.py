"""Personal data: typed spans, and terms that give a protected entity away.

Typed spans (e-mail, ip, card, phone) are found by patterns with validity checks. Information-
theoretic sanitisation then protects what stands beside them. Every distinct typed value is an
entity. With N texts, n(e) texts holding entity e, n(t) holding term t and n(e, t) holding t
within ``WINDOW`` words of e, the term discloses e by

    PMI(e, t) = ln(N * n(e, t) / (n(e) * n(t)))     against     IC(e) = ln(N / n(e)).

A term that reveals more than the share ``GENERALISE`` of the entity's information is replaced
by a general word, above ``REMOVE`` it is removed. A pair must be no chance: if the texts of e held
t as often as any text does, n(e, t) of them would do so with a probability of ``SIGNIFICANCE``
at most (Chernoff's bound). A value of one text is judged too: a word beside it counts unless it is
in more than that share of all texts. All counts cover the whole corpus; they are reduced per task and by key, and the pairs are limited to windows round
entities, so they grow with the mentions and not with the square of a text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.shared import batches, map_text, materialise
from trailmark.llm.spans import Span, digest, joined

WINDOW = 8
SIGNIFICANCE = 1e-3  # largest chance that a pair met by accident
GENERALISE = 0.5
REMOVE = 0.8
MAX_COUNTED = 200_000  # distinct terms of a task between two partial results

# Fixed order and patterns of the typed spans.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can start only where a run of digits starts, so none is tried inside of one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){15,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_WORD = re.compile(r"[^\W\d_]{3,}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Goes from each "@" to the left, so long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at) if start < at else None
        if match:
            done = match.end()
            yield start, done
        else:
            done = max(done, at + 1)  # nothing left of a failed "@" can match: no run crosses it
        at = text.find("@", done)


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def typed_spans(text: str) -> list[Span]:
    """Valid spans by kind, then start; code points, end exclusive."""
    found: list[Span] = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for match in _IP.finditer(text):
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in (p.lstrip("0") for p in match[0].split("."))):
            found.append(("ip", *match.span()))
    for match in _CARD.finditer(text):
        digits = _digits(match[0])
        if len(digits) <= 19 and luhn(digits):
            found.append(("card", *match.span()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 8 <= len(_digits(match[0])) <= 15:
                found.append(("phone", *match.span()))
    return found


def entity(kind: str, value: str) -> str:
    """Name of the protected value, the same for all ways to write it."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else _digits(value)}"


def clues(text: str, found: list[Span], window: int = WINDOW) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of every word within ``window`` words of a typed span of the text."""
    near = []
    for kind, start, end in found:
        name = entity(kind, text[start:end])
        for match in _last_words(text, start, window):
            near.append((name, match[0].lower(), *match.span()))
        for i, match in enumerate(_WORD.finditer(text, end)):
            if i == window:
                break
            near.append((name, match[0].lower(), *match.span()))
    taken = [(a, b) for _, a, b in found]
    return [c for c in near if not any(c[2] < b and a < c[3] for a, b in taken)] if len(taken) < 50 else _apart(near, taken)


def _apart(near, taken):
    """As the plain test, for texts with very many spans: spans sorted, one bisection per word."""
    from bisect import bisect_left

    taken = sorted(taken)
    ends, top = [], 0
    for _, b in taken:
        top = max(top, b)
        ends.append(top)  # the largest end so far never falls
    starts = [a for a, _ in taken]
    kept = []
    for c in near:
        i = bisect_left(starts, c[3])  # spans that start before the word ends
        if not i or ends[i - 1] <= c[2]:
            kept.append(c)
    return kept


def _last_words(text: str, end: int, count: int) -> list[re.Match]:
    """The last ``count`` words before ``end``; looks back further only until it has them."""
    reach = 16 * count
    while True:
        begin = max(0, end - reach)
        found = list(_WORD.finditer(text, begin, end))
        if begin and found and found[0].start() == begin:
            found = found[1:]  # may be the end of a longer word
        if len(found) >= count or begin == 0:
            return found[-count:]
        reach *= 4


def mentions(docs: DataFrame) -> DataFrame:
    """doc_id, the typed ``spans`` of every whole text, and the ``clues`` near them."""
    kinds = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    clue = T.StructType(
        [T.StructField("entity", T.StringType()), T.StructField("term", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    )

    def work(texts: list[str]) -> dict[str, object]:
        spans = [typed_spans(t) for t in texts]
        return {
            "spans": [[dict(zip(("kind", "start", "end"), s)) for s in one] for one in spans],
            "entities": [sorted({entity(k, t[a:b]) for k, a, b in one}) for t, one in zip(texts, spans)],
            "clues": [
                [dict(zip(("entity", "term", "start", "end"), c)) for c in clues(t, one)] if one else []
                for t, one in zip(texts, spans)
            ],
        }

    fields = [("spans", kinds), ("entities", T.ArrayType(T.StringType())), ("clues", T.ArrayType(clue))]
    return map_text(docs.select("doc_id", "text"), fields, work)


def term_frequencies(docs: DataFrame) -> DataFrame:
    """``term``, ``texts``: the number of texts that hold each word of three letters or more."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

        for batch in batches(source):
            for text in batch.column("text").to_pylist():
                if text:
                    counts.update(set(_WORD.findall(text.lower())))
            if len(counts) > MAX_COUNTED:
                yield result()
                counts.clear()
        yield result()

    counted = docs.select("text").mapInArrow(run, "term string, n bigint")
    return counted.groupBy("term").agg(F.sum("n").alias("texts"))


def disclosures(found: DataFrame, docs: DataFrame, significance: float = SIGNIFICANCE, generalise: float = GENERALISE) -> DataFrame:
    """entity, term, share (disclosed part of the entity's information) above the lower threshold."""
    near = found.where(F.size("clues") > 0)
    pairs = near.select(F.explode(F.array_distinct(F.transform("clues", lambda c: F.struct(c.entity, c.term)))).alias("p"))
    pairs = pairs.groupBy("p.entity", "p.term").agg(F.count("*").alias("both"))
    entities = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("of_entity"))
    pairs = materialise(pairs.join(entities, "entity"), "disclosure_pairs")
    terms = term_frequencies(docs).join(pairs.select("term").distinct(), "term", "left_semi")
    total = float(docs.count())
    gain = F.log(F.lit(total) * F.col("both") / (F.col("of_entity") * F.col("texts")))
    share = gain / F.log(F.lit(total) / F.col("of_entity"))
    # Chernoff: the exponent is n(e) times the divergence of n(e, t) / n(e) from n(t) / N.
    missed, others = F.col("of_entity") - F.col("both"), F.lit(total) - F.col("texts")
    without = F.when(missed == 0, 0.0).when(others == 0, float("inf")).otherwise(missed * F.log(missed * total / (F.col("of_entity") * others)))
    sure = (gain > 0) & (F.col("both") * gain + without >= -math.log(significance))
    judged = pairs.join(terms, "term").where((F.col("of_entity") < total) & sure)
    return judged.select("entity", "term", share.alias("share")).where(F.col("share") > generalise)


def sanitise(docs: DataFrame, significance: float = SIGNIFICANCE, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``spans`` (typed, by kind and start) and ``terms``.

    ``terms`` are sorted (start, end, action) with action ``generalise`` or ``remove``. A null or empty text
    has neither. Repeated rows count as so many texts; null ids stay null; other columns are left out.
    """
    found = materialise(
        mentions(docs).withColumn("place", F.monotonically_increasing_id()), "mentions"
    )  # the written table fixes the row numbers
    risky = disclosures(found, docs, significance, generalise)
    each = found.where(F.size("clues") > 0).select("place", F.explode("clues").alias("c"))
    marked = each.select("place", "c.*").join(risky, ["entity", "term"])
    action = F.when(F.max("share") > remove, "remove").otherwise("generalise")
    marked = marked.groupBy("place", "start", "end").agg(action.alias("action"))
    terms = marked.groupBy("place").agg(F.sort_array(F.collect_list(F.struct("start", "end", "action"))).alias("terms"))
    return found.join(terms, "place", "left").select("doc_id", "spans", "terms")


def masked(docs: DataFrame, **options) -> DataFrame:
    """doc_id and the sanitised ``text``: typed values become [KIND], risky terms [TERM] or nothing.

    Rows are matched by id and text, so repeated ids are no harm.
    """
    found = sanitise(docs.withColumn("doc_id", F.struct("doc_id", "text")), **options)

    @F.pandas_udf("string")
    def rewrite(text, spans, terms):
        import pandas as pd

        out = []
        for t, typed, risky in zip(text, spans, terms):
            t = t or ""
            edits = [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in (typed if typed is not None else [])]
            edits += [(s["start"], s["end"], "[TERM]" if s["action"] == "generalise" else "") for s in (risky if risky is not None else [])]
            parts, at = [], 0
            for start, end, put in sorted(edits):
                if start >= at:
                    parts += [t[at:start], put]
                at = max(at, end)
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out)

    return found.select("doc_id.doc_id", rewrite("doc_id.text", "spans", "terms").alias("text"))


def span_report(docs: DataFrame, **options) -> DataFrame:
    """Counts and digests of :func:`sanitise` for each row of ``docs``."""
    n_kind = [("n_" + k, T.LongType()) for k in KINDS]
    schema = T.StructType(
        [docs.schema["doc_id"], *(T.StructField(n, t) for n, t in n_kind), T.StructField("base_sha256", T.StringType()),
         T.StructField("spans", T.StringType()), T.StructField("n_terms", T.LongType())]
    )

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            rows: list[list] = [[] for _ in range(len(KINDS) + 3)]
            for typed, terms in zip(batch.column("spans").to_pylist(), batch.column("terms").to_pylist()):
                base = [(s["kind"], s["start"], s["end"]) for s in typed]
                kinds = Counter(k for k, _, _ in base)
                more = [("term", s["start"], s["end"]) for s in terms or []]
                for column, value in zip(rows, [*(kinds[k] for k in KINDS), digest(base), joined(base + more), len(more)]):
                    column.append(value)
            arrays = [pa.array(r, pa.string() if i in (len(KINDS), len(KINDS) + 1) else pa.int64()) for i, r in enumerate(rows)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=schema.names)

    return sanitise(docs, **options).mapInArrow(run, schema)

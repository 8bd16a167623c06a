"""A user's answer verifier on the executors: Arrow batches, faults kept to their row."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Ship the helper with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

VERDICT = (
    "status string, phase string, correct boolean, reason string, error_type string, "
    "parsed_reference_count int, parsed_candidate_count int"
)

# Reason texts recorded next to a status.
FAULTS = {
    "REFERENCE": "reference parsing failed",
    "CANDIDATE": "candidate parsing failed",
    "VERIFY": "symbolic verification failed",
}
UNSUPPORTED = {
    "REFERENCE": "reference parser returned an unsupported value",
    "CANDIDATE": "candidate parser returned an unsupported value",
    "VERIFY": "symbolic verifier returned a non-Boolean value",
}
UNPARSED = {
    "REFERENCE": "reference answer did not parse",
    "CANDIDATE": "candidate answer did not parse",
}


class Verifier(Protocol):
    """Parses an answer into expressions and compares two of them. Shipped to the executors by pickling."""

    name: str
    version: str | None

    def parse(self, text: str) -> Sequence[Any]: ...

    def verify(self, reference: Sequence[Any], candidate: Sequence[Any]) -> bool: ...


def _size(parsed: Any) -> int | None:
    try:
        return len(parsed)
    except TypeError:
        return None


def judge(verifier: Verifier, reference: str, candidate: str) -> tuple:
    """Status, phase reached, verdict, reason, error type and sizes of both parses; never raises."""
    sizes: list[int | None] = [None, None]
    outcome = lambda status, phase, correct=None, reason=None, error=None: (status, phase, correct, reason, error, *sizes)
    parsed = []
    for i, (phase, text) in enumerate((("REFERENCE", reference), ("CANDIDATE", candidate))):
        try:
            parsed.append(verifier.parse(text))
            size = _size(parsed[i])
        except Exception as error:
            return outcome("ERROR", phase, reason=FAULTS[phase], error=type(error).__name__)
        if size is None:
            return outcome("ERROR", phase, reason=UNSUPPORTED[phase])
        sizes[i] = size
        if not size:
            return outcome("NON_EVALUABLE", phase, reason=UNPARSED[phase])
    try:
        same = verifier.verify(*parsed)
    except Exception as error:
        return outcome("ERROR", "VERIFY", reason=FAULTS["VERIFY"], error=type(error).__name__)
    if type(same) is not bool:
        return outcome("ERROR", "VERIFY", reason=UNSUPPORTED["VERIFY"])
    return outcome("CORRECT" if same else "INCORRECT", "VERIFY", same)


def verdict_of(verifier: Verifier, reference: Column, candidate: Column) -> Column:
    """Struct of :data:`VERDICT`; NULL where either side is NULL. Equal pairs of a batch are judged once."""

    def batch(references: pd.Series, candidates: pd.Series) -> pd.DataFrame:
        known: dict[tuple[str, str], tuple] = {}
        rows = []
        for pair in zip(references, candidates):
            if pair[0] is None or pair[1] is None:
                rows.append((None,) * 7)
                continue
            if pair not in known:
                known[pair] = judge(verifier, *pair)
            rows.append(known[pair])
        frame = pd.DataFrame(rows, columns=[field.split()[0] for field in VERDICT.split(", ")])
        return frame.astype({"correct": "boolean", "parsed_reference_count": "Int32", "parsed_candidate_count": "Int32"})

    return F.pandas_udf(batch, VERDICT)(reference, candidate)

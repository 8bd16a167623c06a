"""Boxed-answer extraction (Arrow UDF) and native answer comparison."""

from __future__ import annotations

import re
import sys
from fractions import Fraction

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship the helper with the task, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARKER = r"\boxed"
EXTRACTION_SCHEMA = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("extracted_text", T.StringType()),
        T.StructField("start_offset", T.IntegerType()),
        T.StructField("end_offset", T.IntegerType()),
        T.StructField("reason", T.StringType()),
    ]
)

# Reason texts recorded next to an extraction or evaluation status.
NO_BOX = "completion contains no boxed expression"
NO_BRACE = "boxed marker is not followed by an opening brace"
NO_CLOSE = "boxed expression has no matching closing brace"
EMPTY_BOX = "boxed expression is empty"
REASONS = {
    "EXTRACTION_FAULT": "answer extraction failed",
    "NO_REFERENCE": "missing or empty reference answer",
    "NO_CANDIDATE": "missing or empty candidate answer",
    "REFERENCE_UNPARSED": "reference answer did not parse",
    "CANDIDATE_UNPARSED": "candidate answer did not parse",
    "NO_VERDICT": "symbolic verifier returned a non-Boolean value",
}

_BRACES = re.compile(r"\\.|[{}]", re.DOTALL)
_OPENER = re.compile(r"\s*\{")


def _brace_pairs(text: str) -> dict[int, int]:
    """Opening -> closing offset of every balanced unescaped brace, in one pass."""
    pairs: dict[int, int] = {}
    open_stack: list[int] = []
    for hit in _BRACES.finditer(text):
        if hit.group() == "{":
            open_stack.append(hit.start())
        elif hit.group() == "}" and open_stack:
            pairs[open_stack.pop()] = hit.start()
    return pairs


def last_boxed(text: str) -> tuple:
    """Read markers from the end: the first balanced one met wins over any malformed one."""
    pairs = None
    malformed = None
    start = text.rfind(MARKER)
    while start >= 0:
        after = start + len(MARKER)
        if not text[after : after + 1].isalpha():
            opener = _OPENER.match(text, after)
            if opener is None:
                malformed = malformed or (start, NO_BRACE)
            else:
                pairs = _brace_pairs(text) if pairs is None else pairs
                close = pairs.get(opener.end() - 1)
                if close is None:
                    malformed = malformed or (start, NO_CLOSE)
                elif text[opener.end() : close].strip():
                    return ("EXTRACTED", text[start : close + 1], start, close + 1, None)
                else:
                    return ("EMPTY_BOXED_ANSWER", None, start, close + 1, EMPTY_BOX)
        start = text.rfind(MARKER, 0, start)
    if malformed:
        return ("MALFORMED_BOXED_ANSWER", None, malformed[0], None, malformed[1])
    return ("MISSING_BOXED_ANSWER", None, None, None, NO_BOX)


def _extract_batch(texts: pd.Series) -> pd.DataFrame:
    blank = (None,) * len(EXTRACTION_SCHEMA)
    rows = [blank if text is None else last_boxed(text) for text in texts]
    frame = pd.DataFrame(rows, columns=EXTRACTION_SCHEMA.names)
    return frame.astype({"start_offset": "Int32", "end_offset": "Int32"})


def extract_boxed(text: Column) -> Column:
    """Last balanced ``\\boxed{...}``: struct of status, text, code-point offsets, reason.

    Only texts that contain the marker are sent to Python; the others are MISSING.
    """
    found = F.pandas_udf(_extract_batch, EXTRACTION_SCHEMA)(F.when(F.contains(text, F.lit(MARKER)), text))
    missing = F.struct(
        F.lit("MISSING_BOXED_ANSWER").alias("status"),
        F.lit(None).cast("string").alias("extracted_text"),
        F.lit(None).cast("int").alias("start_offset"),
        F.lit(None).cast("int").alias("end_offset"),
        F.lit(NO_BOX).alias("reason"),
    )
    return F.when(found["status"].isNotNull(), found).otherwise(missing)


def normalise_answer(answer: Column) -> Column:
    """Answer text without box wrapper, math delimiters, spacing commands and blanks."""
    trimmed = F.trim(answer)
    inner = F.regexp_replace(trimmed, r"(?s)^\\boxed\s*\{(.*)\}$", "$1")
    plain = F.regexp_replace(inner, r"\\(?:left|right)(?![a-zA-Z])|\\[!,;: ]|\\?\$", "")
    plain = F.regexp_replace(plain, r"(?<![0-9])\s+|\s+(?![0-9])", "")
    plain = F.regexp_replace(plain, r"\\[dt]frac", r"\\frac")
    plain = F.regexp_replace(plain, r"^([+-]?)\\frac\{([+-]?[0-9.]+)\}\{([+-]?[0-9.]+)\}$", "$1$2/$3")
    # Without a backslash, dollar, blank or last full stop none of these finds anything.
    return F.when(trimmed.rlike(r"[\\$\s]|\.$"), F.regexp_replace(plain, r"\.$", "")).otherwise(trimmed)


# At most 12 integer and 6 fractional digits, so that cross products stay exact; longer ones see same_long_fraction.
_NUMBER = r"[+-]?(?:[0-9]{1,12}(?:\.[0-9]{1,6})?|\.[0-9]{1,6})"
_RATIONAL = rf"^({_NUMBER})(?:/({_NUMBER}))?$"
EXACT = "decimal(18,6)"


def rational_part(normalised: Column, group: int) -> Column:
    """Numerator (1) or denominator (2) of a numeric answer; NULL if it is not numeric."""
    found = F.nullif(F.regexp_extract(normalised, _RATIONAL, group), F.lit(""))
    if group == 1:
        return found.try_cast(EXACT)
    return F.nullif(F.coalesce(found, F.lit("1")).try_cast(EXACT), F.lit(0).cast(EXACT))


_LONG_NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"
_LONG_RATIONAL = rf"^{_LONG_NUMBER}(?:/{_LONG_NUMBER})?$"


def _value(text: str) -> Fraction | None:
    above, _, below = text.partition("/")
    divisor = Fraction(below or "1")
    return Fraction(above) / divisor if divisor else None


def _same_values(left: pd.Series, right: pd.Series) -> pd.Series:
    sys.set_int_max_str_digits(0)  # answers of any length
    known: dict[str, Fraction | None] = {}
    found = []
    for pair in zip(left, right):
        if pair[0] is None or pair[1] is None:
            found.append(None)
            continue
        for text in pair:
            if text not in known:
                known[text] = _value(text)
        a, b = known[pair[0]], known[pair[1]]
        found.append(None if a is None or b is None else a == b)
    return pd.Series(found, dtype="boolean")


def same_long_fraction(left: Column, right: Column, settled: Column) -> Column:
    """Whether two numbers, one of them a fraction, are equal, for parts of any length.

    Only pairs that are numbers and not ``settled`` by decimals reach Python; NULL for all others and where a
    divisor is 0.
    """
    number = left.rlike(_LONG_RATIONAL) & right.rlike(_LONG_RATIONAL) & (F.contains(left, F.lit("/")) | F.contains(right, F.lit("/")))
    open_ = number & settled.isNull()
    return F.pandas_udf(_same_values, T.BooleanType())(F.when(open_, left), F.when(open_, right))


def canonical_number(normalised: Column) -> Column:
    """An integer or decimal of any length as sign, digits and fraction without idle zeros; else NULL.

    Two such texts are equal only if their values are, so no number of digits is too many.
    """
    pattern = r"^([+-]?)0*([0-9]*)(?:\.([0-9]*?)0*)?$"
    is_number = normalised.rlike(r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$")
    whole, part = F.regexp_extract(normalised, pattern, 2), F.regexp_extract(normalised, pattern, 3)
    sign = F.when((F.regexp_extract(normalised, pattern, 1) == "-") & (F.length(F.concat(whole, part)) > 0), "-").otherwise("")
    return F.when(is_number, F.concat(sign, whole, F.lit("."), part))

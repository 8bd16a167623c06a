"""Token-array expressions.

A token array is searched through its comma-joined text: in ``,12,2,3,`` the
needle ``,2,3,`` can only match on token boundaries, so one JVM string search
replaces an interpreted lambda over every start position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions.identity import token_hash, token_text

EMPTY_IDS = "array<int>"


def token_array(ids: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(i)) for i in ids]).cast(EMPTY_IDS)


def _needle(target: Sequence[int]) -> str:
    if not target:
        raise ValueError("target token sequence cannot be empty")
    return "," + ",".join(str(int(i)) for i in target) + ","


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def find_subsequence(tokens: Column, target: Sequence[int]) -> Column:
    """0-based start of the first exact occurrence, else NULL."""
    needle = _needle(target)
    # Text before the hit has one comma per earlier token; without a hit the whole
    # text comes back, which ends in a comma, unlike any text before a hit.
    before = F.substring_index(F.concat(F.lit(","), token_text(tokens), F.lit(",")), needle, 1)
    return bound(
        before,
        lambda text: F.when(
            ~text.endswith(","), F.length(text) - F.length(F.replace(text, F.lit(","), F.lit("")))
        ),
    )


def all_subsequence_starts(tokens: Column, target: Sequence[int]) -> Column:
    """Every 0-based start, overlaps included; the lambda runs only on rows with a hit."""
    width = len(target)
    first = int(target[0]) if width else 0
    marker = token_array(target)
    last = F.size(tokens) - width
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda i: (F.get(tokens, i) == first) & (F.slice(tokens, i + 1, F.lit(width)) == marker),
    )
    return F.when(find_subsequence(tokens, target).isNotNull(), starts).otherwise(
        F.array().cast(EMPTY_IDS)
    )


def thinking_boundary(tokens: Column, marker: Sequence[int]) -> Column:
    def found(starts: Column) -> Column:
        count = F.size(starts)
        return F.struct(
            F.get(starts, F.lit(0)).alias("first_close_marker_start"),
            count.alias("close_marker_count"),
            F.when(count == 0, "NO_CLOSE_MARKER")
            .when(count == 1, "ONE_CLOSE_MARKER")
            .otherwise("MULTIPLE_CLOSE_MARKERS")
            .alias("marker_status"),
            token_hash(token_array(marker)).alias("close_marker_sha256"),
        )

    return bound(all_subsequence_starts(tokens, marker), found)  # else searched for each use below a condition


def first_position_in(tokens: Column, ids: Sequence[int]) -> Column:
    """1-based position of the first token that is in ``ids``, else NULL."""
    hits = [F.nullif(F.array_position(tokens, F.lit(int(i)).cast("int")), F.lit(0)) for i in ids]
    if not hits:
        return F.lit(None).cast("bigint")
    return hits[0] if len(hits) == 1 else F.least(*hits)


def termination_status(tokens: Column, eos_ids: Sequence[int], max_new_tokens: int) -> Column:
    last = F.try_element_at(tokens, F.lit(-1))
    ended = F.coalesce(last.isin([int(i) for i in eos_ids]), F.lit(False))
    return (
        F.when(ended, "EOS")
        .when(F.size(tokens) >= max_new_tokens, "MAX_NEW_TOKENS")
        .otherwise("OTHER_STOP")
    )


def context_limit_exceeded(input_ids: Column, max_new_tokens: int, limit: int) -> Column:
    return F.size(input_ids) + max_new_tokens > limit


def preserves_prefix(full: Column, prefix: Column) -> Column:
    return F.slice(full, F.lit(1), F.size(prefix)) == prefix


def strip_prefix(full: Column, prefix: Column) -> Column:
    """Generated tokens after the supplied input; NULL if the input was not preserved."""
    rest = F.slice(full, F.size(prefix) + 1, F.greatest(F.size(full) - F.size(prefix), F.lit(0)))
    return F.when(preserves_prefix(full, prefix), rest)

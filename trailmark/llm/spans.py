"""Digests of spans that the queries of this subpackage share."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]


def joined(found: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def digest(found: list[Span]) -> str:
    return hashlib.sha256(joined(found).encode()).hexdigest()

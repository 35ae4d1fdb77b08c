"""Spans found in a text: filters shared by the scanners, and their written form."""

from __future__ import annotations

import hashlib

Span = tuple[int, int, str]  # start, end (exclusive), kind; in code points


def joined(spans: list[Span], order: tuple[str, ...]) -> str:
    """kind:start:end by start, then by the kind's place in ``order``, with commas between."""
    rank = {k: i for i, k in enumerate(order)}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], rank[x[2]], x[1])))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def overlaps(start: int, end: int, spans: list[Span]) -> bool:
    return any(s < end and start < e for s, e, _ in spans)

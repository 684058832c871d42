"""What span finders share: ordered span lists, their digest and their columns."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]


def ordered(spans: list[Span], kinds: list[str]) -> list[Span]:
    """By start, then kind in the order of ``kinds``."""
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(set(spans), key=lambda s: (s[1], rank[s[0]], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()

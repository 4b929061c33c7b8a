"""Spans in texts and their digests: kind, start and end in characters, end exclusive."""

from __future__ import annotations

import hashlib

Span = tuple[str, int, int]


def listed(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then by kind as listed, then by end."""
    order = {kind: i for i, kind in enumerate(kinds)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], order[s[0]], s[2])))


def digest(spans: list[Span], kinds: tuple[str, ...]) -> str:
    return hashlib.sha256(listed(spans, kinds).encode()).hexdigest()


class Marks:
    """Characters of a text that spans have taken; a look costs as much as the span looked for is long."""

    def __init__(self, size: int, spans: list[Span]) -> None:
        self.taken = bytearray(size)
        for span in spans:
            self.add(span)

    def add(self, span: Span) -> None:
        self.taken[span[1] : span[2]] = b"\x01" * (span[2] - span[1])

    def free(self, span: Span) -> bool:
        """Whether the span overlaps none of the others."""
        return self.taken.find(1, span[1], span[2]) < 0

"""Texts of an Arrow batch as flat numpy arrays: slices of bounded size, words, hashes.

Tasks stream their batches through ``slices`` so that memory follows the slice, not the partition. A
single text larger than a slice is one slice of its own; texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64
# Odd multipliers of the hashes below; any other odd constants would do.
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every value; null becomes the empty text."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES):
    """Pairs (rows of the batch, their texts in UTF-8) of about ``limit`` bytes; a batch is unpacked slice by slice."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column.cast(pa.binary())), 0).to_pylist()
        first, held = 0, 0
        for i, size in enumerate([*sizes, limit + 1]):
            if i > first and held + size > limit:
                yield batch.slice(first, i - first), as_bytes(column.slice(first, i - first))
                first, held = i, 0
            held += size


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _symbol_values(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(_STEP))


class Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=_U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, SLICE_BYTES + 4096)
            inverse = pow(_BASE, -1, 1 << 64)
            up, down = np.full(size, _BASE, dtype=_U), np.full(size, inverse, dtype=_U)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


POWERS = Powers()
BYTE_VALUES = _symbol_values(256)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for many spans at once, independent of the spans' places."""
    up, down = POWERS.get(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U))


class Words:
    """Words of a list of texts: byte spans in ``data``, text of each word, counts per text."""

    def __init__(self, texts: list[bytes], is_word: np.ndarray, gap: bytes = b" ") -> None:
        self.data = np.frombuffer(gap.join([*texts, b""]) or gap, dtype=np.uint8)
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
        self.text_start = np.concatenate([[0], np.cumsum(sizes)])
        inside = is_word[self.data]
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.text = np.searchsorted(self.text_start, self.start, side="right") - 1
        self.count = np.bincount(self.text, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.count)])

    def hashes(self, lower: bool = True) -> np.ndarray:
        symbols = LOWER[self.data] if lower else self.data
        return span_hashes(BYTE_VALUES[symbols], self.start, self.end)

    def characters(self) -> np.ndarray:
        """Number of characters before every byte of ``data`` and at its end."""
        return np.append(0, np.cumsum((self.data & 0xC0) != 0x80))


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """Lookup table that is True for bytes outside the given closed spans."""
    table = np.ones(256, dtype=bool)
    for low, high in spans:
        table[low : high + 1] = False
    return table


BLANK_SEPARATED = byte_class((0x20, 0x20), (0x09, 0x0D))
LETTERS_DIGITS = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
# Words of letters and digits before lower-casing: capitals count as letters too.
LETTERS_DIGITS_ANY_CASE = LETTERS_DIGITS.copy()
LETTERS_DIGITS_ANY_CASE[65:91] = True


def runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: group of every element, position inside its group."""
    group = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return group, np.arange(len(group)) - first[group]


def ragged(values: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of values[start : start + length] for all rows."""
    group, at = runs(length)
    return values[start[group] + at]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)

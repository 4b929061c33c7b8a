"""Byte-level BPE over arrays.

Texts become code points, code-point classes give the pre-token boundaries of the byte-level rule, and
each distinct pre-token of a slice is merged once. ``merge`` keeps all sequences in one flat array and in
every round applies each sequence's lowest-rank pair at all its places; a round costs a few array passes
whatever the number of sequences. Results of earlier slices stay in a bounded worker cache.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import numpy as np

from evisift.llm import arrays

OTHER, LETTER, NUMBER, SPACE, GAP, SPECIAL = range(6)
_GAP = (0x110000).to_bytes(4, "little")
# Characters with the Unicode property White_Space.
WHITE_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Endings that are pre-tokens of their own behind an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
CACHE_SYMBOLS = 4 << 20


@cache
def classes(specials: int) -> np.ndarray:
    table = np.zeros(0x110001 + specials, dtype=np.uint8)
    for code in range(0x110000):
        kind = unicodedata.category(chr(code))[0]
        table[code] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER
    table[list(WHITE_SPACE)] = SPACE
    table[0x110000], table[0x110001:] = GAP, SPECIAL
    return table


def _byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"]
        if model.get("type", "BPE") != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("only byte-level BPE without normaliser and prefix space")
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.special.values()]) + 1
        self.byte_id = np.array([ids[s] for s in _byte_symbols()], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([ids[a] * self.size + ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(key)
        self.pair, self.rank = key[order], order.astype(np.int64)
        self.merged = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.byte_of = np.zeros(self.size, dtype=np.int64)
        self.byte_of[self.byte_id] = np.arange(256)
        left, right = np.meshgrid(self.byte_id, self.byte_id, indexing="ij")
        self.byte_rank = self.ranks(left.ravel(), right.ravel())

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of every pair of symbols; the number of merges where there is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], len(self.pair))

    def ranks_of_bytes(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.byte_rank[self.byte_of[left] * 256 + self.byte_of[right]]


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge(symbols: np.ndarray, lengths: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols and their number for every sequence of the flat array of byte symbols.

    ``rank`` holds the rank of each symbol with its right neighbour. A merge changes two of them, so only
    those are looked up again; sequences without a pair left drop out of the arrays.
    """
    none = len(vocab.merged)
    out_length = np.zeros(len(lengths), dtype=np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    alive = np.flatnonzero(lengths > 0)
    size = lengths[alive]
    seq = np.repeat(alive, size)
    last = np.zeros(len(symbols), dtype=bool)
    last[np.cumsum(size) - 1] = True
    rank = np.full(len(symbols), none, dtype=np.int64)
    rank[:-1] = np.where(last[:-1], none, vocab.ranks_of_bytes(symbols[:-1], symbols[1:]))
    while len(alive):
        low = np.minimum.reduceat(rank, np.cumsum(size) - size)
        stop = low == none
        if stop.any():
            gone = np.repeat(stop, size)
            done.append((seq[gone], symbols[gone]))
            out_length[alive[stop]] = size[stop]
            symbols, seq, rank, last = symbols[~gone], seq[~gone], rank[~gone], last[~gone]
            alive, low, size = alive[~stop], low[~stop], size[~stop]
            if not len(alive):
                break
        hit = rank == np.repeat(low, size)
        if (hit[1:] & hit[:-1]).any():  # a pair of equal symbols in a row of three or more: every second one counts
            place = np.arange(len(hit))
            head = hit.copy()
            head[1:] &= ~hit[:-1]
            since = place - np.maximum.accumulate(np.where(head, place, 0))
            hit &= since % 2 == 0
        at = np.flatnonzero(hit)
        symbols[at] = vocab.merged[rank[at]]
        last[at] = last[at + 1]
        keep = np.ones(len(symbols), dtype=bool)
        keep[at + 1] = False
        size = size - np.add.reduceat(hit, np.cumsum(size) - size, dtype=np.int64)
        symbols, seq, rank, last = symbols[keep], seq[keep], rank[keep], last[keep]
        at = at - np.arange(len(at))
        changed = np.zeros(len(symbols), dtype=bool)
        changed[at] = changed[np.maximum(at - 1, 0)] = True
        at = np.flatnonzero(changed)
        right = np.minimum(at + 1, len(symbols) - 1)
        rank[at] = np.where(last[at], none, vocab.ranks(symbols[at], symbols[right]))
    if not done:
        return symbols[:0], out_length
    seq, symbols = (np.concatenate(x) for x in zip(*done, strict=True))
    return symbols[np.argsort(seq, kind="stable")], out_length


def pre_tokens(code: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every pre-token and class of its first character; separators are pieces too."""
    n = len(code)
    first = np.ones(n, dtype=bool)
    first[1:] = kind[1:] != kind[:-1]
    first |= kind >= GAP
    run_start = first.copy()
    blank = kind == SPACE
    text = (kind == LETTER) | (kind == NUMBER) | (kind == OTHER)
    after = np.zeros(n, dtype=bool)  # last blank of a run that has text behind it
    after[:-1] = blank[:-1] & text[1:]
    first |= after
    attached = np.zeros(n, dtype=bool)  # text that takes the blank before it along
    attached[1:] = text[1:] & (code[:-1] == 0x20)
    first &= ~attached
    single = np.flatnonzero((code == 0x27) & run_start & ~attached)
    single = single[single + 1 < n]
    single = single[kind[single + 1] == LETTER]
    if len(single):
        def char(at: np.ndarray) -> np.ndarray:
            return np.where(at < n, code[np.minimum(at, n - 1)], 0)

        a, b = char(single + 1), char(single + 2)
        for ending in ENDINGS:
            hit = (a == ord(ending[0])) & ((b == ord(ending[-1])) | (len(ending) == 1))
            at = single[hit]
            first[at + 1] = False
            rest = at + 1 + len(ending)
            rest = rest[rest < n]
            first[rest[kind[rest] == LETTER]] = True
    start = np.flatnonzero(first)
    return start, kind[start]


class Encoder:
    """Token counts and ids of whole texts, as the tokenizer file's own library gives them."""

    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.specials = list(self.vocab.special)
        self.kind = classes(len(self.specials))
        self._reset()

    def _reset(self) -> None:
        self.index: dict[int, int] = {}
        self.start = np.zeros(0, dtype=np.int64)
        self.length = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype=np.int64)

    def _codes(self, text: str, specials: list[str]) -> bytes:
        if not specials:
            return text.encode("utf-32-le")
        here, *rest = specials
        mark = (0x110001 + self.specials.index(here)).to_bytes(4, "little")
        return mark.join(self._codes(part, rest) for part in text.split(here))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece index into the cache of every pre-token, its text, and the first piece of each text."""
        present = [s for s in self.specials if any(s.encode() in t for t in texts)]
        joined = _GAP.join([self._codes(t.decode("utf-8"), present) for t in texts] + [b""])
        code = np.frombuffer(joined, dtype="<u4")
        start, kind = pre_tokens(code, self.kind[code])
        end = np.append(start[1:], len(code))
        gap = kind == GAP
        count = np.diff(np.append(0, np.flatnonzero(gap))) - np.append(0, np.ones(max(gap.sum() - 1, 0), dtype=np.int64))
        start, end, kind = start[~gap], end[~gap], kind[~gap]
        values = arrays.mix(code.astype(np.uint64) + np.uint64(1))
        piece, at, inverse = np.unique(arrays.span_hashes(values, start, end), return_index=True, return_inverse=True)
        keys = piece.tolist()
        if len(self.pool) > CACHE_SYMBOLS:
            self._reset()
        new = np.array([i for i, k in enumerate(keys) if k not in self.index], dtype=np.int64)
        if len(new):
            self._learn(code, start[at[new]], end[at[new]], kind[at[new]], [keys[i] for i in new])
        index = self.index
        known = np.array([index[k] for k in keys], dtype=np.int64)
        return known[inverse], np.repeat(np.arange(len(texts)), count), np.append(0, np.cumsum(count))

    def _learn(self, code: np.ndarray, start: np.ndarray, end: np.ndarray, kind: np.ndarray, keys: list[int]) -> None:
        size = end - start
        flat = arrays.ragged(code, start, size)
        special = np.repeat(kind == SPECIAL, size)
        plain = flat[~special]
        width = 1 + (flat >= 0x80).astype(np.int64) + (flat >= 0x800) + (flat >= 0x10000)
        raw = np.frombuffer(plain.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), dtype=np.uint8)
        width[special] = 1
        symbols = np.zeros(width.sum(), dtype=np.int64)
        own = np.repeat(special, width)
        symbols[~own] = self.vocab.byte_id[raw]
        byte_count = np.add.reduceat(width, np.cumsum(size) - size)
        merged, length = merge(symbols, np.where(kind == SPECIAL, 0, byte_count), self.vocab) if not own.any() else self._around(symbols, own, byte_count, kind)
        if own.any():
            at = np.cumsum(length) - length
            ids = np.array([self.vocab.special[s] for s in self.specials], dtype=np.int64)
            merged[at[kind == SPECIAL]] = ids[flat[special].astype(np.int64) - 0x110001]
        first = len(self.start)
        self.index.update(zip(keys, range(first, first + len(keys)), strict=True))
        self.start = np.append(self.start, len(self.pool) + np.cumsum(length) - length)
        self.length = np.append(self.length, length)
        self.pool = np.append(self.pool, merged)

    def _around(self, symbols: np.ndarray, own: np.ndarray, size: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all but the special pieces, which keep one symbol each."""
        special = kind == SPECIAL
        merged, length = merge(symbols[~own], np.where(special, 0, size), self.vocab)
        length = np.where(special, 1, length)
        out = np.zeros(length.sum(), dtype=np.int64)
        out[~np.repeat(special, length)] = merged
        return out, length

    def counts(self, texts: list[bytes]) -> np.ndarray:
        piece, text, _ = self.encode(texts)
        return np.bincount(text, weights=self.length[piece], minlength=len(texts)).astype(np.int64)

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids as one array, and the number of ids of each text."""
        piece, text, _ = self.encode(texts)
        length = self.length[piece]
        flat = arrays.ragged(self.pool, self.start[piece], length)
        return flat, np.bincount(text, weights=length, minlength=len(texts)).astype(np.int64)

"""Benchmark passages in training documents, by an FM-index per shard of documents.

A shard is a slice of a partition. Its index covers the runs of benchmark words in it, since an occurrence
can't hold any other word. All windows of the benchmark are searched at once. The benchmark is the stated
query set: it is read and broadcast in blocks of bounded size, each searched in every shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evisift.llm import arrays
from evisift.llm.fm_index import FMIndex

WINDOW = 10
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 2 << 20

REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start: long, end: long>>"


class Phrases:
    """Windows of one block of items: word hashes, and the items each window is in."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        words = arrays.Words([text for _, text in items], arrays.LETTERS_DIGITS_ANY_CASE)
        hashes = words.hashes()
        self.by_length: dict[int, tuple[np.ndarray, list[list[str]]]] = {}
        found: dict[int, dict[bytes, set[str]]] = {}
        for (item, _), first, count in zip(items, words.first[:-1].tolist(), words.count.tolist(), strict=True):
            length = min(window, count)
            for at in range(first, first + count - length + 1 if count else first):
                found.setdefault(length, {}).setdefault(hashes[at : at + length].tobytes(), set()).add(item)
        for length, windows in found.items():
            flat = np.frombuffer(b"".join(windows), dtype=np.uint64).reshape(-1, length)
            self.by_length[length] = flat, [sorted(x) for x in windows.values()]


def blocks(benchmark: DataFrame, key: str, text: str, window: int, limit: int) -> Iterator[Phrases]:
    rows = benchmark.select(F.col(key).cast("string").alias("item"), F.col(text).cast("string").alias("body"))
    held, size = [], 0
    for item, body in rows.filter("item IS NOT NULL AND body IS NOT NULL").toLocalIterator():
        raw = body.encode("utf-8")
        if held and size + len(raw) > limit:
            yield Phrases(held, window)
            held, size = [], 0
        held.append((item, raw))
        size += len(raw)
    if held:
        yield Phrases(held, window)


class Found:
    """What one shard holds: hit words and items of each document."""

    def __init__(self, texts: list[bytes], phrases: list[Phrases]) -> None:
        self.words = words = arrays.Words(texts, arrays.LETTERS_DIGITS_ANY_CASE)
        self.items: dict[int, set[str]] = {}
        edge = np.zeros(len(words.start) + 1, dtype=np.int64)
        hashes = words.hashes()
        for block in phrases:
            self._search(block, hashes, edge)
        self.hit = np.cumsum(edge[:-1]) > 0
        self.n_hit = np.bincount(words.text, weights=self.hit, minlength=len(texts)).astype(np.int64)

    def _search(self, block: Phrases, hashes: np.ndarray, edge: np.ndarray) -> None:
        if not block.by_length:
            return
        known = _known(block)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        inside = known[at] == hashes
        text = self.words.text
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (text[1:] != text[:-1])
        start = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        length = np.bincount(run[inside], minlength=len(start))
        enough = length >= min(block.by_length)
        start, length = start[enough], length[enough]
        if not len(start):
            return
        word = arrays.ragged(np.arange(len(hashes)), start, length)
        present, ids = np.unique(at[word], return_inverse=True)
        index = FMIndex(ids.astype(np.int64) + 1, length, len(present))
        for size, (windows, owners) in block.by_length.items():
            code = np.searchsorted(known, windows)
            local = np.minimum(np.searchsorted(present, code), len(present) - 1)
            possible = np.flatnonzero((present[local] == code).all(axis=1))
            if not len(possible):
                continue
            pattern, place = index.search(local[possible] + 1)
            hit = word[place]
            np.add.at(edge, hit, 1)
            np.add.at(edge, hit + size, -1)
            pairs = np.unique(np.stack([text[hit], possible[pattern]]), axis=1)
            for doc, window in pairs.T.tolist():
                self.items.setdefault(doc, set()).update(owners[window])

    def spans(self, doc: int) -> list[tuple[int, int]]:
        """Merged hit spans of a document, as bytes of its text."""
        first, last = self.words.first[doc], self.words.first[doc + 1]
        change = np.diff(self.hit[first:last].astype(np.int8), prepend=0, append=0)
        offset = self.words.text_start[doc]
        start = self.words.start[first + np.flatnonzero(change == 1)] - offset
        end = self.words.end[first + np.flatnonzero(change == -1) - 1] - offset
        return list(zip(start.tolist(), end.tolist(), strict=True))


def _known(block: Phrases) -> np.ndarray:
    if not hasattr(block, "known"):
        block.known = np.unique(np.concatenate([w.ravel() for w, _ in block.by_length.values()]))
    return block.known


def _broadcast(benchmark: DataFrame, key: str, text: str, window: int, limit: int) -> list[Broadcast]:
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(block) for block in blocks(benchmark, key, text, window, limit)]


def find_passages(
    docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Hit words and items of every document, and the merged spans to remove (characters, end exclusive).

    An item of fewer words than ``window`` is one window; items without words or id never occur. Null text has
    no words. Repeated rows give repeated results; an empty benchmark leaves every document clean.
    """
    sent = _broadcast(benchmark, item, item_text, window, block_bytes)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [b.value for b in sent]
        for rows, texts in arrays.slices(batches, "body", SHARD_BYTES):
            found = Found(texts, phrases)
            items, spans = [], []
            before = found.words.characters()
            for doc in range(len(texts)):
                own = sorted(found.items.get(doc, ()))
                items.append(own)
                offset = found.words.text_start[doc]
                spans.append([{"start": int(before[offset + a] - before[offset]), "end": int(before[offset + b] - before[offset])} for a, b in found.spans(doc)] if own else [])
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(found.words.count), pa.array(found.n_hit), pa.array([len(x) for x in items], pa.int64()),
                 pa.array(digest), pa.array(found.n_hit > 0), pa.array(items, pa.list_(pa.string())),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
            )

    return source.mapInArrow(scan, REPORT)


def remove_passages(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs``, all columns, with hit spans cut out of their texts; clean texts stay as they are.

    Cutting may bring words together that form a window anew, so a changed text is searched until it is clean.
    """
    sent = _broadcast(benchmark, item, item_text, window, block_bytes)
    column = docs.columns.index(text)
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema)])
    plain.fields[column].dataType = T.StringType()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = [b.value for b in sent]
        for rows, texts in arrays.slices(batches, f"c{column}", SHARD_BYTES):
            old = rows.column(column)
            open_texts, changed = dict(enumerate(texts)), {}
            while open_texts:
                names, bodies = list(open_texts), list(open_texts.values())
                found = Found(bodies, phrases)
                open_texts = {}
                for i in found.items:
                    kept, last = [], 0
                    for a, b in found.spans(i):
                        kept.append(bodies[i][last:a])
                        last = b
                    open_texts[names[i]] = b"".join([*kept, bodies[i][last:]])
                changed |= open_texts
            if not changed:
                yield rows
                continue
            values = [None if old[i].as_py() is None else changed.get(i, t).decode() for i, t in enumerate(texts)]
            yield rows.set_column(column, rows.schema.field(column), pa.array(values, old.type))

    numbered = docs.toDF(*plain.names).withColumn(f"c{column}", F.col(f"c{column}").cast("string"))
    return numbered.mapInArrow(cut, plain).toDF(*docs.columns)

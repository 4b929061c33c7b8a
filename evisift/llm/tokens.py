"""Token counts and packing into fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.llm import arrays
from evisift.llm.bpe import Encoder
from evisift.session import materialize

WINDOW = 2048
END_ID = 1
# Pieces that one packing task holds, about 30 MB; any number packs, more pieces only fill windows better.
BLOCK_PIECES = 1 << 18

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))


def token_counts(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Bytes and tokens of every whole text.

    Null counts as empty (0, 0). One row per input row, repeated rows included; other columns are ignored
    and may have any name. ``over_limit`` is true beyond ``limit`` tokens.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for rows, texts in arrays.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(encoder.counts(texts), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = _keyed(docs, key, text).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def cut_pieces(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Full windows of every document and the rest behind them.

    A document is its ids and then ``end_id``, so an empty or null text is one id. Only lengths and check
    sums go on; ids and texts stay in the task that reads them.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for rows, texts in arrays.slices(batches, "text"):
            flat, count = encoder.ids(texts)
            ends = np.cumsum(count)
            ids = np.insert(flat, ends, end_id).astype("<u4")
            total = count + 1
            pieces = -(-total // window)
            doc, at = arrays.runs(pieces)
            start = at * window
            length = np.minimum(total[doc] - start, window)
            first = (np.cumsum(total) - total)[doc] + start
            raw = memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, total[doc]))],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return _keyed(docs, key, text).mapInArrow(cut, PIECES)


class OpenWindows:
    """Open windows by remaining capacity; a segment tree finds the tightest that still fits.

    Leaf c counts the open windows with capacity c; an inner node counts those below it.
    """

    def __init__(self, window: int) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def put(self, window: int, capacity: int) -> None:
        self.held[capacity].append(window)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A window of the smallest capacity of at least ``need``, and that capacity."""
        node = self.leaves + need
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return self.held[capacity].pop(), capacity


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window and offset of each piece; the pieces come longest first."""
    tree, opened = OpenWindows(window), 0
    place, offset = [], []
    for length in lengths:
        found = tree.take(length)
        if found is None:
            found = opened, window
            opened += 1
        at, capacity = found
        place.append(at)
        offset.append(window - capacity)
        if capacity > length:
            tree.put(at, capacity - length)
    return place, offset


def pack(pieces: DataFrame, *, window: int = WINDOW, block: int = BLOCK_PIECES) -> DataFrame:
    """Best-fit decreasing packing of pieces of at most ``window`` ids.

    Pieces are dealt evenly into as many blocks as their number asks for; each block is packed on its own,
    so a task's memory is bounded and a block leaves at most a few windows unfilled. Ties in length go by
    document, start and check sum; repeated rows are packed like any other. ``sequence_id`` is unique over
    all blocks. ``pieces`` must give the same rows when read again (a written table does).
    """
    blocks = max(1, -(-pieces.count() // block))
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32"), F.lit(blocks)).cast("int"))

    def fill(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(tables)
        if not parts:
            return
        table = pa.Table.from_batches(parts).sort_by(
            [("block", "ascending"), ("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        )
        number, length = table["block"].to_numpy(), table["length"].to_numpy()
        edges = np.flatnonzero(np.diff(number, prepend=-1, append=-1))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            place, offset = best_fit(length[a:b].tolist(), window)
            part = table.slice(a, b - a).drop_columns(["block"])
            part = part.append_column("sequence_id", pa.array(np.array(place, dtype=np.int64) * blocks + int(number[a])))
            yield from part.append_column("offset", pa.array(offset, pa.int64())).to_batches()

    return dealt.repartitionById(blocks, "block").mapInArrow(fill, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pack whole documents: overlong ones are cut into full windows, the rests fill windows best-fit.

    No rows give no rows. A piece never spans two windows; inside a window offsets have no gaps.
    """
    return pack(materialize(cut_pieces(docs, vocabulary, key=key, text=text, window=window, end_id=end_id), "pieces"), window=window)

"""Repeated passages by content-defined chunks of lines, widened word by word.

A line ends with a line break, a sentence mark, or after the word whose rolling hash with its left neighbour is least in some window of words; so a
line holds at most ``LINE_WORDS`` words, also in prose without marks. A rolling hash over the hashes of two
neighbouring lines, least in some window of lines, ends a chunk, so a chunk holds at most ``CHUNK_LINES`` lines and a
passage is cut alike wherever it stands, but for a window at either edge. From every chunk's start a span runs to the
first chunk end that gives it ``LEAST_BYTES``. Equal spans are found by hash over the whole table; every byte that goes
is compared with that of a first occurrence; at the edges of what repeats, the neighbouring words are compared as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.llm import arrays
from evisift.session import materialize

# Words of a line and lines of a chunk, at most.
LINE_WORDS, CHUNK_LINES = 5, 6
# A span that may go has two lines or more and so many bytes, or is one line of so many.
LEAST_BYTES, LONG_BYTES = 60, 200
# Words on either side that are compared where a repeated stretch ends: as many as a chunk holds at most.
AROUND_WORDS = LINE_WORDS * CHUNK_LINES
_ROLL = np.uint64(31)
_MARKS = np.isin(np.arange(256), list(b".!?"))
_BEFORE, _BEHIND = re.compile(rb"\S+\s+"), re.compile(rb"\s+\S+")


def least_in_window(values: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Whether a value is the first least one of some ``width`` neighbours in its group; at edges windows are shorter."""
    group, _ = arrays.runs(counts)
    place = np.arange(len(values)) + (group + 1) * (width - 1)
    padded = np.full(len(values) + (len(counts) + 1) * (width - 1), np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[place] = values >> np.uint64(1)
    chosen = np.zeros(len(padded), dtype=bool)
    if len(padded) >= width:
        windows = np.lib.stride_tricks.sliding_window_view(padded, width)
        chosen[windows.argmin(axis=1) + np.arange(len(windows))] = True
    return chosen[place]


def rolled(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Hash over every value and its left neighbour, which the first of a group lacks; frequent values alone would end too much."""
    before = np.append(np.uint64(0), hashes)[:-1].copy()
    before[begin] = 0
    return arrays.mix(hashes * _ROLL + before)


class Lines:
    """Lines of a list of texts: byte spans in ``words.data`` and the text of each."""

    def __init__(self, texts: list[bytes]) -> None:
        self.words = words = arrays.Words(texts, arrays.BLANK_SEPARATED)
        breaks = np.append(0, np.cumsum(words.data == ord("\n")))
        follows = np.append(words.start[1:], len(words.data))
        ends = (breaks[follows[: len(words.end)]] > breaks[words.end]) | _MARKS[words.data[words.end - 1]]
        ends |= least_in_window(rolled(words.hashes(lower=False), words.first[:-1][words.count > 0]), words.count, LINE_WORDS)
        ends[words.first[1:][words.count > 0] - 1] = True
        last = np.flatnonzero(ends)
        self.text = words.text[last]
        self.start, self.end = words.start[np.append(0, last[:-1] + 1)[: len(last)]], words.end[last]
        self.count = np.bincount(self.text, minlength=len(texts)).astype(np.int64)

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and end in ``words.data``, and hash of every span that may go."""
        symbols = arrays.BYTE_VALUES[self.words.data]
        own = arrays.span_hashes(symbols, self.start, self.end)
        begin = np.flatnonzero(np.diff(self.text, prepend=-1))
        cut = least_in_window(rolled(own, begin), self.count, CHUNK_LINES)
        cut[np.append(begin[1:], len(own))[: len(begin)] - 1] = True
        last = np.flatnonzero(cut)
        first = np.append(0, last[:-1] + 1)[: len(last)]
        text, start, end = self.text[last], self.start[first], self.end[last]
        several = np.maximum(np.searchsorted(end, start + LEAST_BYTES), np.searchsorted(last, first + 1))
        stop = np.minimum(several, np.searchsorted(end, start + LONG_BYTES))
        fits = stop < len(last)
        fits[fits] = text[stop[fits]] == text[fits]
        start, end = start[fits], end[stop[fits]]
        return text[fits], start, end, arrays.span_hashes(symbols, start, end)


def alike(own: bytes | None, other: bytes | None, words: re.Pattern, step: int) -> int:
    """Bytes of the whole words, with their blanks, in which two contexts agree next to a span."""
    total = 0
    for a, b in zip(words.findall(own or b"")[::step], words.findall(other or b"")[::step]):
        if a != b:
            break
        total += len(a)
    return total


def _lists(column: pa.ListArray) -> tuple[pa.StructArray, np.ndarray]:
    """Elements of a list column in a row, and the number in each list."""
    return column.flatten(), np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in compressed form, as they move twice."""
    pack = zstandard.ZstdCompressor(level=3)
    for rows, texts in arrays.slices(batches, "body"):
        columns = [rows.column(0), rows.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array([pack.compress(t) for t in texts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "size", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows and their texts, so many that the texts have about ``arrays.SLICE_BYTES``."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        total = np.cumsum(np.asarray(batch.column(batch.schema.get_field_index("size"))) + 1)
        first = 0
        while first < batch.num_rows:
            reach = (total[first - 1] if first else 0) + arrays.SLICE_BYTES
            last = max(first + 1, int(np.searchsorted(total, reach, side="right")))
            rows = batch.slice(first, last - first)
            yield rows, [unpack.decompress(t) for t in rows.column(rows.schema.get_field_index("packed")).to_pylist()]
            first = last


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in arrays.slices(batches, "body"):
        lines = Lines(texts)
        text, start, end, hashes = lines.spans()
        begin, row = lines.words.text_start[text], pa.array(text)
        columns = [rows.column(0).take(row), rows.column(1).take(row), pa.array(start - begin), pa.array(end - begin), pa.array(arrays.signed(hashes))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "mark", "start", "stop", "hash"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of every repeated span; with the words around it where it is a first one or what repeats ends there."""
    names = ["doc_id", "mark", "start", "stop", "hash", "late", "before", "bytes", "behind"]
    for rows, texts in _unpacked(batches):
        hits, counts = _lists(rows.column(rows.schema.get_field_index("hits")))
        row, _ = arrays.runs(counts)
        start, stop = np.asarray(hits.field("start")), np.asarray(hits.field("stop"))
        late = np.asarray(hits.field("late").cast(pa.int8())) > 0
        words = arrays.Words(texts, arrays.BLANK_SEPARATED)
        base = words.text_start[row]
        left = np.maximum(np.searchsorted(words.start, start + base) - AROUND_WORDS, words.first[row])
        right = np.minimum(np.searchsorted(words.end, stop + base) + AROUND_WORDS, words.first[row + 1] - 1)
        left, right = words.start[left] - base, words.end[right] - base
        # late spans stand in order; where the next one begins inside, the rest is left to it, so each byte is compared once
        at = np.flatnonzero(late)
        edge_left, edge_right = ~late, ~late
        if len(at):
            border = np.flatnonzero(np.diff(row[at], prepend=-1, append=-1))[:-1]
            edge_left[at], edge_right[at] = np.append(True, stop[at][:-1] < start[at][1:]), np.append(start[at][1:] > stop[at][:-1], True)
            edge_left[at[border]] = edge_right[at[border - 1]] = True
        if len(at):
            inside = ~edge_right[at[:-1]] & (start[at[1:]] < stop[at[:-1]])
            stop = stop.copy()
            stop[at[:-1][inside]] = start[at[1:][inside]]
        body = [texts[r][s:e] for r, s, e in zip(row, start, stop)]
        before = [texts[r][s:e] if edge else None for r, s, e, edge in zip(row, left, start, edge_left)]
        behind = [texts[r][s:e] if edge else None for r, s, e, edge in zip(row, stop, right, edge_right)]
        index = pa.array(row)
        columns = [rows.column(0).take(index), rows.column(1).take(index), hits.field("start"), pa.array(stop), hits.field("hash"), hits.field("late")]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.binary()) for c in (before, body, behind))], names)


def _widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        c = batch.to_pydict()
        start = [s - alike(a, b, _BEFORE, -1) for s, a, b in zip(c["start"], c["before"], c["first_before"])]
        stop = [s + alike(a, b, _BEHIND, 1) for s, a, b in zip(c["stop"], c["behind"], c["first_behind"])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(start, pa.int64()), pa.array(stop, pa.int64())], ["doc_id", "mark", "start", "stop"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in _unpacked(batches):
        gone, counts = _lists(rows.column(rows.schema.get_field_index("gone")))
        lines = Lines(texts)
        row, _ = arrays.runs(counts)
        data = lines.words.data
        begin = lines.words.text_start
        # blanks behind what goes, up to the next word or the end of the text, go with it
        start, stop = np.asarray(gone.field("start")) + begin[row], np.asarray(gone.field("stop")) + begin[row]
        follows = np.append(lines.words.start, len(data))[np.searchsorted(lines.words.start, stop)]
        stop = np.minimum(follows, begin[row + 1] - 1)
        change = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(change, start, 1)
        np.add.at(change, stop, -1)
        keep = np.cumsum(change)[:-1] == 0
        kept = np.append(0, np.cumsum(keep))
        left = lines.text[kept[lines.end] > kept[lines.start]]
        removed = lines.count - np.bincount(left, minlength=len(texts))
        out = [data[begin[i] : begin[i] + len(t)][keep[begin[i] : begin[i] + len(t)]].tobytes() if n else t for i, (t, n) in enumerate(zip(texts, counts))]
        columns = [rows.column(0), pa.array(lines.count), pa.array(removed), pa.array(out, pa.binary()).cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "removed_lines", "text"])


def drop_repeated_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's text without passages that occur earlier, by smallest id and then by place in the text.

    Columns: ``doc_id``, ``n_lines``, ``removed_lines`` (lines of which nothing is left), ``text``. Null text counts
    as empty and has no line. Rows that repeat id and text are treated alike; a null id comes before all others. What
    goes is always a copy of words that stand earlier, so of every passage one occurrence is left; of a text that
    repeats itself, one period. Should a hash stand for two spans, that one goes which equals the first.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"))
    source = source.select("doc_id", F.xxhash64("body").alias("mark"), "body")
    places = materialize(source.mapInArrow(_places, "doc_id long, mark long, start long, stop long, hash long"), "line_spans")

    repeated = materialize(places.groupBy("hash").count().filter("count > 1").select("hash"), "repeated_hashes")
    places = materialize(places.join(repeated, "hash"), "repeated_places")
    first = places.groupBy("hash").agg(F.min(F.struct("doc_id", "mark", "start")).alias("first"))
    late = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")) & (F.col("start") == F.col("first.start")))
    hits = places.join(first, "hash").select(
        F.col("doc_id").alias("own_id"), F.col("mark").alias("own_mark"), F.struct("start", "stop", "hash", late.alias("late")).alias("hit")
    )
    hits = hits.groupBy("own_id", "own_mark").agg(F.sort_array(F.collect_set("hit")).alias("hits"))

    packed = source.mapInArrow(_packed, "doc_id long, mark long, size long, packed binary")

    def with_texts(lists: DataFrame, how: str) -> DataFrame:
        # Without the hint small tables are joined another way than large ones, and only the latter split hot keys.
        same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark"))
        return packed.join(lists.hint("merge"), same, how).drop("own_id", "own_mark")

    spans = with_texts(hits, "inner").mapInArrow(
        _contexts, "doc_id long, mark long, start long, stop long, hash long, late boolean, before binary, bytes binary, behind binary"
    )
    spans = materialize(spans, "repeated_texts")
    firsts = spans.filter("NOT late").groupBy("hash").agg(F.min(F.struct("bytes", "before", "behind")).alias("f"))
    firsts = firsts.select("hash", F.col("f.bytes").alias("first_bytes"), F.col("f.before").alias("first_before"), F.col("f.behind").alias("first_behind"))
    same = spans.filter("late").join(firsts, "hash").filter(F.startswith("first_bytes", "bytes"))
    wider = same.select("doc_id", "mark", "start", "stop", "before", "behind", "first_before", "first_behind")
    gone = wider.mapInArrow(_widened, "doc_id long, mark long, start long, stop long")
    gone = gone.groupBy(F.col("doc_id").alias("own_id"), F.col("mark").alias("own_mark")).agg(F.collect_set(F.struct("start", "stop")).alias("gone"))
    gone = materialize(gone, "gone_spans")
    return with_texts(gone, "left").mapInArrow(_without, "doc_id long, n_lines long, removed_lines long, text string")

"""Runs of words that repeat with a period, by maximal pairs.

Two places with the same words behind them and different words in front of them are a maximal pair. If its places are
``q`` words apart and ``n`` words agree, the words from the first place on have period ``q`` over ``n + q`` words, and
neither neighbour continues it. So with a bound on distance against length, maximal pairs are runs as they stand.

The pairs are found on the suffix array of a text: places are merged bottom-up into the LCP-intervals of its tree,
those with the longest common prefix first. When two intervals are merged, only neighbours in the text can form a
pair of smallest period, and only where the words on their left are of different classes. Neighbours are known from
lists of places in text order, from which the smaller side of every merge is taken out, last merge first.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.llm import arrays

LEAST_WORDS, LEAST_PERIODS = 6, 4
RUNS = "array<struct<start: long, length: long, period: long>>"

Run = tuple[int, int, int]


def suffix_order(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places sorted by the words from there to the end of their text; texts stay apart. Ties don't occur.

    ``ids`` are the words of several texts in a row, ``doc`` their texts in ascending order. Sorted lengths double
    from round to round; places already alone in their group are left out.
    """
    n = len(ids)
    order = np.lexsort((ids, doc))
    fresh = np.empty(n, dtype=bool)
    fresh[:1] = True
    fresh[1:] = (np.diff(ids[order]) != 0) | (np.diff(doc[order]) != 0)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    last = np.searchsorted(doc, doc, side="right")
    length = 1
    # places in the order that share their group with another one
    many = np.flatnonzero(~fresh | np.append(~fresh[1:], False))
    while len(many):
        place = order[many]
        group = rank[place]
        behind = place + length
        inside = behind < last[place]
        second = np.where(inside, rank[np.minimum(behind, n - 1)] + 1, 0)
        by = np.lexsort((second, group))
        place, group, second = place[by], group[by], second[by]
        order[many] = place
        new = np.empty(len(many), dtype=bool)
        new[0] = True
        new[1:] = (np.diff(group) != 0) | (np.diff(second) != 0)
        rank[place] = np.maximum.accumulate(np.where(new, many, 0))
        many = many[~new | np.append(~new[1:], False)]
        length *= 2
    return order


def common_prefixes(ids: np.ndarray, doc: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Number of words that agree from each pair of places on, inside their text."""
    up, down = arrays.POWERS.get(len(ids) + 1)
    total = np.zeros(len(ids) + 1, dtype=np.uint64)
    np.cumsum(arrays.mix(ids.astype(np.uint64) + np.uint64(1)) * up[: len(ids)], out=total[1:])
    end = np.searchsorted(doc, doc[first], side="right")
    room = end - np.maximum(first, second)
    agreed = np.zeros(len(first), dtype=np.int64)
    step = 1 << int(room.max(initial=1)).bit_length()
    while step:
        may = np.flatnonzero(agreed + step <= room)
        a, b = first[may] + agreed[may], second[may] + agreed[may]
        same = (total[a + step] - total[a]) * down[a] == (total[b + step] - total[b]) * down[b]
        agreed[may[same]] += step
        step >>= 1
    return agreed


def merges(prefix: list[int]) -> list[tuple[int, int, int, int]]:
    """Intervals of the suffix order merged bottom-up, longest common prefix first: (prefix, low, middle, high).

    ``prefix[i]`` is common to the places i and i + 1 of the order; the parts [low, middle) and [middle, high) become one.
    """
    low, high = list(range(len(prefix) + 1)), list(range(1, len(prefix) + 2))
    out = []
    for i in sorted(range(len(prefix)), key=prefix.__getitem__, reverse=True):
        a, b = low[i], high[i + 1]  # of the parts that end at i and begin at i + 1
        out.append((prefix[i], a, i + 1, b))
        high[a], low[b - 1] = b, a
    return out


def interval_runs(places: list[int], prefix: list[int], left: list[int], least: int, periods: int) -> list[Run]:
    """Runs (start, length, period) of one group of places with a common prefix, in suffix order.

    ``left[i]`` is the class of the word before ``places[i]``, -1 at the beginning of the text.
    """
    by_text = sorted(range(len(places)), key=places.__getitem__)
    after, before = [-1] * len(places), [-1] * len(places)
    for x, y in zip(by_text, by_text[1:], strict=False):
        after[x], before[y] = y, x
    found = []
    for agreed, low, middle, high in reversed(merges(prefix)):
        part = range(low, middle) if middle - low < high - middle else range(middle, high)
        for x in part:
            for y in (before[x], after[x]):
                if y < 0 or y in part or left[x] == left[y]:
                    continue
                start, period = min(places[x], places[y]), abs(places[x] - places[y])
                if agreed + period >= max(least, periods * period):
                    found.append((start, agreed + period, period))
        ordered = sorted(part, key=places.__getitem__)
        for x in ordered:  # taken out of the merged list
            a, b = before[x], after[x]
            if a >= 0:
                after[a] = b
            if b >= 0:
                before[b] = a
        for x in ordered:
            before[x] = after[x] = -1
        for x, y in zip(ordered, ordered[1:], strict=False):
            after[x], before[y] = y, x
    return found


def find_in(ids: np.ndarray, doc: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[Run]:
    """Runs of all texts of a slice, starts counted over the slice, by start and then period."""
    # A pair agrees in least - 1 words at period 1 and in (periods - 1) * period beyond.
    shared = min(least - 1, *(max(least - q, (periods - 1) * q) for q in range(1, least + 1)))
    if len(ids) <= shared:
        return []
    order = suffix_order(ids, doc)
    # most neighbours in the order differ soon: only those whose first words agree are measured
    near = np.flatnonzero((doc[order[1:]] == doc[order[:-1]]) & (ids[order[1:]] == ids[order[:-1]]))
    agreed = np.zeros(len(order), dtype=np.int64)
    agreed[near] = common_prefixes(ids, doc, order[near], order[near + 1])
    joined = agreed >= shared
    edge = np.diff(joined.astype(np.int8), prepend=0)
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
    if not len(begin):
        return []
    # no run without two places of a group near each other for its longest common prefix
    sizes = stop - begin
    group, _ = arrays.runs(sizes)
    member = arrays.ragged(order, begin, sizes)
    by = np.lexsort((member, group))
    gaps = np.diff(member[by])
    gaps[np.diff(group[by]) != 0] = len(ids)
    first = np.cumsum(sizes) - sizes
    nearest = np.minimum.reduceat(np.append(gaps, len(ids)), first)
    longest = np.maximum.reduceat(agreed, np.stack([begin, stop - 1], axis=1).ravel())[::2]
    worth = np.flatnonzero(nearest + longest >= periods * nearest)
    left = np.empty(len(ids), dtype=np.int64)
    left[0], left[1:] = -1, np.where(doc[1:] == doc[:-1], ids[:-1], -1)
    found: dict[tuple[int, int], int] = {}
    for g in worth.tolist():
        places = order[begin[g] : stop[g]]
        for start, length, period in interval_runs(places.tolist(), agreed[begin[g] : stop[g] - 1].tolist(), left[places].tolist(), least, periods):
            at = start, length
            found[at] = min(period, found.get(at, period))
    return sorted((start, length, period) for (start, length), period in found.items())


def find_runs(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS
) -> DataFrame:
    """Runs of every whole text and the text without their repetitions.

    Columns: ``doc_id``, ``n_words``, ``runs`` (start, length and smallest period in words, by start and period) and
    ``collapsed``: the words that no run contains behind its first period, joined by one blank. A run has at least ``least``
    words and ``periods`` periods; words are separated by blanks. Null text is empty; one row per input row, repeated
    rows and null ids included; other columns are ignored and may have any name. A text takes about 200 bytes of memory a word.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in arrays.slices(batches, "text"):
            words = [t.split() for t in texts]
            known: defaultdict[bytes, int] = defaultdict(count().__next__)
            counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            ids = np.fromiter((known[w] for of in words for w in of), dtype=np.int64, count=int(counts.sum()))
            doc, _ = arrays.runs(counts)
            first = np.cumsum(counts) - counts
            runs = find_in(ids, doc, least, periods)
            of = doc[np.array([r[0] for r in runs], dtype=np.int64)] if runs else np.zeros(0, dtype=np.int64)
            drop: dict[int, np.ndarray] = {}
            for d, (start, length, period) in zip(of.tolist(), runs, strict=True):
                gone = drop.setdefault(d, np.zeros(len(words[d]), dtype=bool))
                gone[start - first[d] + period : start - first[d] + length] = True
            for d, gone in drop.items():
                words[d] = [w for w, out in zip(words[d], gone.tolist(), strict=True) if not out]
            collapsed = pa.array([b" ".join(of) for of in words], pa.binary()).cast(pa.string())
            table = np.array(runs, dtype=np.int64).reshape(-1, 3)
            table[:, 0] -= first[of]
            fields = [pa.array(table[:, i]) for i in range(3)]
            offsets = np.append(0, np.cumsum(np.bincount(of, minlength=len(words)))).astype(np.int32)
            listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts), listed, collapsed], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(find, f"doc_id long, n_words long, runs {RUNS}, collapsed string")

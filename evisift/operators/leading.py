"""Scores and leaders of many patterns at a time, with numpy on Arrow batches; Spark joins, partitions and sorts the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa

TOLD = "pattern long, candidate boolean, amount double, gaps array<short>, value array<double>, climb array<double>, code array<byte>"
LEADERS = "pattern long, candidate_count long, leaders array<struct<s: long, value: double>>"
SUPPORT = "pattern long, s array<long>, ic array<double>"
VOTES = "pattern long, s long, value double, evaluated long, candidate_count long"
REPEATED = "s long, cases long, value double, evaluated long, scored boolean, plus long, minus long"
TOTALS = "pattern long, pairs long, total double, best double"
# Pairs of a subject and a node looked up at a time.
STEP = 1 << 20
# Subjects of one pattern that are held before those that repeat are joined.
HELD = 1 << 22
NOT_A_CANDIDATE = -1.0
NEAR = 1e-8
# Numbers in order travel as their differences in two bytes; the largest code adds ``ESCAPE`` and stands for no number.
ESCAPE = (1 << 16) - 1


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the number in each row."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.diff(offsets)


def _numbers(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of lists that came as gaps, ``sizes`` codes each, and how many each list has."""
    gaps = codes.astype(np.int64) + (1 << 15)
    ends = np.cumsum(sizes)
    sums = np.append(0, np.cumsum(gaps))
    told = gaps != ESCAPE
    numbers = (sums[1:] - np.repeat(sums[ends - sizes], sizes))[told]
    return numbers, np.diff(np.append(0, np.append(0, np.cumsum(told))[ends]))


def _coded(values: np.ndarray, sizes: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
    """Lists as their distinct values and a byte per place; no bytes where a list has one value or more than bytes can name."""
    ends = np.cumsum(sizes)
    full = np.flatnonzero(sizes)
    starts = (ends - sizes)[full]
    kinds = np.minimum(sizes, 1)
    if len(full):
        several = np.zeros(len(sizes), bool)
        several[full] = np.maximum.reduceat(values, starts) > np.minimum.reduceat(values, starts)
        mine = np.flatnonzero(np.repeat(several, sizes))
        row = np.repeat(np.arange(len(sizes)), sizes)[mine]
        order = np.lexsort((values[mine], row))
        fresh = np.append(True, (np.diff(values[mine][order]) != 0) | (np.diff(row[order]) != 0))[: len(mine)]
        kinds[several] = np.bincount(row[order][fresh], minlength=len(sizes))[several]
    named = (kinds > 1) & (kinds <= 256)
    whole = kinds > 256
    kinds[whole] = sizes[whole]
    places = np.cumsum(kinds) - kinds
    table = np.empty(int(kinds.sum()))
    table[places[full]] = values[starts]
    code = np.zeros(len(values), np.uint8)
    if named.any():
        known = named[row[order]]
        rank = np.cumsum(fresh) - 1
        rank -= np.repeat(rank[np.flatnonzero(np.append(True, np.diff(row[order]) != 0))], np.bincount(row[order])[np.unique(row)])
        code[mine[order[known]]] = rank[known]
        table[places[row[order][known]] + rank[known]] = values[mine[order[known]]]
    for i in np.flatnonzero(whole):
        table[places[i] : places[i] + sizes[i]] = values[ends[i] - sizes[i] : ends[i]]
    return _lists(table, kinds), _lists(code[np.repeat(named, sizes)].view(np.int8), np.where(named, sizes, 0))


def _decoded(table: np.ndarray, kinds: np.ndarray, codes: np.ndarray, n_codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """What ``_coded`` was given, ``sizes`` values a list; zero for lists without any."""
    own = np.cumsum(kinds) - kinds
    place = np.repeat(np.where(kinds > 0, own, len(table)), sizes)
    place[np.repeat(n_codes > 0, sizes)] += codes.view(np.uint8)
    whole = np.repeat((n_codes == 0) & (kinds > 1), sizes)
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    place[whole] += (np.arange(len(place)) - starts)[whole]
    return np.append(table, 0.0)[place]


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values))


def _slices(costs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows that cost about ``STEP`` together, at least one row each."""
    ends = np.cumsum(costs)
    start = 0
    while start < len(costs):
        done = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + STEP, side="right")))
        yield start, end
        start = end


def _climbs(rows: pa.RecordBatch, n_words: int) -> np.ndarray:
    """Per row and subject of its list the sum of the best informative nodes of the row's chains that the subject lies under."""
    words, _ = _flat(rows["words"])
    n_rare, sizes = _flat(rows["n_rare"])
    rare, n_rare = _numbers(_flat(rows["rare"])[0], n_rare)
    slots, n_slots = _flat(rows["slots"])
    ic, _ = _flat(rows["ic"])
    chain_sizes, _ = _flat(rows["chain_sizes"])
    row = np.repeat(np.arange(len(sizes)), sizes)
    subject = np.repeat(np.arange(len(row)), n_slots[row])
    ends = np.cumsum(n_slots[row])
    place = np.arange(len(subject)) - np.repeat(ends - n_slots[row], n_slots[row]) + (np.cumsum(n_slots) - n_slots)[row[subject]]
    slot = slots[place].astype(np.int64)
    under = np.zeros(len(slot), bool)
    bit = np.flatnonzero(slot >= 0)
    under[bit] = (words[subject[bit] * n_words + (slot[bit] >> 6)] >> (slot[bit] & 63)) & 1
    if len(rare):
        number = np.flatnonzero(slot < 0)
        keys = (np.repeat(np.arange(len(row)), n_rare) << 32) + rare
        asked = (subject[number] << 32) - slot[number] - 1
        under[number] = keys[np.minimum(np.searchsorted(keys, asked), len(keys) - 1)] == asked
    total = np.zeros(len(row))
    if len(slot):
        chain = np.repeat(np.arange(len(chain_sizes)), chain_sizes)[place]
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(chain) != 0) | (np.diff(subject) != 0)]))
        best = np.maximum.reduceat(np.where(under, ic[place], 0.0), starts)
        total = np.bincount(subject[starts], weights=best, minlength=len(row))
    return total


def told_by_lists(n_words: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a pattern and a list that makes candidates, as ``TOLD``: what the list adds to each subject, and its climb."""

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, n_slots = _flat(batch["n_rare"])[1], _flat(batch["slots"])[1]
            for start, end in _slices(sizes * (n_slots + 1)):
                rows = batch.slice(start, end - start)
                each = sizes[start:end]
                table, codes = _coded(_climbs(rows, n_words) / np.repeat(rows["n_present"].to_numpy(), each), each)
                columns = [rows["pattern"], pa.array(np.ones(len(each), bool)), rows["factor"], rows["gaps"]]
                columns += [_lists(np.zeros(0), np.zeros(len(each), np.int64)), table, codes]
                yield pa.RecordBatch.from_arrays(columns, ["pattern", "candidate", "amount", "gaps", "value", "climb", "code"])

    return told


def _leaders(rows: pa.RecordBatch, limit: int) -> pa.RecordBatch:
    s, sizes = _flat(rows["s"])
    value, climb = _flat(rows["value"])[0], _flat(rows["climb"])[0]
    pattern = np.repeat(rows["pattern"].to_numpy(), sizes)
    order = np.lexsort((s, pattern))
    s, pattern, value, climb = s[order], pattern[order], value[order], climb[order]
    if len(s):
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(s) != 0) | (np.diff(pattern) != 0)]))
        s, pattern, climb = s[starts], pattern[starts], np.maximum.reduceat(climb, starts)
        value = np.add.reduceat(value, starts) + climb
    kept = np.flatnonzero(climb >= 0)
    kept = kept[np.lexsort((-value[kept], pattern[kept]))]
    s, pattern, value = s[kept], pattern[kept], value[kept]
    starts = np.flatnonzero(np.concatenate([[True], np.diff(pattern) != 0])) if len(s) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(s)))
    floor = value[starts + np.minimum(counts, limit) - 1] - NEAR
    near = value >= np.repeat(floor, counts)
    columns = [pattern[near], s[near], value[near], np.repeat(counts, counts)[near]]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pattern", "s", "value", "candidate_count"])


def _by_pattern(done: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``done`` over rows that come pattern by pattern, each pattern's rows together."""

    def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            pattern = batch["pattern"].to_numpy()
            # the last pattern may go on in the next batch
            last = int(np.searchsorted(pattern, pattern[-1]))
            if last or (held and held[0]["pattern"][-1] != batch["pattern"][0]):
                yield done(_joined([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield done(_joined(held))

    return best


def leaders_of_lists(limit: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (pattern, s, value, climb) that come pattern by pattern, added up: of each pattern the ``limit`` best candidates and all
    that come near the last of them as (pattern, s, value, candidate_count)."""
    return _by_pattern(lambda rows: _leaders(rows, limit))


def _untold(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Rows as ``TOLD`` with subjects, values and climbs as numbers."""
    s, sizes = _numbers(*_flat(rows["gaps"]))
    value = np.repeat(rows["amount"].to_numpy(), sizes)
    own, n_own = _flat(rows["value"])
    value[np.repeat(n_own > 0, sizes)] *= own
    climb = _decoded(*_flat(rows["climb"]), *_flat(rows["code"]), sizes)
    climb[~np.repeat(rows["candidate"].to_numpy(zero_copy_only=False), sizes)] = NOT_A_CANDIDATE
    return pa.RecordBatch.from_arrays([rows["pattern"], *(_lists(c, sizes) for c in (s, value, climb))], ["pattern", "s", "value", "climb"])


def leaders_of_told(limit: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same from rows as ``TOLD``; a pattern's leaders are one row, as ``LEADERS``."""

    def best(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = _leaders(_untold(rows), limit)
        pattern = found["pattern"].to_numpy()
        starts = np.flatnonzero(np.append(True, np.diff(pattern) != 0)) if len(pattern) else np.zeros(0, np.int64)
        leaders = pa.StructArray.from_arrays([found["s"], found["value"]], ["s", "value"])
        offsets = pa.array(np.append(starts, len(pattern)), pa.int32())
        columns = [found["pattern"].take(pa.array(starts)), found["candidate_count"].take(pa.array(starts)), pa.ListArray.from_arrays(offsets, leaders)]
        return pa.RecordBatch.from_arrays(columns, ["pattern", "candidate_count", "leaders"])

    return _by_pattern(best)


def _voted(rows: pa.RecordBatch, weights: dict[int, float], unlisted: float) -> dict[str, np.ndarray]:
    """Votes of the lists (pattern, seen, s, code) added up per pattern and subject; ``unlisted`` weight NaN leaves a family out of the value."""
    s, sizes = _flat(rows["s"])
    code, _ = _flat(rows["code"])
    row = np.repeat(np.arange(len(sizes)), sizes)
    pattern, family = rows["pattern"].to_numpy()[row], code >> 1
    vote = np.where((code & 1 == 1) == rows["seen"].to_numpy(zero_copy_only=False)[row], 1.0, -1.0)
    order = np.lexsort((family, s, pattern))
    row, s, pattern, family, vote = row[order], s[order], pattern[order], family[order], vote[order]
    if not len(s):
        none = np.zeros(0, np.int64)
        return {c: none for c in ("row", "pattern", "s", "evaluated", "plus", "minus")} | {"value": np.zeros(0)}
    names, place = np.unique(family, return_inverse=True)
    weight = np.array([weights.get(int(f), unlisted) for f in names])[place]
    counts = ~np.isnan(weight)
    own = np.append(True, (np.diff(s) != 0) | (np.diff(pattern) != 0))
    each = np.flatnonzero(own | np.append(True, np.diff(family) != 0))
    mean = np.add.reduceat(vote, each) / np.diff(np.append(each, len(s)))
    starts = np.flatnonzero(own)
    inner = np.searchsorted(each, starts)
    w = np.nan_to_num(weight[each])
    total, whole = np.add.reduceat(mean * w, inner), np.add.reduceat(w, inner)
    value = np.divide(total, whole, out=np.full(len(total), np.nan), where=whole > 0)
    return {
        "row": row[starts], "pattern": pattern[starts], "s": s[starts].astype(np.int64), "value": value, "evaluated": np.diff(np.append(starts, len(s))),
        "plus": np.add.reduceat((counts & (vote > 0)).astype(np.int64), starts), "minus": np.add.reduceat((counts & (vote < 0)).astype(np.int64), starts),
    }


def leaders_of_votes(weights: dict[int, float], unlisted: float, limit: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each pattern the ``limit`` best subjects by value, votes and number, as ``VOTES``.

    Values near the last place are kept, as they are rounded later; equal ones go by votes and number here already.
    """

    def best(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = _voted(rows, weights, unlisted)
        kept = np.flatnonzero(~np.isnan(found["value"]))
        kept = kept[np.lexsort((found["s"][kept], -found["evaluated"][kept], -found["value"][kept], found["pattern"][kept]))]
        pattern, value = found["pattern"][kept], found["value"][kept]
        starts = np.flatnonzero(np.append(True, np.diff(pattern) != 0)) if len(kept) else np.zeros(0, np.int64)
        counts = np.diff(np.append(starts, len(kept)))
        floor = np.repeat(value[starts + np.minimum(counts, limit) - 1], counts)
        equal = np.flatnonzero(np.append(True, (np.diff(value) != 0) | (np.diff(pattern) != 0))) if len(kept) else starts
        place = np.arange(len(kept)) - np.repeat(equal, np.diff(np.append(equal, len(kept))))
        near = (value >= floor - NEAR) & (place < limit)
        columns = [pattern, found["s"][kept], value, found["evaluated"][kept], np.repeat(counts, counts)]
        return pa.RecordBatch.from_arrays([pa.array(c[near]) for c in columns], ["pattern", "s", "value", "evaluated", "candidate_count"])

    return _by_pattern(best)


def repeated_votes(weights: dict[int, float], unlisted: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The subjects of a pattern with several votes, as ``REPEATED``: with the value of all and the numbers of single votes that it replaces."""

    def repeated(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = _voted(rows, weights, unlisted)
        kept = np.flatnonzero(found["evaluated"] > 1)
        scored = ~np.isnan(found["value"][kept])
        columns = [found["s"][kept], rows["cases"].to_numpy()[found["row"][kept]], np.nan_to_num(found["value"][kept]), found["evaluated"][kept], scored]
        columns += [found["plus"][kept], found["minus"][kept]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["s", "cases", "value", "evaluated", "scored", "plus", "minus"])

    return _by_pattern(repeated)


_KINDS = [np.dtype(k) for k in ("u1", "<u2", "<u4", "<u8")]


def _pack(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs, after a byte that says how many."""
    top = int(numbers.max()) if len(numbers) else 0
    kind = next(k for k in _KINDS if top < 1 << (8 * k.itemsize))
    return bytes([kind.itemsize]) + numbers.astype(kind).tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, next(k for k in _KINDS if k.itemsize == packed[0]), offset=1).astype(np.int64)


def packed_lists(*kept: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Array columns but the ``kept`` ones as bytes; ``of`` is in order and becomes its differences."""

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, columns = list(batch.schema.names), list(batch.columns)
            for i, name in enumerate(names):
                if name not in kept:
                    values, sizes = _flat(columns[i])
                    lists = np.split(values.astype(np.int64), np.cumsum(sizes)[:-1]) if len(sizes) else []
                    columns[i] = pa.array([_pack(np.diff(x, prepend=0) if name == "of" else x) for x in lists], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names)

    return packed


def _held_twice(rows: pa.RecordBatch) -> pa.RecordBatch:
    s, sizes = _flat(rows["s"])
    pattern = np.repeat(rows["pattern"].to_numpy(), sizes)
    order = np.lexsort((s, pattern))
    s, pattern = s[order].astype(np.int64), pattern[order]
    starts = np.flatnonzero(np.append(True, (np.diff(s) != 0) | (np.diff(pattern) != 0))) if len(s) else np.zeros(0, np.int64)
    times = np.diff(np.append(starts, len(s)))
    twice = times > 1
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (pattern[starts][twice], s[starts][twice], times[twice])], ["pattern", "s", "times"])


# Of lists (pattern, s) that come pattern by pattern the subjects that several of a pattern's lists hold: pattern, s, times.
held_twice = _by_pattern(_held_twice)


def by_variation(sums: dict[str, np.ndarray], matched: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which options some but not all matched subjects document, and what orders them, largest first."""
    documented = sums["documented"]
    return (documented > 0) & (documented < matched), [np.minimum(documented, matched - documented), documented]


def by_opposition(sums: dict[str, np.ndarray], matched: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    positive, negative = sums["positive"], sums["negative"]
    return (positive > 0) & (negative > 0), [np.minimum(positive, negative), sums["documented"]]


def options_of_lists(names: list[str], order: Callable) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (pattern, factor, size, packed of and ``names``, deepest) that come pattern by pattern, added up: of each pattern
    the ``deepest`` first options as (pattern, of, matched, ``names``), by ``order`` and then by number."""

    def lists(column: pa.Array) -> list[np.ndarray]:
        return [_unpacked(x) if x else np.zeros(0, np.int64) for x in column.to_pylist()]

    def best(rows: pa.RecordBatch) -> pa.RecordBatch:
        patterns, factor = rows["pattern"].to_numpy(), rows["factor"].to_numpy()
        each, place = np.unique(patterns, return_inverse=True)
        matched = np.bincount(place, weights=rows["size"].to_numpy()).astype(np.int64)
        deepest = np.zeros(len(each), np.int64)
        deepest[place] = rows["deepest"].to_numpy()
        of = [np.cumsum(x) for x in lists(rows["of"])]
        row = np.repeat(np.arange(len(of)), [len(x) for x in of])
        of, group = np.concatenate(of), place[row]
        sums = {c: np.concatenate(lists(rows[c])) * factor[row] for c in names}
        by = np.lexsort((of, group))
        of, group = of[by], group[by]
        starts = np.flatnonzero(np.append(True, (np.diff(of) != 0) | (np.diff(group) != 0))) if len(of) else np.zeros(0, np.int64)
        sums = {c: np.add.reduceat(x[by], starts) if len(of) else x for c, x in sums.items()}
        of, group = of[starts], group[starts]
        fit, keys = order(sums, matched[group])
        kept = np.flatnonzero(fit)
        kept = kept[np.lexsort((of[kept], *(-k[kept] for k in reversed(keys)), group[kept]))]
        counts = np.bincount(group[kept], minlength=len(each))
        rank = np.arange(len(kept)) - np.repeat(np.cumsum(counts) - counts, counts)
        kept = kept[rank < deepest[group[kept]]]
        columns = [each[group[kept]], of[kept], matched[group[kept]], *(sums[c][kept] for c in names)]
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["pattern", "of", "matched", *names])

    def in_slices(rows: pa.RecordBatch) -> pa.RecordBatch:
        firsts = np.flatnonzero(np.append(True, np.diff(rows["pattern"].to_numpy()) != 0))
        sizes = np.add.reduceat(np.array([len(x or b"") for x in rows["of"].to_pylist()]), firsts)
        ends = np.append(firsts, rows.num_rows)
        return _joined([best(rows.slice(ends[a], ends[b] - ends[a])) for a, b in _slices(sizes)])

    return _by_pattern(in_slices)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(batches).combine_chunks()
    return whole.to_batches()[0] if whole.num_rows else batches[0]


def supported_by_lists(n_words: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a pattern of one finding and a list, as ``SUPPORT``: the list's subjects that anything informative supports, and how much.

    ``own`` is what every subject of the list has at least.
    """

    def supported(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, n_slots = (_flat(batch[c])[1] for c in ("n_rare", "slots"))
            for start, end in _slices(sizes * (n_slots + 1)):
                rows = batch.slice(start, end - start)
                each = sizes[start:end]
                ic = np.maximum(_climbs(rows, n_words), np.repeat(rows["own"].to_numpy(), each))
                kept = ic > 0
                counts = np.bincount(np.repeat(np.arange(len(each)), each)[kept], minlength=len(each))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
                columns = [_numbers(*_flat(rows["gaps"]))[0][kept], ic[kept]]
                yield pa.RecordBatch.from_arrays([rows["pattern"], *(pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns)], ["pattern", "s", "ic"])

    return supported


def _best_of_each(s: np.ndarray, ic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every subject once, with its largest value."""
    order = np.argsort(s, kind="stable")
    s, ic = s[order], ic[order]
    starts = np.flatnonzero(np.append(True, np.diff(s) != 0)) if len(s) else np.zeros(0, np.int64)
    return s[starts], np.maximum.reduceat(ic, starts) if len(s) else ic


def totals_of_support(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as ``SUPPORT`` that come pattern by pattern: of each pattern its subjects, the sum and the largest of their values, as ``TOTALS``."""
    current, held, size = None, [], 0

    def total() -> pa.RecordBatch:
        _, ic = _best_of_each(*(np.concatenate(c) for c in zip(*held)))
        columns = [pa.array([current]), pa.array([len(ic)]), pa.array([float(ic.sum())]), pa.array([float(ic.max())])]
        return pa.RecordBatch.from_arrays(columns, ["pattern", "pairs", "total", "best"])

    for batch in batches:
        pattern = batch["pattern"].to_numpy()
        starts = np.flatnonzero(np.append(True, np.diff(pattern) != 0)) if len(pattern) else []
        for start, end in zip(starts, [*starts[1:], len(pattern)]):
            if pattern[start] != current:
                if size:
                    yield total()
                current, held, size = pattern[start], [], 0
            rows = batch.slice(start, end - start)
            held.append((_flat(rows["s"])[0], _flat(rows["ic"])[0]))
            size += len(held[-1][0])
            if sum(len(s) for s, _ in held[1:]) > HELD:
                held = [_best_of_each(*(np.concatenate(c) for c in zip(*held)))]
    if size:
        yield total()

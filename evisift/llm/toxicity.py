"""Toxicity by misspelling-tolerant terms and the windows they stand in.

Terms are whole words and word stems that stand out in toxic training texts. Their trie is intersected with a
Levenshtein automaton once, on the driver, into one deterministic table: a state is the set of (trie node, edits)
pairs that a prefix can be in. Words of a text then run through the table in lock-step, so a misspelled term costs
no more than a known one; ordinary words of the training texts are no misspellings. Hits are scored with the words around them: quotation marks, words of reporting, negation
and address shift the weight that a small logistic model has learned for a hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.llm import arrays
from evisift.llm.labelled import FIT_ROWS, fold, labelled_texts
from evisift.session import materialize

FOLDS, HELD_OUT = 5, 0
# Stems are word beginnings of these lengths in bytes.
STEM_FROM, STEM_TO = 3, 12
# Terms of the lexicon, the least texts a term is found in, and the least share of toxic ones among them.
TERMS, LEAST_TEXTS, LEAST_SHARE = 256, 8, 0.75
# One edit is allowed in whole words of this many bytes or more; stems and shorter words must match.
EDIT_FROM = 5
WINDOW = 5
# Words before a hit that report speech, deny, or address somebody.
REPORTING = "said says wrote called quote quoted reported dijo escribió sagte schrieb dit écrit".split()
DENYING = "not never no isn't nicht kein nie pas jamais nunca".split()
ADDRESS = "you your you're u du dein ihr tu ton vous tú usted".split()

_WORD = arrays.LETTERS_DIGITS_ANY_CASE


class TermAutomaton:
    """Deterministic table for all terms at once, each with its allowed edits.

    ``final[state]`` is 0 or one more than the term of a whole word, ``stem[state]`` likewise for a prefix that is
    a stem. A swap of neighbours counts as one edit, like a replacement, insertion or deletion.
    """

    def __init__(self, terms: list[tuple[bytes, bool]]) -> None:
        alphabet = sorted({b for term, _ in terms for b in term})
        self.symbol = np.full(256, len(alphabet), dtype=np.int64)
        self.symbol[alphabet] = np.arange(len(alphabet))
        children: list[dict[int, int]] = [{}]
        whole: dict[int, int] = {}
        stems: dict[int, int] = {}
        deep: list[int] = [0]  # node: whether a term of the node's subtree may be misspelled
        for number, (term, stem) in enumerate(terms, 1):
            node = 0
            for b in term:
                s = int(self.symbol[b])
                if s not in children[node]:
                    children[node][s] = len(children)
                    children.append({})
                    deep.append(0)
                node = children[node][s]
                if not stem and len(term) >= EDIT_FROM:
                    deep[node] = 1
            (stems if stem else whole)[node] = number
        deep[0] = int(any(deep))
        edits = {node: 1 if deep[node] else 0 for node in range(len(children))}
        long_term = {number: not stem and len(term) >= EDIT_FROM for number, (term, stem) in enumerate(terms, 1)}

        def close(state: set[tuple[int, int, int]]) -> frozenset:
            """Add what is reached by deleting letters of a term."""
            out = set(state)
            for node, used, swap in state:
                if used == 0 and swap < 0:
                    out |= {(child, 1, -1) for child in children[node].values() if edits[child]}
            return frozenset(out)

        def step(state: frozenset, s: int) -> frozenset:
            out = set()
            for node, used, swap in state:
                if swap >= 0:  # the second letter of a swapped pair
                    if swap == s:
                        out.add((node, used, -1))
                    continue
                if s in children[node]:
                    out.add((children[node][s], used, -1))
                if used == 0:
                    if edits[node]:
                        out.add((node, 1, -1))
                    for first, child in children[node].items():
                        if not edits[child]:
                            continue
                        if first != s:
                            out.add((child, 1, -1))
                        if s in children[child]:
                            out.add((children[child][s], 1, first))
            return close(out)

        def expected(state: frozenset) -> set[int]:
            """Symbols that lead elsewhere than one outside the alphabet does."""
            out = {swap for _, _, swap in state if swap >= 0}
            for node, used, swap in state:
                if swap < 0:
                    out.update(children[node])
                    if used == 0:
                        out.update(*(children[child] for child in children[node].values() if edits[child]))
            return out

        start = close({(0, 0, -1)})
        numbers, waiting, rows = {frozenset(): 0, start: 1}, [start], [[0] * (len(alphabet) + 1)]
        final, stem_of = [0, 0], [0, 0]
        while waiting:
            state, row = waiting.pop(0), []
            near, other = expected(state), step(state, len(alphabet))
            for s in range(len(alphabet) + 1):
                after = step(state, s) if s in near else other
                if after not in numbers:
                    numbers[after] = len(numbers)
                    waiting.append(after)
                    ends = [(u, whole[n]) for n, u, w in after if w < 0 and n in whole and (u == 0 or long_term[whole[n]])]
                    final.append(min(ends)[1] if ends else 0)
                    begun = [stems[n] for n, u, w in after if w < 0 and u == 0 and n in stems]
                    stem_of.append(min(begun) if begun else 0)
                row.append(numbers[after])
            rows.append(row)
        self.next = np.array(rows, dtype=np.int32)
        self.final, self.stem = np.array(final), np.array(stem_of)

    def match(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Term of every word (one more than its number), 0 where there is none."""
        state = np.ones(len(start), dtype=np.int64)
        found = np.zeros(len(start), dtype=np.int64)
        alive, at = np.arange(len(start)), start.copy()
        while len(alive):
            over = at[alive] >= end[alive]
            if over.any():
                done = alive[over]
                found[done] = np.where(found[done] > 0, found[done], self.final[state[done]])
                alive = alive[~over]
            state[alive] = self.next[state[alive], self.symbol[arrays.LOWER[data[at[alive]]]]]
            begun = self.stem[state[alive]]
            found[alive] = np.where(found[alive] > 0, found[alive], begun)
            alive = alive[(state[alive] > 0)]
            at[alive] += 1
        return found


FEATURES = ("hits", "distinct", "density", "quoted", "reported", "denied", "addressed", "plain", "best")


@dataclass
class ToxicModel:
    automaton: TermAutomaton | None
    weight: np.ndarray  # of each term
    center: np.ndarray
    spread: np.ndarray
    slope: np.ndarray
    base: float
    ordinary: np.ndarray  # hashes of ordinary words that a misspelled term could be taken for

    def hits(self, texts: list[bytes]) -> tuple[arrays.Words, np.ndarray, np.ndarray]:
        words = arrays.Words(texts, _WORD)
        if self.automaton is None or not len(words.start):
            return words, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        value, at, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        term = self.automaton.match(words.data, words.start[at], words.end[at])
        term = np.where(np.isin(value, self.ordinary), 0, term)[back]
        hit = np.flatnonzero(term)
        return words, hit, term[hit] - 1

    def features(self, texts: list[bytes]) -> np.ndarray:
        words, hit, term = self.hits(texts)
        out = np.zeros((len(texts), len(FEATURES)))
        text = words.text[hit]
        if not len(hit):
            return out
        weight = self.weight[term]
        hashes = words.hashes()

        def near(lexicon: list[str]) -> np.ndarray:
            """Whether such a word stands in the window before the hit."""
            known = arrays.Words([w.encode() for w in lexicon], _WORD)
            marked = np.append(0, np.cumsum(np.isin(hashes, known.hashes())))
            first = np.maximum(hit - WINDOW, words.first[text])
            return marked[hit] > marked[first]

        data = words.data
        quote = np.append(0, np.cumsum((data == ord('"')) | (data == 0xAB) | (data == 0xBB)))
        opened = quote[words.start[hit]] - quote[words.text_start[text]]
        first = np.maximum(hit - WINDOW, words.first[text])
        last = np.minimum(hit + WINDOW, words.first[text + 1] - 1)
        around = (quote[words.start[hit]] > quote[words.start[first]]) & (quote[words.end[last]] > quote[words.end[hit]])
        quoted = (opened % 2 == 1) | around
        reported, denied, addressed = near(REPORTING), near(DENYING), near(ADDRESS)

        def total(values: np.ndarray) -> np.ndarray:
            return np.bincount(text, weights=values, minlength=len(texts))

        plain = ~(quoted | reported | denied)
        best = np.zeros(len(texts))
        np.maximum.at(best, text, weight * np.where(plain, 1.0, 0.5))
        columns = [
            np.log1p(total(weight)), np.log1p(np.bincount(np.unique(text * len(self.weight) + term) // len(self.weight), minlength=len(texts))),
            total(weight) / np.maximum(words.count, 1), total(quoted), total(reported), total(denied), total(addressed), np.log1p(total(weight * plain)), best,
        ]
        return np.stack(columns, axis=1)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = (self.features(texts) - self.center) / self.spread
        return 1 / (1 + np.exp(-(x @ self.slope + self.base)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    full = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([ridge] * x.shape[1] + [1e-3])
    w = np.zeros(full.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
        step = np.linalg.solve((full.T * (p * (1 - p))) @ full + penalty, full.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _choose_terms(table: pa.Table, toxic: int, clean: int, ordinary: list[bytes]) -> list[tuple[bytes, bool, float]]:
    """Terms by log odds, longest evidence first; at equal strength whole words come before stems.

    Longer forms of a chosen stem are left out, but not whole words that may be misspelled, as stems must match.
    No stem is a beginning of an ordinary word.
    """
    taken = {word[:n] for word in ordinary for n in range(STEM_FROM, STEM_TO + 1)}
    rows = sorted(
        ((t.encode(), bool(s), int(a), int(b)) for t, s, a, b in zip(*(table[c].to_pylist() for c in ("term", "stem", "toxic", "clean")), strict=True)),
        key=lambda r: (-r[2] / (r[2] + 1 + 4 * r[3]), -r[2], len(r[0]), r[0], r[1]),
    )
    chosen: list[tuple[bytes, bool, float]] = []
    stems: set[bytes] = set()
    for term, stem, a, b in sorted(rows, key=lambda r: (-np.log((r[2] + 0.5) / (r[3] + 0.5)) * np.sqrt(r[2]), r[1], -len(r[0]), r[0])):
        if stem and term in taken:
            continue
        if (stem or len(term) < EDIT_FROM) and any(term[:k] in stems for k in range(1, len(term) + 1)):
            continue
        odds = float(np.log((a + 0.5) / (toxic + 1)) - np.log((b + 0.5) / (clean + 1)))
        chosen.append((term, stem, odds))
        if stem:
            stems.add(term)
        if len(chosen) == TERMS:
            break
    return chosen


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> ToxicModel:
    """Model of ``label`` from at most ``rows`` labelled texts outside the held-out fold.

    Term counts are gathered by Spark over these texts; the driver gets the terms that pass the thresholds and a
    feature row per text.
    """
    sample = materialize(labelled_texts(docs, labels, label, fold(F.col("doc_id"), FOLDS) == HELD_OUT, key=key, text=text, rows=rows), "labelled")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in arrays.slices(batches, "body"):
            toxic = part.column(part.schema.get_field_index("label")).to_pylist()
            counts: dict[tuple[bytes, bool], list[int]] = {}
            words = arrays.Words(texts, _WORD)
            lower = arrays.LOWER[words.data].tobytes()
            hashes = arrays.signed(words.hashes()).tolist()
            for i, (a, k) in enumerate(zip(words.first[:-1].tolist(), words.count.tolist(), strict=True)):
                own = {lower[s:e]: h for s, e, h in zip(words.start[a : a + k].tolist(), words.end[a : a + k].tolist(), hashes[a : a + k], strict=True)}
                found = {(w, False): (h, h) for w, h in own.items() if STEM_FROM <= len(w) <= 40}
                for w, h in own.items():
                    for n in range(STEM_FROM, min(len(w), STEM_TO) + 1):
                        least, most = found.get((w[:n], True), (h, h))
                        found[w[:n], True] = min(least, h), max(most, h)
                for term, (least, most) in found.items():
                    held = counts.setdefault(term, [0, 0, least, most])
                    held[toxic[i] == 0] += 1
                    held[2], held[3] = min(held[2], least), max(held[3], most)
            rows = [(t, s, *held) for (t, s), held in counts.items() if _is_text(t)]
            kinds = pa.bool_(), *[pa.int64()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0].decode() for r in rows], pa.string()), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds, 1))],
                ["term", "stem", "toxic", "clean", "least", "most"],
            )

    counted = sample.mapInArrow(terms, "term string, stem boolean, toxic long, clean long, least long, most long").groupBy("term", "stem").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    # A stem stands for two different words or more; the smallest and largest hash of its words tell.
    several = ~F.col("stem") | (F.col("least") < F.col("most"))
    toxic = F.col("toxic") >= LEAST_SHARE * (F.col("toxic") + F.col("clean"))
    # Words known from as many clean texts are ordinary ones, not misspelled terms.
    ordinary = ~F.col("stem") & ~toxic & (F.col("clean") >= LEAST_TEXTS)
    counted = materialize(counted.filter(ordinary | (several & toxic & (F.col("toxic") >= LEAST_TEXTS))).withColumn("ordinary", ordinary), "toxicity_terms")
    usual = [t.encode() for t in counted.filter("ordinary").select("term").toArrow()["term"].to_pylist()]
    kept = counted.filter("NOT ordinary")
    strength = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) * F.sqrt("toxic")
    table = kept.orderBy(F.desc(strength), F.length("term"), "term", "stem").limit(64 * TERMS).toArrow()
    sizes = {int(r["label"]): r["count"] for r in sample.groupBy("label").count().collect()}
    chosen = _choose_terms(table, sizes.get(1, 0), sizes.get(0, 0), usual)
    nothing = np.zeros(len(FEATURES))
    share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2)
    automaton = TermAutomaton([(t, s) for t, s, _ in chosen]) if chosen else None
    model = ToxicModel(automaton, np.array([w for _, _, w in chosen]), nothing, nothing + 1, nothing, float(np.log(share / (1 - share))), np.zeros(0, dtype=np.uint64))
    if not chosen or len(sizes) < 2:
        return model
    known = arrays.Words(usual, _WORD)
    model.ordinary = np.sort(known.hashes()[automaton.match(known.data, known.start, known.end) > 0])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in arrays.slices(batches, "body"):
            flat = sent.value.features(texts)
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), column], ["doc_id", "label", "x"])

    measured = sample.select("doc_id", "label", "body").mapInArrow(measure, "doc_id long, label int, x array<double>").toArrow()
    x = np.array(measured["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = measured["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y, measured["doc_id"].to_numpy()))
    x, y = x[order], y[order]
    model.center, model.spread = x.mean(axis=0), np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    model.slope, model.base = _logistic((x - model.center) / model.spread, y)
    return model


def _is_text(raw: bytes) -> bool:
    """Whether the bytes don't end inside a character."""
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def score_toxicity(docs: DataFrame, model: ToxicModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score of every row, from its text alone, and the characters of its hits.

    Null counts as empty; texts without hits share the lowest score. Repeated rows score alike.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in arrays.slices(batches, "body"):
            words, hit, _ = sent.value.hits(texts)
            before = words.characters()
            doc = words.text[hit]
            offset = before[words.text_start[doc]]
            pairs = (before[words.start[hit]] - offset).tolist(), (before[words.end[hit]] - offset).tolist()
            spans: list[list[dict[str, int]]] = [[] for _ in texts]
            for i, start, end in zip(doc.tolist(), *pairs, strict=True):
                spans[i].append({"start": start, "end": end})
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(sent.value.scores(texts)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["doc_id", "score", "spans"],
            )

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    return source.mapInArrow(score, "doc_id long, score double, spans array<struct<start: long, end: long>>").select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans",
    )

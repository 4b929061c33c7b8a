"""Text quality by a generalised additive model with pairwise interactions.

Every text becomes a few counts and shares, each cut into quantile bins. Boosting goes round the features, adding
a small tree of one feature at a time, and then round the pairs whose joint tables explain most of what is left.
The sum of a feature's trees is a look-up table, so a score is a sum of look-ups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evisift.llm import arrays
from evisift.llm.labelled import FIT_ROWS, fold, labelled_texts

FOLDS, HELD_OUT = 3, 1
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, RATE, PAIRS, LEAVES = 150, 60, 0.1, 6, 4
LEAST_ROWS = 20  # in a leaf

SCORED = "doc_id long, score double"


def _bytes(*spans: tuple[int, int]) -> np.ndarray:
    return ~arrays.byte_class(*spans)


_CLASSES = {
    "upper": _bytes((65, 90)),
    "lower": _bytes((97, 122)),
    "digit": _bytes((48, 57)),
    "wide": _bytes((0xC0, 0xFF)),
    "stop": _bytes((ord("."), ord(".")), (ord(","), ord(","))),
    "symbol": _bytes((33, 43), (45, 45), (47, 47), (58, 64), (91, 96), (123, 126)),
    "line": _bytes((10, 10)),
}
NAMES = (
    "words", "word_length", *(f"{name}_share" for name in _CLASSES if name != "line"), "line_words", "distinct_words", "repeats", "top_word",
    "long_words", "capitals", "distinct_lines", "single_letters",
)


def features(texts: list[bytes]) -> np.ndarray:
    """One row of numbers per text; an empty text is all zero but for the shares of distinct things, which are one."""
    words = arrays.Words(texts, arrays.BLANK_SEPARATED)
    n = words.count
    some = np.maximum(n, 1)
    sizes = np.maximum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)), 1)

    def per_text(marked: np.ndarray) -> np.ndarray:
        total = np.zeros(len(words.data) + 1, dtype=np.int32)
        np.cumsum(marked, out=total[1:])
        return (total[words.text_start[1:] - 1] - total[words.text_start[:-1]]).astype(np.int64)

    def per_word(marked: np.ndarray) -> np.ndarray:
        return np.bincount(words.text, weights=marked, minlength=len(texts))

    counts = {name: per_text(table[words.data]) for name, table in _CLASSES.items()}
    length = words.end - words.start
    hashes = words.hashes()
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1])
    distinct, top = np.ones(len(texts)), np.zeros(len(texts))
    for i, (a, k) in enumerate(zip(words.first[:-1].tolist(), n.tolist(), strict=True)):
        if k:
            own = np.sort(hashes[a : a + k])
            edge = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            distinct[i] = len(edge) / k
            top[i] = np.diff(np.append(edge, k)).max() / k
    lines = [t.split(b"\n") for t in texts]
    columns = [
        np.log1p(n), per_word(length) / some, *(counts[name] / sizes for name in _CLASSES if name != "line"),
        n / (counts["line"] + 1), distinct, per_word(same) / some, top,
        per_word(length > 12) / some, per_word((words.data[words.start] >= 65) & (words.data[words.start] <= 90)) / some,
        np.array([len(set(x)) / len(x) for x in lines]), per_word(length == 1) / some,
    ]
    return np.stack(columns, axis=1)


def _leaf_values(grad: np.ndarray, weight: np.ndarray, rows: np.ndarray, leaves: int) -> np.ndarray:
    """Step per bin of a tree of a few leaves over ordered bins, grown by the best split."""
    step = np.zeros(len(grad))
    spans = [(0, len(grad))]
    g, h, c = (np.concatenate([[0], np.cumsum(x)]) for x in (grad, weight, rows))

    def gain(a: int, b: int) -> tuple[float, int]:
        cut = np.arange(a + 1, b)
        left, right = g[cut] - g[a], g[b] - g[cut]
        wl, wr = h[cut] - h[a], h[b] - h[cut]
        fits = np.minimum(c[cut] - c[a], c[b] - c[cut]) >= LEAST_ROWS
        score = np.where(fits, left**2 / (wl + 1) + right**2 / (wr + 1) - (left + right) ** 2 / (wl + wr + 1), -1)
        best = int(np.argmax(score)) if len(score) else -1
        return (float(score[best]), int(cut[best])) if best >= 0 else (-1.0, a)

    while len(spans) < leaves:
        options = [(*gain(a, b), a, b) for a, b in spans]
        best, cut, a, b = max(options)
        if best <= 0:
            break
        spans.remove((a, b))
        spans += [(a, cut), (cut, b)]
    for a, b in spans:
        step[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return step


@dataclass
class AdditiveModel:
    """Bin edges and look-up tables of single features and of pairs."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """Without rows of both labels the model is the smoothed share of label 1."""
        share = (y.sum() + 1) / (len(y) + 2)
        model = AdditiveModel(base=float(np.log(share / (1 - share))))
        if len(np.unique(y)) < 2:
            return model
        for column in x.T:
            model.edges.append(np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1])))
            model.pair_edges.append(np.unique(np.quantile(column, np.linspace(0, 1, PAIR_BINS + 1)[1:-1])))
        bins = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T, strict=True)]
        coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T, strict=True)]
        model.tables = [np.zeros(len(e) + 1) for e in model.edges]
        margin = np.full(len(y), model.base)

        def slope() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-margin))
            return y - p, np.maximum(p * (1 - p), 1e-6)

        def sums(cell: np.ndarray, size: int, *values: np.ndarray) -> list[np.ndarray]:
            return [np.bincount(cell, weights=v, minlength=size) for v in (*values, np.ones(len(y)))]

        for _ in range(ROUNDS):
            for table, own in zip(model.tables, bins, strict=True):
                step = RATE * _leaf_values(*sums(own, len(table), *slope()), LEAVES)
                table += step
                margin += step[own]
        model._add_pairs(coarse, margin, slope, sums)
        return model

    def _add_pairs(self, coarse: list[np.ndarray], margin: np.ndarray, slope, sums) -> None:
        sizes = [len(e) + 1 for e in self.pair_edges]
        found = []
        for i in range(len(sizes)):
            for j in range(i):
                g, h, c = sums(coarse[i] * sizes[j] + coarse[j], sizes[i] * sizes[j], *slope())
                g, h = g.reshape(sizes[i], -1), h.reshape(sizes[i], -1)
                alone = max((g.sum(a) ** 2 / (h.sum(a) + 1)).sum() for a in (0, 1))
                found.append(((g[h > 0] ** 2 / (h[h > 0] + 1)).sum() - alone, i, j))
        self.pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for _, i, j in sorted(found, reverse=True)[:PAIRS]]
        for _ in range(PAIR_ROUNDS):
            for i, j, table in self.pairs:
                g, h, c = (v.reshape(table.shape) for v in sums(coarse[i] * sizes[j] + coarse[j], table.size, *slope()))
                # A tree of depth two: the first feature splits, and each side splits the second.
                rows = _leaf_values(g.sum(1), h.sum(1), c.sum(1), 2)
                step = np.zeros(table.shape)
                for value in np.unique(rows):
                    side = rows == value
                    step[side] = _leaf_values(g[side].sum(0), h[side].sum(0), c[side].sum(0), 2)
                table += RATE * step
                margin += RATE * step[coarse[i], coarse[j]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.base)
        for i, (table, edges) in enumerate(zip(self.tables, self.edges, strict=True)):
            column = x[:, i]
            margin += table[np.searchsorted(edges, column, side="right")]
        for i, j, table in self.pairs:
            a, b = (np.searchsorted(self.pair_edges[k], x[:, k], side="right") for k in (i, j))
            margin += table[a, b]
        return 1 / (1 + np.exp(-margin))


def fit_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = FIT_ROWS) -> AdditiveModel:
    """Model of ``label`` from at most ``rows`` labelled texts outside the held-out fold."""
    sample = labelled_texts(docs, labels, label, fold(F.col("doc_id"), FOLDS) == HELD_OUT, key=key, text=text, rows=rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in arrays.slices(batches, "body"):
            flat = features(texts)
            column = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), column], ["doc_id", "label", "x"])

    measured = sample.select("doc_id", "label", "body").mapInArrow(measure, "doc_id long, label int, x array<double>").toArrow()
    x = np.array(measured["x"].combine_chunks().flatten()).reshape(-1, len(NAMES))
    y = measured["label"].to_numpy().astype(float)
    order = np.lexsort((*x.T, y, measured["doc_id"].to_numpy()))
    return AdditiveModel.fit(x[order], y[order])


def score_quality(docs: DataFrame, model: AdditiveModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Score of every row, from its text alone; null counts as empty, repeated rows score alike."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in arrays.slices(batches, "body"):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sent.value.scores(features(texts)))], ["doc_id", "score"])

    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    return source.mapInArrow(score, SCORED).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, model: AdditiveModel, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts score at least ``least``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index(text)
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, True) for i, f in enumerate(docs.schema)])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in arrays.slices(batches, f"c{column}"):
            yield rows.filter(pa.array(sent.value.scores(features(texts)) >= least))

    return docs.toDF(*plain.names).mapInArrow(keep, plain).toDF(*docs.columns)

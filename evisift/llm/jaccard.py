"""Jaccard self-join of word n-gram sets: enumerated subsets for small sets, inverted lists for large ones.

Light sets (few shingles) enumerate their subsets of the fixed size that a partner of each possible size must
share with them. Heavy sets scan inverted lists of single shingles: two sets that link share one of the first
``n - s n + 1`` shingles of each (s: the similarity), in any order common to all sets. The order puts frequent shingles last, so
widespread passages and edited copies of one text hardly open lists. A set is light up to the size where
enumeration would emit more keys than its lists cost.

Short lists, of a fixed number of members at most, pair their members directly. Sets that link share a certain
number of leading shingles, so pairs are counted over all lists, and the few that reach it are verified exactly.
Long lists are resolved without all pairs. Each names a pivot, the member whose common shingle comes earliest; members
that may link by size and place are verified against it, and all links so far give first components. Of what is left,
pairs of different components that may link by size and place are verified. A pair inside one component
can't change the components, so none that matters is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evisift.llm import arrays
from evisift.llm.components import min_labels
from evisift.session import materialize

SHINGLE = 5
SIMILARITY = 80  # per cent
# Keys a set may enumerate for each list it would enter: a list row is shuffled, sorted, fetched and verified.
SCAN_COST = 8
# Shingles counted as frequent: those found so often, and so many at most (16 MB sent to each task); the most frequent win.
# They only decide the order of shingles; any order gives the same result.
FREQUENT_FROM = 16
FREQUENT_MOST = 1 << 20
# Text that shingles are counted in before the shuffle: the more, the rarer the shingles that are seen to repeat.
COUNT_BYTES = 4 << 20
# Members of a list that is paired directly.
SHORT = 64
# Sets whose keys a task has sent already; copies of these send none again.
SEEN_SETS = 1 << 18
_U = np.uint64

KEYED = "doc_id long, text_hash long, n long, set_id long, rare array<long>, frequent array<long>, subsets array<long>"


def overlap(n: int, m: int, similarity: int = SIMILARITY) -> int:
    """Shingles that sets of these sizes share at least when they link."""
    return -(-similarity * (n + m) // (100 + similarity))


def partners(n: int, similarity: int = SIMILARITY) -> range:
    return range(-(-similarity * n // 100), 100 * n // similarity + 1)


def prefix(n, similarity: int = SIMILARITY):
    """Leading shingles of a set of which any partner has n // 20 + 1 among its own; one would do for a candidate."""
    return n - (-(-similarity * n // 100)) + 1 + n // 20


@cache
def light_limit(similarity: int = SIMILARITY) -> int:
    """Largest size up to which enumerating subsets costs no more than scanning lists."""
    n = 1
    while sum(comb(n, n - overlap(n, m, similarity)) for m in partners(n, similarity)) <= SCAN_COST * prefix(n, similarity):
        n += 1
    return n - 1


class ShingleSets:
    """Distinct shingle hashes of every text, sorted, one after the other."""

    def __init__(self, texts: list[bytes], shingle: int) -> None:
        words = arrays.Words(texts, arrays.BLANK_SEPARATED)
        hashes = words.hashes()
        count = np.where(words.count >= shingle, words.count - shingle + 1, np.minimum(words.count, 1))
        first = np.cumsum(count) - count
        text, at = arrays.runs(count)
        start = words.first[text] + at
        size = np.minimum(words.count, shingle)[text]
        value = np.zeros(len(start), dtype=_U)
        for i in range(shingle):
            inside = i < size
            value[inside] = arrays.mix(value[inside] + hashes[start[inside] + i] * _U(2 * i + 1))
        for a, b in zip(first.tolist(), (first + count).tolist(), strict=True):
            value[a:b].sort()
        fresh = np.ones(len(value), dtype=bool)
        fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
        self.value, self.text = value[fresh], text[fresh]
        self.count = np.bincount(self.text, minlength=len(texts)).astype(np.int64)
        self.first = np.cumsum(self.count) - self.count

    def set_ids(self) -> np.ndarray:
        """64-bit identity of each set; equal sets have equal ids, 0 stands for the empty set."""
        total = np.zeros(len(self.count), dtype=_U)
        np.add.at(total, self.text, arrays.mix(self.value ^ _U(0xA5A5A5A5A5A5A5A5)))
        return np.where(self.count == 0, _U(0), arrays.mix(total + self.count.astype(_U)) | _U(1))

    def subset_keys(self, text: int, similarity: int, limit: int) -> list[int]:
        """A key for every subset of the size shared with a light partner of each size."""
        n = int(self.count[text])
        if not 0 < n <= limit:
            return []
        values = self.value[self.first[text] : self.first[text] + n].tolist()
        total, out = sum(values), []
        for m in partners(n, similarity):
            if m > limit:
                break
            size = overlap(n, m, similarity)
            tag = (min(n, m) * (limit + 1) + max(n, m)) * 0x9E3779B97F4A7C15
            out += [(total - sum(left) + tag) % (1 << 64) for left in combinations(values, n - size)]
        return arrays.signed(arrays.mix(np.array(out, dtype=_U))).tolist()

    def prefixes(self, frequent: np.ndarray, counts: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Leading shingles of all sets, rare ones first: value, text, and whether it is frequent."""
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, self.value), len(frequent) - 1)
            weight = np.where(frequent[at] == self.value, counts[at], 0)
        else:
            weight = np.zeros(len(self.value), dtype=np.int64)
        order = np.lexsort((weight, self.text))  # stable: by value within a weight
        place = np.arange(len(order)) - self.first[self.text]
        keep = place < prefix(self.count, similarity)[self.text]
        order = order[keep]
        return self.value[order], self.text[order], weight[order] > 0


def frequent_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of the whole table and about how often they occur.

    Every task counts its slices and passes on what a slice has more than once. The threshold is the power of two
    that leaves no more than ``FREQUENT_MOST``, found from a histogram.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in arrays.slices(batches, "body", COUNT_BYTES):
            value, number = np.unique(ShingleSets(texts, shingle).value, return_counts=True)
            more = number > 1
            yield pa.RecordBatch.from_arrays([pa.array(arrays.signed(value[more])), pa.array(number[more])], ["shingle", "number"])

    found = materialize(
        docs.select("body").mapInArrow(count, "shingle long, number long").groupBy("shingle")
        .agg(F.sum("number").alias("number")).filter(F.col("number") >= FREQUENT_FROM),
        "frequent_shingles",
    )
    level = F.floor(F.log2(F.col("number").cast("double"))).cast("int")
    most, total = FREQUENT_FROM, 0
    for row in found.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += row["count"]
        if total > FREQUENT_MOST:
            most = 2 << row["level"]
            break
    table = found.filter(F.col("number") >= most).toArrow()
    value = table["shingle"].to_numpy().view(_U)
    order = np.argsort(value)
    return value[order], table["number"].to_numpy()[order]


def keyed_sets(docs: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """Every row's set (size, identity) and the keys of its lists, in order of place."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, shingle))
    limit = light_limit(similarity)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, counts = sent.value
        seen: set[int] = set()
        for rows, texts in arrays.slices(batches, "body"):
            sets = ShingleSets(texts, shingle)
            ids = arrays.signed(sets.set_ids())
            value, text, often = sets.prefixes(frequent, counts, similarity)
            if len(seen) > SEEN_SETS:
                seen.clear()
            fresh = np.zeros(len(texts), dtype=bool)
            for i, own in enumerate(ids.tolist()):
                if own and own not in seen:
                    seen.add(own)
                    fresh[i] = True
            listed = fresh & (100 * sets.count > similarity * limit)

            def lists(mask: np.ndarray) -> pa.Array:
                mask = mask & listed[text]
                ends = np.cumsum(np.bincount(text[mask], minlength=len(texts)))
                return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(arrays.signed(value[mask])))

            subsets = [sets.subset_keys(i, similarity, limit) if new else [] for i, new in enumerate(fresh.tolist())]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(sets.count), pa.array(ids), lists(~often), lists(often), pa.array(subsets, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n", "set_id", "rare", "frequent", "subsets"],
            )

    rows = docs.select("doc_id", F.xxhash64("body").alias("text_hash"), "body")
    return materialize(rows.mapInArrow(keys, KEYED), "keyed_sets")


def _needed(n: Column, m: Column, similarity: int) -> Column:
    return F.ceil(similarity * (n + m) / (100 + similarity) - 1e-9)


def _may_link(n: Column, i: Column, m: Column, j: Column, similarity: int) -> Column:
    """Whether sets of sizes n and m can link when a shingle they share has places i and j in them.

    Exact if it is their first common one; for later ones it only looks too kindly or has been met before.
    """
    return F.least(n - i, m - j) >= _needed(n, m, similarity)


def _prefix(n: Column, similarity: int) -> Column:
    return n - F.ceil(n * similarity / 100 - 1e-9) + 1 + F.floor(n / 20)


def candidate_lists(keyed: DataFrame, similarity: int) -> DataFrame:
    """Members of all lists of two sets or more: key, set, size, place, length of the list and its pivot.

    Lists of rare shingles and of subsets are windows. Frequent shingles may stand in a third of all sets;
    their pivots are found by map-side aggregation and joined back, which splits hot keys.
    """
    place = F.col("pos").cast("long")

    def members(column: str, start: Column) -> DataFrame:
        rows = keyed.filter(F.size(column) > 0).select("set_id", "n", start.alias("start"), F.posexplode(column).alias("pos", "key"))
        return rows.select("key", "set_id", "n", (place + F.col("start") if column != "subsets" else F.lit(0).cast("long")).alias("pos"))

    lead = F.min(F.struct((F.col("pos") / F.col("n")).alias("at"), "set_id", "n", "pos"))
    facts = {"low": F.min("set_id"), "high": F.max("set_id"), "members": F.count(F.lit(1)), "pivot": lead}
    short = members("rare", F.lit(0)).unionByName(members("subsets", F.lit(0)))
    window = W.partitionBy("key")
    short = short.select("*", *(f.over(window).alias(name) for name, f in facts.items()))
    often = members("frequent", F.size("rare"))
    pivots = materialize(often.groupBy("key").agg(*(f.alias(name) for name, f in facts.items())).filter("low < high"), "frequent_pivots")
    rows = short.filter("low < high").unionByName(often.join(pivots, "key"))
    return materialize(
        rows.select(
            "key", "set_id", "n", "pos", "members",
            F.col("pivot.set_id").alias("pivot"), F.col("pivot.n").alias("pivot_n"), F.col("pivot.pos").alias("pivot_pos"),
        ),
        "lists",
    )


def counted_pairs(lists: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of short lists that share enough leading shingles to link.

    Of a set's leading shingles at most n - overlap are missing in a partner, so the pair shares at least as many as
    the shorter of both bounds says; shingles whose lists are long may all be shared.
    """
    short = lists.filter(F.col("members") <= SHORT)
    sides = [short.select("key", *(F.col(c).alias(f"{x}_{c}") for c in ("set_id", "n", "pos"))) for x in "ab"]
    a, n, i, b, m, j = (F.col(f"{x}_{c}") for x in "ab" for c in ("set_id", "n", "pos"))
    alike = (100 * F.least(n, m) >= similarity * F.greatest(n, m)) & (a < b)
    pairs = sides[0].join(sides[1], "key").filter(alike).groupBy(a.alias("a"), b.alias("b"), n.alias("n"), m.alias("m")).agg(
        F.count(F.lit(1)).alias("shared"), F.max(_may_link(n, i, m, j, similarity)).alias("may")
    ).filter("may")
    long = lists.filter(F.col("members") > SHORT).groupBy("set_id").agg(F.count(F.lit(1)).alias("more"))
    for side in "ab":
        pairs = pairs.join(long.select(F.col("set_id").alias(side), F.col("more").alias(f"more_{side}")), side, "left")
    more = F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0)))
    n, m = F.col("n"), F.col("m")
    least = _needed(n, m, similarity) + F.least(_prefix(n, similarity) - n, _prefix(m, similarity) - m)
    light = F.greatest(n, m) <= light_limit(similarity)  # their keys are subsets, not shingles
    return materialize(pairs.filter(light | (F.col("shared") + more >= least)).select("a", "b"), "counted_pairs")


def owner_texts(docs: DataFrame, keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, body): for every wanted set the texts of one owner, known by id and text hash as ids may be null or repeat."""
    owners = keyed.groupBy(F.col("set_id").alias("wanted")).agg(
        F.min("doc_id").alias("owner"), F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash")).alias("owner_hash")
    ).join(wanted.withColumnRenamed("set_id", "wanted"), "wanted", "left_semi")
    same = F.col("doc_id").eqNullSafe(F.col("owner")) & (F.xxhash64("body") == F.col("owner_hash"))
    return docs.join(owners, same).select("wanted", "body")


def shingle_sets(docs: DataFrame, keyed: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """The shingles of the wanted sets, each from one document that has it."""
    texts = owner_texts(docs, keyed, wanted)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows, bodies in arrays.slices(batches, "body"):
            sets = ShingleSets(bodies, shingle)
            ids = arrays.signed(sets.set_ids())
            right = ids == rows.column(0).to_numpy(zero_copy_only=False)  # hashes of texts may be equal by chance
            if len(seen) > SEEN_SETS:
                seen.clear()
            for i, own in enumerate(ids.tolist()):  # an owner's row may be repeated
                right[i] &= own not in seen
                if right[i]:
                    seen.add(own)
            ends = np.append(0, np.cumsum(sets.count))
            elements = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(arrays.signed(sets.value)))
            yield pa.RecordBatch.from_arrays([pa.array(ids), elements], ["set_id", "elements"]).filter(pa.array(right))

    return materialize(texts.mapInArrow(read, "set_id long, elements array<long>"), "shingle_sets")


def verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by their exact overlap."""
    left = sets.select(F.col("set_id").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("set_id").alias("b"), F.col("elements").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(left, "a").join(right, "b")
        .select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
        .filter(100 * F.col("both") >= similarity * (F.col("sum") - F.col("both")))
        .select("a", "b").distinct()
    )


def linked_sets(docs: DataFrame, keyed: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """Set ids that link with another, and the smallest id reachable from each."""
    lists = candidate_lists(keyed, similarity)
    pairs = counted_pairs(lists, similarity)
    # The smaller set of a pair has a shingle of both among its first n - overlap(n, n): if not even the pivot has, no pair may link.
    # In whole numbers, as the place of the first common shingle may be the last one that is allowed.
    near = (100 + similarity) * F.col("pivot_pos") <= (100 - similarity) * F.col("pivot_n")
    lists = lists.filter((F.col("members") > SHORT) & near)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).union(lists.select("set_id")).distinct()
    sets = shingle_sets(docs, keyed, wanted, shingle)

    def links(found: DataFrame) -> DataFrame:
        return materialize(verified(found.distinct(), sets, similarity), "links")

    size, at = F.col("n"), F.col("pos")
    first = lists.filter((F.col("set_id") != F.col("pivot")) & _may_link(size, at, F.col("pivot_n"), F.col("pivot_pos"), similarity))
    edges = links(pairs.union(first.select(F.col("pivot").alias("a"), F.col("set_id").alias("b"))))
    label = min_labels(edges, "a", "b")

    def labelled(rows: DataFrame, name: str, out: str) -> DataFrame:
        found = label.select(F.col("id").alias(name), F.col("label").alias("_found"))
        return rows.join(found, name, "left").withColumn(out, F.coalesce("_found", name)).drop("_found")

    rows = materialize(labelled(labelled(lists, "set_id", "part"), "pivot", "main"), "labelled_lists")
    minor = rows.filter(F.col("part") != F.col("main"))
    # The smaller set of a pair has the common shingle within its first n - overlap(n, n) places.
    early = F.col("pos") <= F.col("n") - _needed(size, size, similarity)

    def side(frame: DataFrame, name: str) -> DataFrame:
        return frame.select("key", *(F.col(c).alias(f"{name}_{c}") for c in ("set_id", "n", "pos", "part")))

    def crossing(small: DataFrame, large: DataFrame) -> DataFrame:
        pair = side(small.filter(early), "s").join(side(large, "l"), "key")
        return pair.filter(
            (F.col("s_n") <= F.col("l_n")) & (F.col("s_part") != F.col("l_part"))
            & _may_link(F.col("s_n"), F.col("s_pos"), F.col("l_n"), F.col("l_pos"), similarity)
        ).select(F.least("s_set_id", "l_set_id").alias("a"), F.greatest("s_set_id", "l_set_id").alias("b"))

    more = links(crossing(minor, rows).union(crossing(rows, minor)))
    return min_labels(edges.union(more), "a", "b")


def similar_documents(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY
) -> DataFrame:
    """Every row with the size of its shingle set and the smallest id reachable by links.

    ``component_id`` of a text without words (null, empty or blank) is its own id. Equal sets link. A text of fewer
    words than a shingle is one shingle. Repeated rows are rows of their own. Ids that are null don't count for
    a component unless it has no others. Shingles and sets are compared by 64-bit hashes.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    keyed = keyed_sets(source, shingle, similarity)
    rows = keyed.select("doc_id", "n", "set_id")
    label = linked_sets(source, keyed, shingle, similarity).select(F.col("id").alias("set_id"), "label")
    owner = rows.filter("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    owner = owner.join(label, "set_id", "left").filter("rows > 1 OR label IS NOT NULL")
    owner = materialize(owner.select("set_id", "least", F.coalesce("label", "set_id").alias("label")), "set_owners")
    part = owner.groupBy("label").agg(F.min("least").alias("component"))
    owner = materialize(owner.join(part, "label").select("set_id", "component"), "set_components")
    return rows.join(owner, "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )


def drop_similar(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY
) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: those whose id is its smallest.

    Rows without an id stay, as do all rows of an id that stands for a component with one of them.
    """
    found = similar_documents(docs, key=key, text=text, shingle=shingle, similarity=similarity)
    rest = found.groupBy("doc_id").agg(F.min(F.col("doc_id") != F.col("component_id")).alias("drop")).filter("drop")
    rest = rest.select(F.col("doc_id").alias("_similar_id"))
    return docs.join(rest, docs[key].cast("long") == rest["_similar_id"], "left_anti")

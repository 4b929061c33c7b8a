"""Trie of conversation prefixes by blocks of turns.

A conversation is cut into blocks of a few turns. The state behind a block combines the digests of all blocks up
to it, so one running total gives every conversation's place at every block boundary, whatever its length.
Conversations are first grouped by whole blocks behind the same state. Where all of them share one block, its
turns have the same members and need no further look; only blocks with differing siblings are taken apart turn by
turn, and each distinct block once rather than once per conversation.

Sums over subtrees need no walk from level to level: they are sums over the members of a node. A node belongs to
its smallest member; the bytes of the nodes a conversation owns, its bytes in all and whether it owns a leaf add up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.llm.ordered import running
from evisift.session import materialize

# Turns in a block.
BLOCK = 4
# Conversation ids joined in one row for the digest of those that end at a node.
ENDS_ROW = 4096

NODE = ["depth", "a", "b"]


def turn_digests(conversations: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``turn``, ``digest`` of role and text, ``size`` of the text in UTF-8 bytes.

    Null role or text is empty. Rows without a conversation id are left out; other columns are ignored.
    """
    role_, text_ = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256))
    return conversations.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), digest.alias("digest"), F.octet_length(text_).cast("long").alias("size")
    )


def ordered_turns(conversations: DataFrame, **columns: str) -> DataFrame:
    """Turns of every conversation numbered from 0 in ``pos``: by ``turn``, null first; equal ones by digest."""
    rows = materialize(turn_digests(conversations, **columns), "turns")
    placed = running(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("digest")], {"pos": F.count(F.lit(1))}, "turns_placed")
    return placed.select("conv_id", F.col("pos").cast("long").alias("pos"), "digest", "size")


def _state(k: Column, digests: Column) -> tuple[Column, Column]:
    """Two 64-bit parts of what a block, or the first turns of one, adds to the state."""
    body = F.sha2(F.aggregate(digests, F.lit("").cast("binary"), lambda out, d: F.concat(out, d)), 256)
    return F.xxhash64(F.lit("a"), k, body), F.xxhash64(F.lit("b"), k, body)


def _blocks(turns: DataFrame, block: int) -> DataFrame:
    """Each conversation's blocks: ``k``, state (a, b) and bytes before it, its turns, what it adds (da, db)."""
    cells = turns.groupBy("conv_id", F.floor(F.col("pos") / block).alias("k")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "size"))).alias("turns")  # ``block`` of them at most
    )
    added = _state(F.col("k"), F.col("turns.digest"))
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda n, t: n + t["size"])
    cells = cells.withColumns({"da": added[0], "db": added[1], "bytes": size})
    cells = materialize(cells, "cells")
    totals = {"a": F.bit_xor("da"), "b": F.bit_xor("db"), "before": F.sum("bytes")}
    return materialize(running(cells, ["conv_id"], [F.col("k")], totals, "cells_placed"), "blocks")


def _nodes(blocks: DataFrame, facts: dict[str, Column], again: dict[str, Column], block: int) -> DataFrame:
    """Nodes below the root with ``facts`` over their members; ``again`` combines facts of several blocks.

    Columns: depth, a, b, parent_a, parent_b, size, before and the facts.
    """
    whole = materialize(
        blocks.groupBy("k", "a", "b", "da", "db").agg(F.first("turns").alias("turns"), F.first("before").alias("before"), *(f.alias(n) for n, f in facts.items())),
        "distinct_blocks",
    )
    # the root's children nearly always differ, so the first blocks are taken apart without being counted
    several = whole.filter("k > 0").groupBy("k", "a", "b").count().filter("count > 1").select("k", "a", "b", F.lit(True).alias("several"))
    marked = whole.filter("k > 0").join(several, ["k", "a", "b"], "left").withColumn("several", F.coalesce("several", F.lit(False)))
    marked = marked.unionByName(whole.filter("k = 0").withColumn("several", F.lit(True)))

    def prefix(i: Column) -> Column:
        first = F.slice("turns", F.lit(1), i)
        x, y = _state(F.col("k"), first["digest"])
        here = F.col("turns")[i - 1]["size"]
        sizes = F.aggregate(first, F.lit(0).cast("long"), lambda n, t: n + t["size"])
        return F.struct(x.bitwiseXOR(F.col("a")).alias("a"), y.bitwiseXOR(F.col("b")).alias("b"), here.alias("size"), (F.col("before") + sizes - here).alias("before"))

    ids = F.transform(F.sequence(F.lit(1), F.size("turns")), prefix)
    at = F.col("i")
    spread = marked.withColumn("ids", ids).select("*", F.explode(F.sequence(F.lit(0), F.size("turns") - 1)).alias("i"))

    def parent(c: str) -> Column:
        return F.when(at == 0, F.col(c)).otherwise(F.get("ids", at - 1)[c]).alias(f"parent_{c}")

    own = F.get("ids", at)
    each = spread.select(
        (F.col("k") * block + at + 1).cast("long").alias("depth"), own["a"].alias("a"), own["b"].alias("b"), parent("a"), parent("b"),
        own["size"].alias("size"), own["before"].alias("before"), *facts, "several",
    )
    alike = each.filter(~F.col("several")).drop("several")
    path = ["parent_a", "parent_b", "size", "before"]
    taken_apart = each.filter("several").groupBy(*NODE).agg(*(F.min(c).alias(c) for c in path), *(c.alias(n) for n, c in again.items()))
    return alike.unionByName(taken_apart)


def _ends_digest(ends: DataFrame) -> DataFrame:
    """Per node the SHA-256 of the ascending, comma-joined ids of the conversations that end there.

    Ids are joined in rows of ``ENDS_ROW``; a digest reads its rows one after the other, as SHA-256 has to.
    """
    placed = running(ends, NODE, [F.col("conv_id")], {"nth": F.count(F.lit(1))}, "ends")
    rows = placed.groupBy(*NODE, F.floor(F.col("nth") / ENDS_ROW).alias("row")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids")
    )
    rows = materialize(rows, "ends_rows")
    long = rows.filter("row > 0").select(*NODE).distinct()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running_digest = None, None
        for batch in batches:
            out = []
            for depth, a, b, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (depth, a, b) != node:
                    if node is not None:
                        out.append((*node, running_digest.hexdigest()))
                    node, running_digest = (depth, a, b), hashlib.sha256(ids.encode())
                else:
                    running_digest.update(b"," + ids.encode())
            yield _node_digests(out)
        if node is not None:
            yield _node_digests([(*node, running_digest.hexdigest())])

    short = rows.join(long, NODE, "left_anti").select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))
    ordered = rows.join(long, NODE, "left_semi").repartition(*NODE).sortWithinPartitions(*NODE, "row").select(*NODE, "ids")
    return short.unionByName(ordered.mapInArrow(digests, "depth long, a long, b long, ends_sha256 string"))


def _node_digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*NODE, "ends_sha256"])


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None, *, block: int = BLOCK) -> DataFrame:
    """Every distinct sequence of first turns, the empty one (depth 0) included.

    ``turns`` has conv_id, pos (from 0, without gaps), digest and size, as ``ordered_turns`` gives them;
    ``conversations`` (conv_id) adds those without turns. Columns of a node: ``conv_id`` of its smallest member,
    ``depth``, ``parent_conv_id`` (root: null), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (bytes that
    sharing saves in its subtree), ``ends_sha256`` of the members that have no further turn. The node's last turn is
    turn ``depth - 1`` of ``conv_id``. No conversations give no rows. Equal (conv_id, pos) must not occur.
    """
    turns = materialize(turns, "trie_turns")
    lengths = turns.groupBy("conv_id").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("length"))
    if conversations is not None:
        lengths = conversations.select("conv_id").filter("conv_id is not null").distinct().join(lengths, "conv_id", "left").fillna(0, ["total", "length"])
    lengths = materialize(lengths, "lengths")
    blocks = _blocks(turns, block)

    owned = materialize(_nodes(blocks, {"conv_id": F.min("conv_id")}, {"conv_id": F.min("conv_id")}, block), "owned_nodes")
    children = owned.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_a").alias("a"), F.col("parent_b").alias("b")).agg(F.count(F.lit(1)).alias("n_children"))
    children = materialize(children, "children")
    leaves = owned.join(children, NODE, "left_anti").select("conv_id", F.lit(1).alias("leaf"), F.lit(0).cast("long").alias("size"))
    owners = leaves.unionByName(owned.select("conv_id", F.lit(0).alias("leaf"), "size")).groupBy("conv_id").agg(F.sum("leaf").alias("leaf"), F.sum("size").alias("own"))
    known = materialize(lengths.join(owners, "conv_id", "left").fillna(0, ["leaf", "own"]), "conversations")

    facts = {
        "n_convs": F.count(F.lit(1)), "totals": F.sum("total"), "owns": F.sum("own"), "n_leaves": F.sum("leaf"),
        "top": F.min(F.struct("conv_id", "total", "own")),
    }
    again = {name: F.min(name) if name == "top" else F.sum(name) for name in facts}
    members = blocks.join(known, "conv_id")
    nodes = _nodes(members, facts, again, block)
    nothing = F.lit(0).cast("long")
    root = known.agg(*(f.alias(n) for n, f in facts.items())).filter("n_convs > 0")
    root = materialize(root.select(*(nothing.alias(c) for c in (*NODE, "parent_a", "parent_b", "size", "before")), *facts), "root")
    top = root.select(F.col("top.conv_id").alias("conv_id")).first()
    first = F.lit(top["conv_id"] if top else None).cast("long")
    root = root.withColumn("n_leaves", F.greatest("n_leaves", F.lit(1)))  # without any turn the root itself is the leaf
    nodes = materialize(nodes.unionByName(root), "nodes")

    parents = nodes.filter("depth > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("parent_a"), F.col("b").alias("parent_b"), F.col("top.conv_id").alias("above")
    )
    last = blocks.join(known, "conv_id").filter(F.col("k") * block + F.size("turns") == F.col("length"))
    ends = last.select("conv_id", F.col("length").alias("depth"), F.col("a").bitwiseXOR(F.col("da")).alias("a"), F.col("b").bitwiseXOR(F.col("db")).alias("b"))
    ends = materialize(ends.unionByName(known.filter("length = 0").select("conv_id", *(nothing.alias(c) for c in NODE))), "conversation_ends")
    spent = F.col("totals") - F.col("n_convs") * F.col("before")
    kept = F.col("top.total") - F.col("before") + F.col("owns") - F.col("top.own")
    joined = nodes.join(children, NODE, "left").join(_ends_digest(ends), NODE, "left").join(parents, ["depth", "parent_a", "parent_b"], "left")
    return joined.select(
        F.col("top.conv_id").alias("conv_id"), "depth", F.when(F.col("depth") == 1, first).otherwise(F.col("above")).alias("parent_conv_id"),
        F.col("n_convs").cast("long").alias("n_convs"), F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.col("n_leaves").cast("long").alias("n_leaves"), (spent - kept).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )

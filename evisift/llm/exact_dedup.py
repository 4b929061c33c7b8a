"""Exact duplicates by content-defined chunk recipes, in DataFrame functions only.

A text, with white-space runs as one blank, is cut behind words whose hash has its low bits zero, so equal
passages are cut alike wherever they stand. Each distinct chunk is moved once, after map-side combining, to
verify that its hash stands for one text. Documents are then compared by their ordered lists of verified chunk
identifiers, eight bytes for about 64 words. Documents that hold a chunk whose hash stands for two texts carry
their whole text as a further key, so a hash collision can't join different texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.session import materialize

BLANKS = r"[\x20\x09-\x0D]+"
# One boundary in so many words on average.
CHUNK_WORDS = 64
ALL_BITS = 0xFFFFFFFFFFFFFFFF


def words(text: Column) -> Column:
    """Words of the whole text; joined by one blank they are the normalised text."""
    return F.split(F.coalesce(text, F.lit("")), BLANKS)


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def chunk_hash(chunk: Column, bits: int) -> Column:
    hashed = F.xxhash64(chunk)
    return hashed if bits == 64 else hashed.bitwiseAND((1 << bits) - 1)


def chunks(parts: Column, chunk_words: int = CHUNK_WORDS) -> Column:
    """Chunks of a list of words, in order; together they hold every word."""

    def cut(i: Column, word: Column, n: Column) -> Column:
        return F.when((i == n - 1) | (F.pmod(F.xxhash64(word), F.lit(chunk_words)) == 0), i + 1)

    def spans(ends: Column) -> Column:
        return F.transform(
            ends,
            lambda end, j: bound(
                F.when(j == 0, F.lit(0)).otherwise(F.get(ends, j - 1)),
                lambda start: F.array_join(F.slice(parts, start + 1, end - start), " "),
            ),
        )

    ends = F.filter(F.transform(parts, lambda word, i: cut(i, word, F.size(parts))), lambda end: end.isNotNull())
    return bound(ends, spans)


def exact_groups(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", chunk_words: int = CHUNK_WORDS, hash_bits: int = 64
) -> DataFrame:
    """Every row with the group of equal texts it is in.

    Columns: ``doc_id``, ``keep_id`` (smallest id of the group; ids that are null don't count unless all are),
    ``group_size`` (rows), ``kept``, ``text_sha256`` (of the normalised text). Null text counts as empty; empty
    texts are one group. Rows that repeat id and text are all marked as kept. Other columns are ignored.
    """
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    pieces = source.select(
        F.explode(bound(words(F.col("body")), lambda parts: chunks(parts, chunk_words))).alias("chunk")
    ).select(chunk_hash(F.col("chunk"), hash_bits).alias("hash"), "chunk")
    verified = pieces.distinct()
    shared = materialize(verified.groupBy("hash").count().filter("count > 1").select("hash"), "shared_hashes")

    def facts(parts: Column) -> Column:
        normal = F.array_join(parts, " ")
        recipe = F.transform(chunks(parts, chunk_words), lambda chunk: chunk_hash(chunk, hash_bits))
        return F.struct(F.sha2(normal, 256).alias("text_sha256"), recipe.alias("recipe"), normal.alias("normal"))

    listed = source.select("doc_id", bound(words(F.col("body")), facts).alias("facts"))
    if shared.isEmpty():
        whole = F.lit(None).cast("string")
    else:  # one row: the hashes that stand for more than one chunk
        listed = listed.crossJoin(F.broadcast(shared.agg(F.collect_list("hash").alias("shared"))))
        whole = F.when(F.arrays_overlap("facts.recipe", "shared"), F.col("facts.normal"))
    recipes = materialize(
        listed.select("doc_id", "facts.text_sha256", "facts.recipe", F.coalesce(whole, F.lit("")).alias("whole")), "recipes"
    )
    groups = materialize(
        recipes.groupBy("recipe", "whole")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1"),
        "equal_texts",
    )
    return recipes.join(groups, ["recipe", "whole"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of ``docs``, all their columns, without those whose text an earlier id has.

    Rows that repeat id and text all stay, as do rows without an id.
    """
    dropped = exact_groups(docs, key=key, text=text).filter(~F.col("kept")).select(
        F.col("doc_id").alias("_copy_id"), F.col("text_sha256").alias("_copy_sha")
    ).distinct()
    sha = F.sha2(F.array_join(words(docs[text].cast("string")), " "), 256)
    return docs.join(dropped, (docs[key].cast("long") == dropped["_copy_id"]) & (sha == dropped["_copy_sha"]), "left_anti")

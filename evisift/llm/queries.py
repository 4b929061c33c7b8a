"""One query for each operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.llm import decontaminate, exact_dedup, jaccard, line_dedup, mixing, periodic, personal, prefix_trie, quality, secret_scan, tokens, toxicity
from evisift.llm.registry import ORACLES, QUERIES, query, table
from evisift.session import materialize

__all__ = ["ORACLES", "QUERIES"]

VOCABULARY = "byte_bpe_50k.json"


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


@query("op3_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


OP8 = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS normal FROM documents
), g AS (SELECT normal, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY normal)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.normal) AS text_sha256
FROM d JOIN g USING (normal)
"""


@query("op8_exact_dedup", OP8)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP4 = r"""
WITH lower_docs AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lower_docs),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), items AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)),
sizes AS (SELECT DISTINCT n FROM wins),
dwins AS (SELECT r, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
occ AS (SELECT r, i, dwins.n, item FROM dwins JOIN wins ON dwins.win = wins.win AND dwins.n = wins.n),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM occ) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""


@query("op4_benchmark_decontamination", OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items", "spans")


OP1 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * k >= 85 * (na.n + nb.n - k)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.other = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""


@query("op1_ngram_jaccard_join", OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"), shingle=4, similarity=85)


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))).drop("spans")


@query("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return personal.find_personal(docs, personal.fit_spans(docs))


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.find_secrets(docs, secret_scan.word_dictionary(docs))


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))


def _crc32(key: Column) -> Column:
    """Unsigned check sum of an id's decimal text."""
    return F.crc32(key.cast("string").cast("binary"))


def crc32_sql(text: str) -> str:
    """The same in SQL: the polynomial's division bit by bit."""
    step = f"xor(c, CASE WHEN i % 8 = 0 THEN ascii({text}[CAST(i // 8 + 1 AS INT)]) ELSE 0 END)"
    shifted = f"xor({step} >> 1, 3988292384 * ({step} & 1))"
    return f"xor(list_reduce(list_concat([4294967295], range(8 * length({text}))), lambda c, i: {shifted}), 4294967295)"


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of the one whose id is the next multiple of five below, and all ids."""
    placed = materialize(prefix_trie.ordered_turns(conversations), "ordered_turns")
    lengths = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    shared = lengths.select("conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), (_crc32(F.col("conv_id")) % 9).alias("h"))
    shared = materialize(shared, "rebuilt")
    heads = placed.filter("pos < 8").withColumnRenamed("conv_id", "base")  # h is 8 at most
    begin = shared.join(heads, "base").filter("pos < h").select("conv_id", "pos", "digest", "size")
    had = begin.groupBy("conv_id").agg(F.count(F.lit(1)).alias("lead"))
    moved = shared.join(had, "conv_id", "left").select("conv_id", "h", F.coalesce("lead", F.lit(0)).alias("lead"))
    own = placed.join(moved, "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "digest", "size")
    return begin.unionByName(own), shared.select("conv_id")


OP11 = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(concat(strlen(role), ':', role, text))) - 1 AS pos FROM t
), k AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (
  SELECT k.conv_id, 0 AS part, o.pos, o.role, o.text FROM k JOIN o ON o.conv_id = k.base AND o.pos < h
  UNION ALL SELECT k.conv_id, 1, o.pos, o.role, o.text FROM k JOIN o ON o.conv_id = k.conv_id AND o.pos >= h
), s AS (
  SELECT conv_id, row_number() OVER w AS d, strlen(text) AS size,
    string_agg(concat(strlen(role), ':', role, strlen(text), ':', text), '') OVER w AS path FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos ROWS UNBOUNDED PRECEDING)
), p AS (SELECT *, coalesce(lag(path) OVER (PARTITION BY conv_id ORDER BY d), '') AS up, lead(d) OVER (PARTITION BY conv_id ORDER BY d) IS NULL AS ends FROM s),
n AS (
  SELECT d, path, any_value(up) AS up, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '') AS ended FROM p GROUP BY d, path
  UNION ALL SELECT 0, '', NULL, 0, min(k.conv_id), count(*), coalesce(string_agg(CAST(k.conv_id AS VARCHAR), ',' ORDER BY k.conv_id) FILTER (x.conv_id IS NULL), '')
  FROM k LEFT JOIN (SELECT DISTINCT conv_id FROM s) x ON k.conv_id = x.conv_id HAVING count(*) > 0
), c AS (SELECT d - 1 AS d, up AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
l AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON n.d = c.d AND n.path = c.path),
-- each node under every node above it, by its smallest member's path
u AS (
  SELECT 0 AS d, '' AS path, CAST(n_children = 0 AS INT) AS leaf, (n - 1) * size AS saved FROM l
  UNION ALL SELECT p.d, p.path, CAST(n_children = 0 AS INT), (n - 1) * l.size FROM l JOIN p ON p.conv_id = l.conv_id AND p.d <= l.d
), e AS (SELECT d, path, sum(leaf) AS n_leaves, sum(saved) AS saved FROM u GROUP BY ALL)
SELECT l.conv_id, CAST(l.d AS BIGINT) AS depth, m.conv_id AS parent_conv_id, CAST(l.n AS BIGINT) AS n_convs, CAST(l.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(e.saved AS BIGINT) AS saved_tokens, sha256(l.ended) AS ends_sha256
FROM l JOIN e ON l.d = e.d AND l.path = e.path LEFT JOIN n m ON m.d = l.d - 1 AND m.path = l.up
"""


@query("op11_conversation_prefix_trie", OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(*rebuilt_turns(table(spark, sf_dir, "conversations")))


@query("op12_source_mixing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def repeated_words(docs: DataFrame) -> DataFrame:
    """Every tenth text, by the check sum of its id, goes round in a circle of its words from one of them on."""
    h = _crc32(F.col("doc_id"))
    g = F.floor(h / 10)
    bare = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r"))

    def circle(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.array_join(at, " ")

    turned = exact_dedup.bound(F.split(bare, exact_dedup.BLANKS), circle)
    return docs.select("doc_id", F.when((h % 10 == 0) & (bare != ""), turned).otherwise(F.col("text")).alias("text"))


OP13 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    {crc32_sql("CAST(doc_id AS VARCHAR)")} AS h FROM documents
), g AS (SELECT *, h // 10 AS g, len(w) AS n FROM d),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
b AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_select(w, list_transform(range(n), lambda i: CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1)) ELSE w END AS w FROM p
), f AS (SELECT r, n, i, array_to_string(list_slice(w, i + 1, i + 5), ' ') AS five FROM (SELECT r, n, w, unnest(range(n - 4)) AS i FROM b WHERE n > 5)),
-- five equal words at a distance q of at most a quarter of the text; every run has them from its start on
e AS (SELECT r, n, i, dense_rank() OVER (ORDER BY r, five) AS five FROM f),
q AS (SELECT x.r, x.i, y.i - x.i AS q FROM e x JOIN e y ON x.five = y.five AND x.i < y.i AND 4 * (y.i - x.i) <= x.n
), s AS (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM q),
m AS (SELECT r, q, min(i) AS start, count(*) + 4 + q AS length FROM s GROUP BY r, q, island),
runs AS (SELECT r, start, length, min(q) AS period FROM m WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length),
best AS (SELECT r, count(*) AS n_runs, arg_max(struct_pack(start, length, period), [length, -start, -period]) AS top,
  string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS listed FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
words AS (SELECT r, w[i + 1] AS word, i FROM (SELECT b.r, w, unnest(range(n)) AS i FROM b JOIN best USING (r))),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(top.start AS BIGINT) AS start, CAST(top.length AS BIGINT) AS length, CAST(top.period AS BIGINT) AS period,
  CAST(1000 * top.length // top.period AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256,
  sha256(CASE WHEN n_runs IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept.text, '') END) AS collapsed_sha256
FROM b LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""


@query("op13_periodic_runs", OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(repeated_words(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), lines.alias("lines"), "collapsed").select(
        "doc_id", "n_runs", (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.floor(1000 * F.col("top.length") / -F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join("lines", ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )

"""Canonical-shaped views over the star-schema tables the queries run on.

Every view reads its whole tables; sizes per key stay constant as the tables grow
(about thirty assertions per part, four observations per order), so the joins built
on them grow linearly.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evisift.functions import frequency, normalize
from evisift.operators import hierarchy, resolve
from evisift.session import materialize

ROOT = "ROOT"
SYSTEM = "urn:evisift:part"

# Versioned scoring parameters: one family is deliberately left out.
FAMILY_WEIGHTS = {"1-URGENT": 2.0, "2-HIGH": 1.5, "3-MEDIUM": 1.0, "4-NOT SPECIFIED": 1.0}

_MEMO: dict[tuple[str, str, str], DataFrame] = {}


def _memo(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """One materialised copy per application of a table that many queries read."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _MEMO:
        _MEMO[key] = materialize(build(), name)
    return _MEMO[key]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def part_nodes(part: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    return part.select(
        F.concat(F.lit("F:"), key).alias("leaf"),
        F.concat(F.lit("S:"), F.floor(key / 10).cast("bigint")).alias("series"),
        F.concat(F.lit("K:"), F.concat_ws("|", "p_type", "p_brand")).alias("kind"),
        F.concat(F.lit("T:"), "p_type").alias("type"),
        F.concat(F.lit("B:"), "p_brand").alias("brand"),
        "p_partkey", "p_name", "p_brand", "p_type", "p_size",
    )


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Diamond hierarchy: part under series and kind, kind under type and brand, all under ROOT."""
    nodes = part_nodes(table(spark, sf, "part"))
    pairs = F.array(
        F.struct(F.col("leaf").alias("child"), F.col("series").alias("parent")),
        F.struct(F.col("leaf").alias("child"), F.col("kind").alias("parent")),
        F.struct(F.col("series").alias("child"), F.lit(ROOT).alias("parent")),
        F.struct(F.col("kind").alias("child"), F.col("type").alias("parent")),
        F.struct(F.col("kind").alias("child"), F.col("brand").alias("parent")),
        F.struct(F.col("type").alias("child"), F.lit(ROOT).alias("parent")),
        F.struct(F.col("brand").alias("child"), F.lit(ROOT).alias("parent")),
    )
    return nodes.select(F.inline(pairs)).distinct()


def closure(spark: SparkSession, sf: str) -> DataFrame:
    return _memo(spark, sf, "closure", lambda: hierarchy.ancestor_closure(edges(spark, sf)))


def frequency_raw() -> F.Column:
    """Frequency text of a line: excluded, missing, coded band, count, percentage or range."""
    tax = F.round(F.col("l_tax") * 100).cast("int")
    quantity = F.col("l_quantity").cast("int")
    percent = F.round(F.col("l_discount") * 100).cast("int")
    return (
        F.when(F.col("l_returnflag") == "A", F.lit(frequency.EXCLUDED_CATEGORY))
        .when(tax <= 1, F.lit(None).cast("string"))
        .when(tax <= 3, F.concat(F.lit("HP:004028"), F.least(F.col("l_linenumber"), F.lit(4))))
        .when(tax <= 5, F.concat_ws("/", F.least(quantity, F.lit(9)).cast("string"), quantity.cast("string")))
        .when(tax <= 6, F.concat(percent.cast("string"), F.lit("%")))
        .otherwise(F.concat(percent.cast("string"), F.lit("-"), (percent + quantity).cast("string"), F.lit(" %")))
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """One source assertion per order line."""
    line = table(spark, sf, "lineitem")
    order = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"
    )
    day = F.unix_date(F.to_date("l_shipdate"))
    return line.join(order, line.l_orderkey == order.o_orderkey).select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day).alias("source_id"),
        F.concat(F.lit("C:"), "o_custkey").alias("subject"),
        _finding().alias("finding"),
        _relation().alias("relation"),
        F.when(F.col("l_returnflag") == "A", "excluded").otherwise("present").alias("polarity"),
        frequency_raw().alias("frequency_raw"),
        F.concat(F.lit("rel:"), "o_orderstatus").alias("release"),
        F.col("o_orderpriority").alias("family"),
        F.concat(F.lit("O:"), "o_orderkey").alias("record_id"),
        F.concat(F.lit("E:"), "l_suppkey").alias("curator"),
    )


def _finding():
    return F.when(
        F.col("l_linenumber") == 7,
        F.concat(F.lit("S:"), F.floor(F.col("l_partkey") / 10).cast("bigint")),
    ).otherwise(F.concat(F.lit("F:"), "l_partkey"))


def _relation():
    return F.when(F.col("l_linestatus") == "O", "has_symptom").otherwise("has_sign")


def assertions(spark: SparkSession, sf: str) -> DataFrame:
    """Source assertions with the parsed frequency."""

    def build() -> DataFrame:
        parsed = frequency.parse_frequency(F.col("frequency_raw"))
        return lines(spark, sf).withColumn("frequency", parsed).withColumn(
            "estimate", frequency.estimate(F.col("frequency"))
        )

    return _memo(spark, sf, "assertions", build)


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct statements without ids, for queries that ask for none."""
    return _memo(
        spark, sf, "statements",
        lambda: lines(spark, sf).select("subject", "relation", "finding", "polarity").distinct(),
    )


def canonical_bridge(spark: SparkSession, sf: str) -> DataFrame:
    """Source assertion to canonical assertion, with the columns scoring needs."""
    return _memo(
        spark, sf, "canonical_bridge",
        lambda: resolve.with_canonical_id(lines(spark, sf).drop("frequency_raw")),
    )


def canonical(spark: SparkSession, sf: str) -> DataFrame:
    """One row per distinct statement."""
    return _memo(
        spark, sf, "canonical",
        lambda: resolve.with_canonical_id(statements(spark, sf)).select(
            "canonical_id", "subject", "relation", "finding", "polarity"
        ),
    )


def families(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence families with their dependency type."""
    return (
        table(spark, sf, "orders").select(F.col("o_orderpriority").alias("family")).distinct()
        .withColumn(
            "dependency_type",
            F.when(F.col("family") == "4-NOT SPECIFIED", "unknown").otherwise("primary"),
        )
    )


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """One observation per order and finding: present beats absent beats unknown."""

    def build() -> DataFrame:
        line = table(spark, sf, "lineitem")
        return (
            line.select(
                F.concat(F.lit("O:"), "l_orderkey").alias("case_id"),
                _finding().alias("finding"),
                _relation().alias("relation"),
                F.col("l_returnflag").alias("flag"),
            )
            .groupBy("case_id", "finding")
            .agg(
                F.min("relation").alias("relation"),
                F.when(F.max((F.col("flag") == "N").cast("int")) == 1, "present")
                .when(F.max((F.col("flag") == "A").cast("int")) == 1, "absent")
                .otherwise("unknown")
                .alias("status"),
            )
        )

    return _memo(spark, sf, "observations", build)


def concepts(spark: SparkSession, sf: str) -> DataFrame:
    """Findings from parts and subjects from customers."""
    nodes = part_nodes(table(spark, sf, "part"))
    findings = nodes.select(
        F.explode(F.array("leaf", "series", "kind", "type", "brand", F.lit(ROOT))).alias("concept_id")
    ).distinct().select("concept_id", F.lit("finding").alias("kind"), F.lit("active").alias("status"))
    subjects = table(spark, sf, "customer").select(
        F.concat(F.lit("C:"), "c_custkey").alias("concept_id"),
        F.lit("condition").alias("kind"),
        F.when(F.col("c_acctbal") < 0, "obsolete").otherwise("active").alias("status"),
    )
    return findings.unionByName(subjects)


def designations(spark: SparkSession, sf: str) -> DataFrame:
    """Labels and aliases of part concepts in three languages."""
    part = table(spark, sf, "part")
    name, brand, kind = F.col("p_name"), F.col("p_brand"), F.col("p_type")
    key = F.col("p_partkey").cast("string")
    rows = F.array(
        _term("en", "preferred", name),
        _term("en", "synonym", F.concat_ws(" ", brand, name)),
        _term("fr", "preferred", F.concat_ws(" ", F.lower(kind), name)),
        _term("fr", "ui_alias", F.concat_ws(" ", name, key)),
        _term("de", "fully_specified_name", F.concat_ws(" ", name, key, F.lower(kind))),
        _term("de", "ui_preferred", F.concat_ws(" ", name, F.lower(brand), key)),
    )
    return part.select(F.concat(F.lit("F:"), "p_partkey").alias("concept_id"), F.inline(rows))


def _term(language, scope, text):
    return F.struct(
        F.lit(language).alias("language"), F.lit(scope).alias("scope"), text.alias("text")
    )


def identifiers(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of part concepts: one primary code each and a shared brand code."""
    part = table(spark, sf, "part")
    rows = F.array(
        F.struct(F.lit(SYSTEM).alias("system"), F.concat(F.lit("P-"), "p_partkey").alias("code"),
                 F.lit("primary").alias("relation")),
        F.struct(F.lit("urn:evisift:brand").alias("system"),
                 F.concat_ws("/", "p_brand", "p_name").alias("code"),
                 F.lit("source_code").alias("relation")),
    )
    return part.select(F.concat(F.lit("F:"), "p_partkey").alias("concept_id"), F.inline(rows))


def mappings(spark: SparkSession, sf: str) -> DataFrame:
    """Crosswalk from supplier-side codes to part concepts, some of them not resolved."""
    part = table(spark, sf, "part")
    resolved = F.col("p_size") <= 40
    return part.select(
        F.concat(F.lit("M:"), "p_partkey").alias("mapping_id"),
        F.concat(F.lit("X:"), "p_name", F.lit("/"), "p_size").alias("target_code"),
        F.lit("urn:evisift:crosswalk").alias("target_system"),
        F.when(F.col("p_type") == "ECONOMY", "related").otherwise("exact").alias("relation"),
        F.when(resolved, "resolved").otherwise("unresolved").alias("resolution_status"),
        F.when(resolved, F.concat(F.lit("F:"), "p_partkey")).alias("target_concept_id"),
    )


def phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct four-word runs of every benchmark text, each pointing to its items."""
    words = normalize.tokens(normalize.normalize_label(F.col("text")))
    return (
        table(spark, sf, "benchmark")
        .select(
            F.concat(F.lit("I:"), "item_id").alias("concept_id"),
            F.explode(normalize.word_ngrams(words, 4)).alias("phrase"),
        )
        .distinct()
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Text-mined candidates: one per document, reviewed where a label exists."""
    document = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    label = table(spark, sf, "labels")
    return document.join(label, "doc_id", "left").select(
        F.concat(F.lit("D:"), "doc_id").alias("candidate_id"),
        "lang",
        "source",
        "n_chars",
        F.when(F.col("quality").isNull(), "unreviewed")
        .when(F.col("quality") == 1, "approved")
        .otherwise("rejected")
        .alias("status"),
        F.coalesce(F.col("toxic"), F.lit(0)).alias("toxic"),
    )


def review_events(spark: SparkSession, sf: str) -> DataFrame:
    """Append-only review log: an item is one day of ten users, who review it.

    An adjudication cites the review it directly follows, so it counts exactly where that
    review is the only current one.
    """
    event = table(spark, sf, "events")
    kind = F.col("event_type")
    rows = event.select(
        F.concat_ws(":", F.date_format("ts", "yyyy-MM-dd"), F.floor(F.col("user_id") / 10).cast("bigint")).alias("item"),
        F.concat(F.lit("R:"), "user_id").alias("reviewer"),
        F.when(kind == "error", "adjudication").otherwise("review").alias("stage"),
        F.when(kind == "view", "reject").when(kind == "signup", "defer").otherwise("approve").alias("decision"),
        F.when(F.col("value") < 10, "minor").otherwise("major").alias("category"),
        F.when(kind == "purchase", "exact").alias("mapping"),
        F.col("event_id").alias("sequence"),
        F.md5(F.concat_ws("|", "event_id", "user_id", "event_type")).alias("event_hash"),
    )
    before = W.partitionBy("item").orderBy("sequence")
    cited = F.when(
        (F.col("stage") == "adjudication") & (F.lag("stage").over(before) == "review"),
        F.array(F.lag("event_hash").over(before)),
    ).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("basis", cited)

"""Corpus audit counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bounds of the statements-per-subject buckets.
BUCKETS = ((1, "1"), (2, "2"), (5, "3-5"), (10, "6-10"), (20, "11-20"), (50, "21-50"))


def frequency_tables(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every value of every column as ``(attribute, value, n)`` in one pass."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("attribute"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return df.select(F.inline(pairs)).groupBy("attribute", "value").agg(F.count("*").alias("n"))


def bucket(count: Column) -> Column:
    expr = F.when(F.lit(False), "")
    for upper, name in BUCKETS:
        expr = expr.when(count <= upper, name)
    return expr.otherwise("51+")


def per_subject_histogram(statements: DataFrame) -> DataFrame:
    per = statements.groupBy("subject").agg(F.count("*").alias("statements"))
    return per.groupBy(bucket(F.col("statements")).alias("bucket")).agg(
        F.count("*").alias("subjects"), F.sum("statements").alias("statements")
    )


def threshold_counts(statements: DataFrame, thresholds: list[int]) -> DataFrame:
    """Subjects with at least so many statements."""
    per = statements.groupBy("subject").agg(F.count("*").alias("n"))
    return per.agg(*[F.count_if(F.col("n") >= t).alias(f"at_least_{t}") for t in thresholds])


def exclusive_classes(subjects: DataFrame, markers: dict[str, DataFrame]) -> DataFrame:
    """One class per subject: the first marker set it is in, plus how many it is in.

    ``markers`` maps class names, in order of precedence, to ``(subject)`` frames.
    """
    rows = subjects.select("subject").distinct()
    for name, marked in markers.items():
        flag = marked.select("subject").distinct().withColumn(f"_{name}", F.lit(1))
        rows = rows.join(flag, "subject", "left")
    label = F.when(F.lit(False), "")
    for name in markers:
        label = label.when(F.col(f"_{name}") == 1, name)
    overlap = reduce(lambda a, b: a + b, [F.coalesce(f"_{n}", F.lit(0)) for n in markers])
    return rows.select("subject", label.otherwise("unclassified").alias("class"), overlap.alias("markers"))


def cross_counts(rows: DataFrame, domains: DataFrame) -> DataFrame:
    """Domain by release; subjects without a domain count as unclassified."""
    classified = rows.join(domains, "subject")
    rest = rows.join(domains.select("subject").distinct(), "subject", "left_anti").withColumn(
        "domain", F.lit("unclassified")
    )
    return (
        classified.select("domain", "release", "subject")
        .unionByName(rest.select("domain", "release", "subject"))
        .groupBy("domain", "release")
        .agg(F.count("*").alias("assertions"), F.count_distinct("subject").alias("subjects"))
    )


def opposing_findings(statements: DataFrame) -> DataFrame:
    """Findings a relation states with both polarities, and how evenly they divide the subjects."""
    polarity = F.col("polarity")
    per = statements.groupBy("finding", "relation", "subject").agg(
        F.max((polarity == "present").cast("int")).alias("p"),
        F.max((polarity == "excluded").cast("int")).alias("x"),
    )
    return (
        per.groupBy("finding", "relation")
        .agg(F.sum("p").alias("present"), F.sum("x").alias("excluded"))
        .filter((F.col("present") > 0) & (F.col("excluded") > 0))
        .withColumn("separation", F.least("present", "excluded"))
    )


def opposed(statements: DataFrame) -> DataFrame:
    """``(finding, relation)`` stated with both polarities, without counting subjects."""
    polarity = F.col("polarity")
    per = statements.groupBy("finding", "relation").agg(
        F.max(polarity == "present").alias("p"), F.max(polarity == "excluded").alias("x")
    )
    return per.filter("p AND x").select("finding", "relation")


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    return df.orderBy(*order).limit(k)


def subjects_with_discriminant(statements: DataFrame, opposing: DataFrame) -> DataFrame:
    return (
        statements.join(opposing.select("finding", "relation"), ["finding", "relation"], "left_semi")
        .agg(F.count_distinct("subject").alias("subjects"))
    )


def dedup_statistics(bridge: DataFrame, scorable: DataFrame) -> DataFrame:
    """Source against canonical counts, statements several releases share, and statements that may score."""
    per = bridge.groupBy("canonical_id").agg(
        F.count_distinct("source_id").alias("sources"), F.count_distinct("release").alias("releases")
    )
    marked = per.join(scorable.select("canonical_id", F.lit(True).alias("scores")).distinct(), "canonical_id", "left")
    return marked.agg(
        F.sum("sources").alias("source_assertions"),
        F.count("*").alias("canonical_assertions"),
        (F.sum("sources") - F.count("*")).alias("collapsed"),
        F.count_if(F.col("releases") > 1).alias("multi_release"),
        F.count("scores").alias("scorable_canonical"),
    )


def release_overlap(bridge: DataFrame) -> DataFrame:
    """Canonical statements each pair of releases shares.

    Releases per statement are few, so pairs are formed inside the distinct release list.
    """
    per = bridge.groupBy("canonical_id").agg(F.array_sort(F.collect_set("release")).alias("r"))
    return (
        per.filter(F.size("r") > 1)
        .select("canonical_id", "r", F.posexplode("r").alias("i", "release_a"))
        .select("canonical_id", "release_a", F.explode(F.slice("r", F.col("i") + 2, F.size("r"))).alias("release_b"))
        .groupBy("release_a", "release_b")
        .agg(F.count("*").alias("shared"))
    )


def eligibility_counts(rows: DataFrame) -> DataFrame:
    """Distinct statements, subjects and findings that may score."""
    return rows.agg(
        F.count_distinct("subject", "relation", "finding", "polarity").alias("statements"),
        F.count_distinct("subject").alias("subjects"),
        F.count_distinct("finding").alias("findings"),
        F.count_distinct("subject", "finding").alias("pairs"),
    )


def single_release_subjects(rows: DataFrame, release: str) -> DataFrame:
    """Subjects documented by exactly this release."""
    return (
        rows.groupBy("subject")
        .agg(F.min("release").alias("low"), F.max("release").alias("high"))
        .filter((F.col("low") == release) & (F.col("high") == release))
        .select("subject")
    )


def subject_profiles(bridge: DataFrame) -> DataFrame:
    """Counts and joined attribute lists per subject."""

    def names(column: str) -> Column:
        return F.array_join(F.array_sort(F.collect_set(column)), ", ")

    return bridge.groupBy("subject").agg(
        F.count("*").alias("sources"),
        F.count_distinct("canonical_id").alias("statements"),
        F.count_distinct("finding").alias("findings"),
        names("release").alias("releases"),
        names("family").alias("families"),
        names("relation").alias("relations"),
    )


def expectations(actual: DataFrame, pinned: DataFrame) -> DataFrame:
    """Pinned counts that changed; both frames are ``(metric, value)``."""
    return (
        pinned.select("metric", F.col("value").alias("expected"))
        .join(actual, "metric", "full")
        .filter(~F.col("expected").eqNullSafe(F.col("value")))
    )


def topic_rollup(candidates: DataFrame) -> DataFrame:
    """Per topic the candidate count and the smallest attributes."""
    return candidates.groupBy("topic_id").agg(
        F.count("*").alias("candidates"), F.min("title").alias("title"),
        F.min("subject_status").alias("subject_status"),
    )


def mapping_suggestions(topics: DataFrame, labels: DataFrame, headings: DataFrame) -> DataFrame:
    """Codes suggested for a topic by label equality or by a heading cross-reference.

    ``topics(topic_id, label, heading)``, ``labels(label, code)``, ``headings(heading, code)``;
    topics without any suggestion keep one empty row.
    """
    by_label = topics.join(labels, "label").select("topic_id", "code").distinct().withColumn("a", F.lit("normalized_label"))
    by_heading = topics.join(headings, "heading").select("topic_id", "code").distinct().withColumn("b", F.lit("heading"))
    merged = by_label.join(by_heading, ["topic_id", "code"], "full").select(
        "topic_id", "code", F.concat_ws("; ", "b", "a").alias("basis")
    )
    return topics.select("topic_id").distinct().join(merged, "topic_id", "left").select(
        "topic_id", F.coalesce("code", F.lit("")).alias("code"), F.coalesce("basis", F.lit("")).alias("basis")
    )

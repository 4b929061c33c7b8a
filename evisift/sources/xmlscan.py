"""XML sources: bilingual associations, descriptors and topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.functions import codes, frequency, ids
from evisift.operators.hierarchy import tree_number_parents
from evisift.sources.archives import unpack_lines

ASSOCIATION_SCHEMA = """
OrphaCode string, Name string, ExpertLink string,
HPODisorderAssociationList struct<HPODisorderAssociation array<struct<
  _id string,
  HPO struct<HPOId string, HPOTerm string>,
  HPOFrequency struct<_id string, Name string>,
  DiagnosticCriteria struct<Name string>>>>
"""
DESCRIPTOR_SCHEMA = """
DescriptorUI string, DescriptorName struct<String string>,
TreeNumberList struct<TreeNumber array<string>>,
ConceptList struct<Concept array<struct<TermList struct<Term array<struct<String string>>>>>>
"""
TOPIC_SCHEMA = """
_id string, _title string, _language string, _url string, `_date-created` string, `_meta-desc` string,
`also-called` array<string>, `full-summary` array<string>, `group` array<string>,
`mesh-heading` array<struct<descriptor struct<_id string, _VALUE string>>>,
`related-topic` array<struct<_id string, _url string, _VALUE string>>,
site array<struct<_title string, _url string, organization array<string>,
  `information-category` array<string>, `standard-description` array<string>>>
"""


def _read(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return (
        spark.read.format("xml").option("rowTag", row_tag).option("mode", "FAILFAST")
        .schema(schema).load(path)
    )


def scan_associations(
    spark: SparkSession, path: str, *, source: str, release: str, language: str
) -> DataFrame:
    """One row per subject-finding record of one language file."""
    rows = _read(spark, path, "Disorder", ASSOCIATION_SCHEMA)
    flat = rows.select(
        F.concat(F.lit("ORPHA:"), "OrphaCode").alias("subject_code"), F.col("Name").alias("subject_label"),
        F.col("ExpertLink").alias("reference"),
        F.explode("HPODisorderAssociationList.HPODisorderAssociation").alias("a"),
    )
    category = frequency.numeric_category(F.col("a.HPOFrequency._id"))
    parsed = frequency.parse_frequency(category)
    return flat.select(
        ids.stable_id("assertion", source, F.col("a._id")).alias("assertion_id"),
        F.col("a._id").alias("record_id"),
        "subject_code", "subject_label",
        F.col("a.HPO.HPOId").alias("finding_code"), F.col("a.HPO.HPOTerm").alias("finding_label"),
        F.col("a.HPOFrequency._id").alias("frequency_id"),
        parsed.alias("frequency"),
        F.when(parsed["kind"] == "excluded", "excluded").otherwise("present").alias("polarity"),
        F.lit(release).alias("release"), F.lit(language).alias("language"), "reference",
        F.col("a.HPOFrequency.Name").alias("frequency_label"),
        F.col("a.DiagnosticCriteria.Name").alias("diagnostic_criteria"),
    )


def association_problems(rows: DataFrame) -> DataFrame:
    """Rows with missing parts, unknown frequency ids or a record id used twice in one language."""
    missing = (
        F.col("record_id").isNull() | F.col("finding_code").isNull() | F.col("finding_label").isNull()
        | F.col("subject_label").isNull() | F.col("subject_code").isNull()
        | ~F.coalesce(F.col("subject_code").rlike(r"^ORPHA:\d+$"), F.lit(False))
    )
    unknown = F.col("frequency_id").isNotNull() & frequency.numeric_category(F.col("frequency_id")).isNull()
    bad = rows.select(
        "record_id", "language",
        F.when(missing, "missing_field").when(unknown, "unknown_frequency").alias("problem"),
    ).filter(F.col("problem").isNotNull())
    repeated = rows.groupBy("record_id", "language").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return bad.unionByName(
        repeated.select("record_id", "language", F.lit("duplicate_record").alias("problem"))
    )


def scan_descriptors(spark: SparkSession, path: str) -> DataFrame:
    """Descriptor with its terms, preferred first, and sorted tree numbers; gzip is unpacked as a stream first."""
    if path.lower().endswith(".gz"):
        path = unpack_lines(spark, path)
    rows = _read(spark, path, "DescriptorRecord", DESCRIPTOR_SCHEMA)
    name = F.btrim("DescriptorName.String")
    listed = F.flatten(
        F.transform(
            F.coalesce("ConceptList.Concept", F.array()),
            lambda c: F.transform(F.coalesce(c["TermList"]["Term"], F.array()), lambda t: F.btrim(t["String"])),
        )
    )
    others = F.filter(F.array_distinct(listed), lambda t: (t != "") & (t != F.col("name")))
    ordered = F.transform(
        F.array_sort(F.transform(others, lambda t: F.struct(F.lower(t).alias("k"), t.alias("t")))),
        lambda x: x["t"],
    )
    return rows.withColumn("name", name).select(
        F.btrim("DescriptorUI").alias("descriptor"), "name",
        F.concat(F.array("name"), ordered).alias("terms"),
        F.array_sort(F.transform(F.coalesce("TreeNumberList.TreeNumber", F.array()), lambda t: F.btrim(t))).alias(
            "tree_numbers"
        ),
    )


def descriptor_tables(descriptors: DataFrame, release: str) -> dict[str, DataFrame]:
    """Concept, designation, identifier and edge tables of the descriptors."""
    code = F.concat(F.lit("MESH:"), "descriptor")
    rows = descriptors.withColumn("code", code).withColumn("concept_id", ids.stable_id("concept", F.col("code")))
    numbers = rows.select("concept_id", F.explode("tree_numbers").alias("tree_number"))
    return {
        "concept": rows.select(
            "concept_id", F.lit("terminology").alias("kind"), F.lit("active").alias("status"),
            F.col("code").alias("primary_code"), F.lit(release).alias("release"),
        ),
        "designation": rows.select("concept_id", "name", F.explode("terms").alias("text")).select(
            "concept_id", F.lit("en").alias("language"), "text",
            F.when(F.col("text") == F.col("name"), "preferred").otherwise("entry_term").alias("scope"),
        ),
        "identifier": rows.select(
            "concept_id", codes.system(F.col("code")).alias("system"), "code", F.lit("identity").alias("relation")
        ),
        "edge": tree_number_parents(numbers),
    }


def scan_topics(spark: SparkSession, path: str) -> DataFrame:
    """Topic records from an XML file, or from a ZIP holding exactly one XML member."""
    if path.lower().endswith(".zip"):
        path = unpack_lines(spark, path, suffix=".xml")
    rows = _read(spark, path, "health-topic", TOPIC_SCHEMA)

    def texts(column: str):
        cleaned = F.transform(
            F.coalesce(F.col(f"`{column}`"), F.array()), lambda t: F.btrim(F.regexp_replace(t, r"\s+", " "))
        )
        return F.filter(cleaned, lambda t: t != "")

    return rows.select(
        F.btrim("_id").alias("topic_id"), F.btrim("_title").alias("title"), F.btrim("_language").alias("language"),
        F.btrim("_url").alias("url"), F.col("`_date-created`").alias("date_created"),
        F.col("`_meta-desc`").alias("meta_description"),
        texts("also-called").alias("synonyms"), texts("full-summary").alias("summaries"),
        texts("group").alias("groups"),
        F.transform(
            F.coalesce(F.col("`mesh-heading`"), F.array()),
            lambda h: F.struct(
                F.btrim(h["descriptor"]["_id"]).alias("descriptor_id"), F.btrim(h["descriptor"]["_VALUE"]).alias("label")
            ),
        ).alias("headings"),
        F.transform(
            F.coalesce(F.col("`related-topic`"), F.array()),
            lambda r: F.struct(r["_id"].alias("topic_id"), F.btrim(r["_VALUE"]).alias("title"), r["_url"].alias("url")),
        ).alias("related"),
        F.filter(
            F.transform(
                F.coalesce("site", F.array()),
                lambda s: F.struct(
                    s["_title"].alias("title"), s["_url"].alias("url"), s["organization"].alias("organizations"),
                    s["information-category"].alias("categories"),
                ),
            ),
            lambda s: s["title"].isNotNull() & s["url"].isNotNull(),
        ).alias("links"),
        F.concat(F.lit("health-topic[@id='"), F.btrim("_id"), F.lit("']")).alias("source_locator"),
    )


def topic_problems(topics: DataFrame) -> DataFrame:
    required = ("topic_id", "title", "language", "url")
    empty = F.lit(False)
    for c in required:
        empty = empty | (F.coalesce(c, F.lit("")) == "")
    bad = topics.filter(empty).select("topic_id", F.lit("missing_field").alias("problem"))
    twice = topics.groupBy("topic_id").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    return bad.unionByName(twice.select("topic_id", F.lit("duplicate_topic").alias("problem")))

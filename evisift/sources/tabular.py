"""Tab-separated sources: graph edges and RF2 release files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.functions import codes, frequency, ids
from evisift.session import materialize
from evisift.sources.blocks import member_lines

# The rows kept from a knowledge-graph edge file.
EDGE_PREDICATE = "biolink:has_phenotype"
EDGE_CATEGORY = "biolink:DiseaseToPhenotypicFeatureAssociation"
EDGE_REQUIRED = (
    "id", "predicate", "category", "subject", "object", "primary_knowledge_source", "aggregator_knowledge_source", "file_source",
)
# RF2 type ids of fully specified names and is-a relationships.
RF2_FSN = "900000000000003001"
RF2_IS_A = "116680003"


def _blank_to_null(column):
    return F.nullif(frequency.strip_blanks(column), F.lit(""))


def scan_graph_edges(
    spark: SparkSession, path: str, *, member: str, subjects: DataFrame, findings: DataFrame
) -> DataFrame:
    """Subject-finding edges of a tar.gz whose two codes are both known.

    ``subjects(code)`` and ``findings(code)``; numbers come typed, with the row number kept.
    """
    lines = materialize(member_lines(spark, path, member=member), "edge-lines")
    header = lines.filter(F.col("ordinal") == 1).select("value").first()
    names = header["value"].split("\t") if header else []
    absent = [c for c in EDGE_REQUIRED if c not in names]
    if absent:
        raise ValueError(f"edge file lacks columns {absent}")
    schema = ", ".join(f"`{n}` string" for n in names)
    # plain tab splitting: quotes are data in these files unless they open a field
    rows = lines.filter(F.col("ordinal") > 1).select(
        "ordinal", F.from_csv("value", schema, {"sep": "\t"}).alias("r")
    ).select("ordinal", "r.*")

    def optional(name: str):
        return _blank_to_null(F.col(name)) if name in names else F.lit(None).cast("string")

    kept = rows.filter((F.col("predicate") == EDGE_PREDICATE) & (F.col("category") == EDGE_CATEGORY))
    kept = kept.join(subjects.select(F.col("code").alias("subject")), "subject", "left_semi")
    kept = kept.join(findings.select(F.col("code").alias("object")), "object", "left_semi")
    negated = F.coalesce(F.lower(optional("negated")) == "true", F.lit(False))
    count, total = optional("has_count").try_cast("int"), optional("has_total").try_cast("int")
    percent = optional("has_percentage").try_cast("double")
    return kept.select(
        F.col("id").alias("edge_id"), F.col("subject").alias("subject_code"), F.col("object").alias("finding_code"),
        "primary_knowledge_source", "aggregator_knowledge_source", "file_source",
        negated.alias("negated"), count.alias("has_count"), total.alias("has_total"),
        percent.alias("has_percentage"), optional("has_quotient").try_cast("double").alias("has_quotient"),
        optional("onset_qualifier").alias("onset"), optional("publications").alias("publications"),
        frequency.association_frequency(negated, count, total, percent).alias("frequency"),
        F.concat(F.lit(f"{member}:row="), "ordinal", F.lit(":id="), "id").alias("source_locator"),
    )


def graph_assertions(
    edges: DataFrame, subjects: DataFrame, findings: DataFrame, *, source: str, release: str,
    artifact_sha256: str, shared: dict[str, str],
) -> DataFrame:
    """Source assertions of graph edges; ``shared`` maps a primary source to a common family."""
    subject = subjects.select(F.col("code").alias("subject_code"), F.col("concept_id").alias("subject"))
    finding = findings.select(F.col("code").alias("finding_code"), F.col("concept_id").alias("finding"))
    upstream = F.col("primary_knowledge_source")
    family = ids.stable_id("evidence_family", "graph-upstream", upstream)
    dependency = F.lit("derived_from")
    for name, common in shared.items():
        family = F.when(upstream == name, F.lit(common)).otherwise(family)
        dependency = F.when(upstream == name, F.lit("shared_upstream")).otherwise(dependency)
    return edges.join(subject, "subject_code").join(finding, "finding_code").select(
        ids.source_assertion_id(
            F.lit(source), F.lit(release), F.array(F.lit(artifact_sha256)),
            F.col("source_locator"), F.lit(0),
        ).alias("source_id"),
        "subject", F.lit("has_sign").alias("relation"), "finding",
        F.when(F.col("negated"), "excluded").otherwise("present").alias("polarity"),
        "frequency", "onset",
        F.lit(f"{source}:{release}").alias("release"),
        ids.stable_id("source_record", f"{source}:{release}", F.col("edge_id")).alias("record_id"),
        family.alias("family"), dependency.alias("dependency_type"), upstream.alias("primary_source"),
    )


def _tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", "")
    rows = reader.csv(path)
    absent = [c for c in columns if c not in rows.columns]
    if absent:
        raise ValueError(f"{path} lacks columns {absent}")
    return rows.select(*columns)


def scan_rf2(
    spark: SparkSession, concepts: str, descriptions: str, relationships: str, *, system: str, release: str,
    fsn_type: str = RF2_FSN, is_a_type: str = RF2_IS_A,
) -> dict[str, DataFrame]:
    """Active concepts, designations, identifiers, is-a edges and the rows that must be refused."""
    concept_rows = _tsv(spark, concepts, ["id", "active"])
    description_rows = _tsv(
        spark, descriptions, ["id", "active", "conceptId", "languageCode", "typeId", "term"]
    )
    relation_rows = _tsv(spark, relationships, ["id", "active", "sourceId", "destinationId", "typeId"])
    flags = [
        df.filter(~F.col("active").isin("0", "1")).select("id", F.lit("invalid_active_flag").alias("problem"))
        for df in (concept_rows, description_rows, relation_rows)
    ]
    active = concept_rows.filter("active = '1'").select(F.col("id").alias("code"))
    described = description_rows.filter("active = '1'").join(
        active.withColumnRenamed("code", "conceptId"), "conceptId", "left_semi"
    )
    fsn = described.filter(F.col("typeId") == fsn_type).groupBy("conceptId").agg(
        F.min_by("term", "id").alias("name")
    )
    named = active.join(fsn.withColumnRenamed("conceptId", "code"), "code", "left").withColumn(
        "kind", codes.kind_from_name(F.col("name"))
    )
    concept_id = ids.stable_id("concept", system, F.col("code"))
    concept = named.filter(F.col("kind").isNotNull()).select(
        concept_id.alias("concept_id"), "kind", F.lit("active").alias("status"),
        F.col("code").alias("primary_code"), F.lit(release).alias("release"),
    )
    edges = relation_rows.filter((F.col("active") == "1") & (F.col("typeId") == is_a_type))
    known = concept.select(F.col("primary_code"), "concept_id")
    joined = edges.join(known.toDF("sourceId", "child"), "sourceId", "left").join(
        known.toDF("destinationId", "parent"), "destinationId", "left"
    )
    outside = F.col("child").isNull() | F.col("parent").isNull()
    problems = flags[0].unionByName(flags[1]).unionByName(flags[2])
    problems = problems.unionByName(
        named.filter(F.col("name").isNull()).select(F.col("code").alias("id"), F.lit("missing_name").alias("problem"))
    ).unionByName(
        named.filter(F.col("name").isNotNull() & F.col("kind").isNull()).select(
            F.col("code").alias("id"), F.lit("unsupported_kind").alias("problem")
        )
    ).unionByName(joined.filter(outside).select("id", F.lit("edge_outside_subset").alias("problem")))
    return {
        "concept": concept,
        "designation": described.join(known.toDF("conceptId", "concept_id"), "conceptId").select(
            ids.stable_id("designation", release, F.col("id")).alias("designation_id"), "concept_id",
            F.col("languageCode").alias("language"), F.col("term").alias("text"),
            F.when(F.col("typeId") == fsn_type, "fully_specified_name").otherwise("synonym").alias("scope"),
        ),
        "identifier": concept.select(
            ids.stable_id("external_identifier", F.col("concept_id"), system, F.col("primary_code")).alias(
                "external_identifier_id"
            ),
            "concept_id", F.lit(system).alias("system"), F.col("primary_code").alias("code"),
            F.lit("identity").alias("relation"),
        ),
        "edge": joined.filter(~outside).select(
            ids.stable_id("hierarchy_edge", release, F.col("id")).alias("hierarchy_edge_id"), "child", "parent"
        ),
        "problem": problems,
    }

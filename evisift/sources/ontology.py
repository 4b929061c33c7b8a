"""Ontology graph JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evisift.functions import codes, ids
from evisift.sources import blocks

# Nodes and edges of a graph are told apart by their fields.
ELEMENT = """
id string, type string, lbl string, meta struct<
  deprecated boolean,
  synonyms array<struct<pred string, val string>>,
  basicPropertyValues array<struct<pred string, val string>>,
  xrefs array<struct<val string>>>,
sub string, pred string, obj string
"""
# The document, its list of graphs, a graph, its list of nodes or edges, a node or edge.
ELEMENT_DEPTH = 5
MAPPED_PREFIXES = ("DOID:", "MESH:", "MONDO:")


@dataclass(frozen=True)
class Ontology:
    concept: DataFrame
    term: DataFrame
    identifier: DataFrame
    replaced_by: DataFrame
    mapping: DataFrame
    edge: DataFrame
    unresolved_edge: DataFrame


def read_graph(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """Nodes and edges of all graphs of an OBO Graphs document, read in byte ranges."""
    elements = blocks.json_elements(spark, path, ELEMENT_DEPTH, **options)
    return elements.select(F.from_json("value", ELEMENT, {"mode": "FAILFAST"}).alias("n")).select("n.*")


def _nodes(graph: DataFrame, extended: bool) -> DataFrame:
    return graph.filter(F.col("id").isNotNull() & F.col("sub").isNull()).select(
        codes.compact(F.col("id"), extended=extended).alias("code"), "type", F.col("lbl").alias("label"), "meta"
    )


def scan(
    spark: SparkSession, path: str, *, prefix: str, kind: str, release: str, language: str = "en"
) -> Ontology:
    """Concepts, terms, identifiers, replacements, mappings and same-prefix is-a edges."""
    graph = read_graph(spark, path)
    nodes = _nodes(graph, False).filter((F.col("type") == "CLASS") & F.col("code").startswith(prefix))
    base = nodes.withColumn("concept_id", ids.stable_id("concept", F.col("code"))).withColumn(
        "label", F.coalesce("label", "code")
    )
    concept = base.select(
        "concept_id", F.col("code").alias("external_id"), F.lit(kind).alias("kind"), "label",
        F.coalesce("meta.deprecated", F.lit(False)).alias("obsolete"), F.lit(release).alias("release"),
    ).dropDuplicates(["concept_id"])
    synonyms = base.select("concept_id", F.explode("meta.synonyms").alias("s")).select(
        "concept_id", F.col("s.val").alias("text"), F.coalesce("s.pred", F.lit("related")).alias("scope")
    )
    term = (
        base.select("concept_id", F.col("label").alias("text"), F.lit("preferred").alias("scope"))
        .unionByName(synonyms)
        .withColumn("language", F.lit(language))
        .distinct()
    )
    properties = base.select("concept_id", "code", F.explode("meta.basicPropertyValues").alias("p")).select(
        "concept_id", "code", F.col("p.pred").alias("pred"), codes.compact(F.col("p.val")).alias("target")
    )
    primary = base.select("concept_id", F.col("code").alias("identifier"), F.lit("primary").alias("relation"))
    alternative = properties.filter(F.col("pred").endswith("hasAlternativeId")).select(
        "concept_id", F.col("target").alias("identifier"), F.lit("alternative").alias("relation")
    )
    replaced = properties.filter(F.col("pred").endswith("IAO_0100001")).select("concept_id", "code", "target")
    matches = properties.filter(
        F.contains("pred", F.lit("Match")) & F.col("target").startswith("ORPHA:")
    ).select("concept_id", "target", F.element_at(F.split("pred", "#"), -1).alias("relation"))
    xrefs = base.select("concept_id", F.explode("meta.xrefs").alias("x")).select(
        "concept_id", codes.compact(F.col("x.val")).alias("target")
    ).filter(F.col("target").startswith("ORPHA:")).withColumn("relation", F.lit("xref"))
    mapping = (
        matches.unionByName(xrefs)
        .unionByName(replaced.select("concept_id", "target", F.lit("replaced_by").alias("relation")))
        .distinct()
    )
    pairs = graph.filter(F.col("sub").isNotNull()).select(
        codes.compact(F.col("sub")).alias("child_code"), "pred", codes.compact(F.col("obj")).alias("parent_code")
    ).filter(
        (F.col("pred") == "is_a") & F.col("child_code").startswith(prefix) & F.col("parent_code").startswith(prefix)
    ).drop("pred").distinct()
    known = concept.select("external_id", "concept_id")
    resolved = pairs.join(
        known.toDF("child_code", "child"), "child_code", "left"
    ).join(known.toDF("parent_code", "parent"), "parent_code", "left")
    missing = F.col("child").isNull() | F.col("parent").isNull()
    return Ontology(
        concept, term, primary.unionByName(alternative).distinct(),
        replaced.select(F.col("code").alias("concept_code"), F.col("target").alias("replacement_code")).distinct(),
        mapping, resolved.filter(~missing).select("child", "parent"),
        resolved.filter(missing).select("child_code", "parent_code"),
    )


def scan_xrefs(
    spark: SparkSession, path: str, concepts: DataFrame, release: str
) -> tuple[DataFrame, DataFrame]:
    """``(identifiers, mappings)`` from cross-references of known nodes.

    ``concepts(concept_id, primary_code)``; only three target prefixes become mappings.
    """
    nodes = _nodes(read_graph(spark, path), True)
    known = concepts.select(F.col("primary_code").alias("code"), "concept_id")
    refs = (
        nodes.join(known, "code")
        .select("concept_id", "code", F.explode("meta.xrefs").alias("x"))
        .select("concept_id", "code", F.col("x.val").alias("raw"))
        .withColumn("target_code", codes.compact(F.col("raw"), extended=True))
        .filter(F.contains("target_code", F.lit(":")))
    )
    identifiers = refs.select(
        "concept_id", codes.system(F.col("target_code")).alias("system"),
        F.col("target_code").alias("code"), F.lit("xref").alias("relation"), F.lit(release).alias("release"),
    ).distinct()
    wanted = F.lit(False)
    for p in MAPPED_PREFIXES:
        wanted = wanted | F.col("target_code").startswith(p)
    targets = concepts.select(
        F.col("primary_code").alias("target_code"), F.col("concept_id").alias("target_concept_id")
    )
    unresolved = F.col("target_concept_id").isNull()
    mappings = refs.filter(wanted).join(targets, "target_code", "left").select(
        ids.stable_id("mapping", F.col("concept_id"), F.col("target_code"), "xref", release).alias("mapping_id"),
        F.col("concept_id").alias("source_concept_id"), "target_concept_id",
        codes.system(F.col("target_code")).alias("target_system"), "target_code",
        F.lit("source_to_target").alias("direction"),
        F.when(unresolved, "unresolved").otherwise("related").alias("relation"),
        F.when(unresolved, "unresolved").otherwise("resolved").alias("resolution_status"),
    ).dropDuplicates(["mapping_id"])
    return identifiers, mappings

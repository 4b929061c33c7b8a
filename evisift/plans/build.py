"""Corpus builds: simple tables to the canonical model, and pending curation packages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evisift.functions import codes, ids
from evisift.operators import resolve
from evisift.operators.hierarchy import ancestor_closure

# Simple concept kind -> canonical kind.
KINDS = {"disease": "condition", "phenotype": "finding"}


def project_simple_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Canonical tables from the simple model.

    Expects concept, term, identifier, edge, mapping and assertion tables as the ontology and
    association scans produce them; assertions carry ``subject, finding`` concept ids,
    ``source, release_name, artifact_hashes, record_id, polarity, frequency``.
    """
    kind = F.coalesce(
        F.try_element_at(F.create_map(*[F.lit(x) for p in KINDS.items() for x in p]), F.col("kind")), F.col("kind")
    )
    concept = tables["concept"].select(
        "concept_id", kind.alias("kind"), F.when(F.col("obsolete"), "obsolete").otherwise("active").alias("status"),
        F.col("external_id").alias("primary_code"), "release",
    )
    identifier = tables["identifier"].select(
        ids.stable_id("identifier", F.col("concept_id"), F.col("identifier")).alias("external_identifier_id"),
        "concept_id", codes.system(F.col("identifier"), legacy=True).alias("system"),
        F.col("identifier").alias("code"), "relation",
    )
    mapping = resolve.normalise_mapping(
        tables["mapping"].select(
            ids.stable_id("mapping", F.col("concept_id"), F.col("target"), F.col("relation")).alias("mapping_id"),
            F.col("concept_id").alias("source_concept_id"), F.col("target").alias("target_external_id"), "relation",
        ),
        tables["concept"],
    ).withColumn("target_system", codes.system(F.col("target_external_id"), legacy=True)).withColumnRenamed(
        "target_external_id", "target_code"
    )
    release = F.concat_ws(":", "source", "release_name")
    sourced = tables["assertion"].select(
        ids.source_assertion_id(
            F.col("source"), F.col("release_name"), F.col("artifact_hashes"), F.col("record_id"), F.lit(0)
        ).alias("source_id"),
        "subject", F.lit("has_sign").alias("relation"), "finding", "polarity", "frequency",
        release.alias("release"), ids.stable_id("source_record", release, F.col("record_id")).alias("source_record_id"),
    )
    bridged = resolve.with_canonical_id(sourced, frequency="frequency")
    bridged = bridged.withColumn("family", ids.stable_id("evidence_family", F.col("release"), F.col("canonical_id")))
    return {
        "concept": concept,
        "designation": tables["term"].select(
            ids.stable_id("term", F.col("concept_id"), F.col("language"), F.col("text"), F.col("scope")).alias("designation_id"),
            "concept_id", "language", "text", "scope",
        ),
        "external_identifier": identifier,
        "hierarchy_edge": tables["edge"].select(
            ids.stable_id("edge", F.col("child"), F.col("parent")).alias("hierarchy_edge_id"), "child", "parent"
        ),
        "concept_mapping": mapping,
        "source_assertion": bridged,
        "canonical_assertion": resolve.canonical_assertions(bridged),
        "assertion_derivation": resolve.derivations(bridged),
        "family_member": resolve.family_members(bridged),
        "evidence_family": bridged.select("family").distinct().withColumn("dependency_type", F.lit("primary")),
    }


def canonicalize_package(package: dict[str, DataFrame], *, assertions_sha256: str, prefix: str) -> dict[str, DataFrame]:
    """Canonical tables of a package still under review; its review status stays visible."""
    manifest, sources = package["manifest"], package["sources"]
    origin = manifest.select(F.concat(F.lit("curation:"), "package_id").alias("release")).first()["release"]
    concepts = package["concepts"].select(
        F.struct("system", "code").alias("key"), "system", "code", "kind",
        F.concat(F.lit(f"{prefix}:"), "code").alias("concept_id"), "label_en", "label_fr",
    )
    labels = F.filter(
        F.array(
            F.struct(F.lit("en").alias("language"), F.col("label_en").alias("text")),
            F.struct(F.lit("fr").alias("language"), F.col("label_fr").alias("text")),
        ),
        lambda x: x["text"].isNotNull(),
    )
    known = concepts.select("key", "concept_id")

    def pick(df: DataFrame, column: str, name: str) -> DataFrame:
        keyed = df.withColumn("key", F.struct(F.col(f"{column}.system").alias("system"), F.col(f"{column}.code").alias("code")))
        return keyed.join(known.withColumnRenamed("concept_id", name), "key", "left").drop("key")

    release = sources.select(
        F.col("artifact_id").alias("source_artifact_id"), F.concat_ws(":", "artifact_id", "release").alias("release_id"),
        F.col("sha256").alias("artifact_sha256"), F.col("release").alias("artifact_release"),
    )
    mapped = pick(package["mappings"], "source", "source_concept_id").join(release, "source_artifact_id", "left")
    rows = pick(pick(package["assertions"], "subject", "subject_id"), "object", "finding_id").join(
        release, "source_artifact_id", "left"
    )
    sourced = rows.select(
        ids.source_assertion_id(
            F.col("source_artifact_id"), F.col("artifact_release"),
            F.array(F.col("artifact_sha256"), F.lit(assertions_sha256)), F.col("record_locator"), F.col("assertion_id"),
        ).alias("source_id"),
        F.col("subject_id").alias("subject"), "relation", F.col("finding_id").alias("finding"), "polarity",
        F.col("release_id").alias("release"), F.col("evidence_family_id").alias("family"),
        "dependency_type", "upstream_reference", "review_status",
        ids.stable_id("source_record", F.col("release_id"), F.col("assertion_id")).alias("source_record_id"),
    )
    bridged = resolve.with_canonical_id(sourced)
    family = resolve.pending_family_dependency(bridged).join(
        bridged.groupBy("family").agg(
            F.array_join(F.array_sort(F.collect_set("upstream_reference")), ";").alias("primary_reference")
        ),
        "family",
    )
    declared = sources.select(
        F.concat_ws(":", "artifact_id", "release").alias("release"),
        F.array(
            F.struct(
                F.coalesce("upstream_reference", F.concat_ws(":", "artifact_id", "release")).alias("upstream_reference"),
                F.coalesce("dependency_type", F.lit("primary")).alias("dependency_type"),
                F.concat(F.lit("curation receipt "), "artifact_id").alias("evidence"),
            )
        ).alias("dependencies"),
    )
    return {
        "concept": concepts.select(
            "concept_id", "kind", F.lit("active").alias("status"), F.col("code").alias("primary_code"), F.lit(origin).alias("release")
        ),
        "designation": concepts.select("concept_id", F.inline(labels)).withColumn("scope", F.lit("preferred")).withColumn(
            "designation_id", ids.stable_id("designation", F.col("concept_id"), F.col("language"), F.col("text"))
        ),
        "external_identifier": concepts.select("concept_id", "system", "code", F.lit("source_code").alias("relation")),
        "concept_mapping": mapped.select(
            "mapping_id", "source_concept_id",
            F.when(F.col("resolution_status") == "resolved", F.col("source_concept_id")).alias("target_concept_id"),
            F.col("target.system").alias("target_system"), F.col("target.code").alias("target_code"), "relation",
            "resolution_status", "review_status", F.col("release_id").alias("release"),
        ),
        "source_assertion": bridged,
        "canonical_assertion": resolve.canonical_assertions(bridged),
        "assertion_derivation": resolve.derivations(bridged),
        "family_member": resolve.family_members(bridged),
        "evidence_family": family,
        "source_dependency": resolve.dependency_rows(declared),
    }


def merge_corpora(parts: list[dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Union of canonical tables by name; missing columns become NULL."""
    names = sorted({name for part in parts for name in part})
    out = {}
    for name in names:
        frames = [p[name] for p in parts if name in p]
        merged = frames[0]
        for frame in frames[1:]:
            merged = merged.unionByName(frame, allowMissingColumns=True)
        out[name] = merged
    for name, key in (("canonical_assertion", "canonical_id"), ("assertion_derivation", "derivation_id")):
        if name in out:
            out[name] = out[name].dropDuplicates([key])
    return out


def register_views(tables: dict[str, DataFrame]) -> None:
    """Canonical tables and the ancestor closure as SQL views."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    if "hierarchy_edge" in tables:
        ancestor_closure(tables["hierarchy_edge"].select("child", "parent")).createOrReplaceTempView("ancestor")

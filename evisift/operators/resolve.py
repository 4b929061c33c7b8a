"""Entity resolution, deduplication and canonical tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evisift.functions import ids, normalize
from evisift.operators.hierarchy import best_per_key
from evisift.session import materialize

# Qualifiers of a statement.
QUALIFIER_FIELDS = (
    "age", "clinical_context", "evidence_level", "evidence_type", "frequency", "laterality", "location",
    "polarity", "population", "severity", "sex", "temporal_context",
)


# --- keyed inserts and obsolete ids -------------------------------------------------------


def keyed_insert(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``(kept, violations)``: equal repeats of a key collapse, differing repeats are errors and none of them is kept."""
    columns = [c for c in rows.columns if c != key]
    per_key = rows.groupBy(key).agg(
        F.count_distinct(ids.row_sha(*[F.col(c) for c in rows.columns])).alias("variants"),
        F.min(F.struct(*columns)).alias("_row"),
    )
    kept = per_key.filter(F.col("variants") == 1).select(*[F.col(f"_row.{c}").alias(c) if c != key else F.col(c) for c in rows.columns])
    return kept, per_key.filter(F.col("variants") > 1).select(key, "variants")


def resolve_obsolete(concepts: DataFrame, replacements: DataFrame) -> DataFrame:
    """Follow the unique replaced-by chain of every obsolete concept to an active one.

    ``concepts(concept_id, obsolete)``, ``replacements(concept_id, replacement)``.
    Result ``(concept_id, resolved, outcome)`` with outcome active / replaced / retired /
    ambiguous / unknown / cycle, one row per concept.

    Every round lets each concept point where its target points, so a chain of n links takes log2(n)
    rounds. What still points at a link after that many rounds runs in a cycle.
    """
    targets = replacements.distinct().groupBy("concept_id").agg(
        F.count("replacement").alias("n"), F.min("replacement").alias("next")
    )
    state = materialize(
        concepts.join(targets, "concept_id", "left").select(
            "concept_id", "obsolete", F.coalesce("n", F.lit(0)).alias("n"), "next"
        ),
        "replaced-by",
    )
    is_link = F.col("obsolete") & (F.col("n") == 1)
    links = state.filter(is_link)
    walk = links.select("concept_id", F.col("next").alias("at"))
    for _ in range(links.count().bit_length()):
        ahead = walk.select(F.col("concept_id").alias("at"), F.col("at").alias("further"))
        walk = materialize(
            walk.join(ahead, "at", "left").select("concept_id", F.coalesce("further", "at").alias("at")), "replaced-by"
        )
    ends = state.select(
        F.col("concept_id").alias("at"), F.col("obsolete").alias("at_obsolete"), F.col("n").alias("at_n")
    )
    reached = state.join(walk, "concept_id", "left").select("concept_id", F.coalesce("at", "concept_id").alias("at"))
    own = F.col("at") == F.col("concept_id")
    outcome = (
        F.when(F.col("at_obsolete").isNull(), "unknown")
        .when(~F.col("at_obsolete"), F.when(own, "active").otherwise("replaced"))
        .when(F.col("at_n") == 1, "cycle")
        .when(F.col("at_n") > 1, "ambiguous")
        .when(own, "retired")
        .otherwise("unknown")
    )
    return reached.join(ends, "at", "left").withColumn("outcome", outcome).select(
        "concept_id",
        F.when(F.col("outcome").isin("active", "replaced"), F.col("at")).alias("resolved"),
        "outcome",
    )


def merge_bilingual(records: DataFrame, key: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """Join language versions of one record; every other field must agree.

    ``records`` has ``key, language, provenance`` and payload columns.
    """
    rest = [c for c in records.columns if c not in (key, "language", "provenance")]
    grouped = records.groupBy(key).agg(
        *[F.min(c).alias(c) for c in rest],
        F.array_sort(F.collect_set("language")).alias("languages"),
        F.array_sort(F.collect_set("provenance")).alias("provenance"),
        F.count_distinct(ids.row_sha(*[F.col(c) for c in rest])).alias("_variants"),
    )
    conflicts = grouped.filter(F.col("_variants") > 1).select(key)
    return grouped.drop("_variants"), conflicts


def language_gaps(records: DataFrame, languages: int, key: str = "record_id") -> DataFrame:
    """Records that one of the language files lacks."""
    return (
        records.groupBy(key)
        .agg(F.count_distinct("language").alias("present_in"))
        .filter(F.col("present_in") < languages)
    )


# --- mappings -----------------------------------------------------------------------------


def normalise_mapping(mappings: DataFrame, concepts: DataFrame) -> DataFrame:
    """Exact matches become bidirectional ``exact``, others ``related``; missing targets unresolved."""
    target = concepts.select(
        F.col("external_id").alias("target_external_id"), F.col("concept_id").alias("target_concept_id")
    )
    relation = F.when(F.col("target_concept_id").isNull(), "unresolved").when(
        F.col("original_relation") == "exactMatch", "exact"
    ).otherwise("related")
    return (
        mappings.withColumnRenamed("relation", "original_relation")
        .join(target, "target_external_id", "left")
        .withColumn("relation", relation)
        .withColumn(
            "direction",
            F.when(F.col("relation") == "exact", "bidirectional").otherwise("source_to_target"),
        )
        .withColumn(
            "resolution_status",
            F.when(F.col("target_concept_id").isNull(), "unresolved").otherwise("resolved"),
        )
    )


def subject_label_index(
    designations: DataFrame, concepts: DataFrame, preferred: str, fallback: str
) -> DataFrame:
    """``(label, concepts, first, last)`` of the preferred vocabulary, else of the fallback, per label.

    The smallest and largest id tell one concept from several, so no id list is built for a label
    that many concepts share.
    """
    active = concepts.filter((F.col("kind") == "condition") & (F.col("status") == "active"))
    rows = designations.join(active.select("concept_id", "primary_code"), "concept_id").select(
        normalize.normalize_label(F.col("text")).alias("label"), "concept_id", "primary_code"
    )
    first = F.col("primary_code").startswith(preferred)
    second = F.col("primary_code").startswith(fallback)
    a, b = F.when(first, F.col("concept_id")), F.when(second & ~first, F.col("concept_id"))
    grouped = rows.filter(first | second).groupBy("label").agg(
        F.count_distinct(a).alias("na"), F.min(a).alias("a0"), F.max(a).alias("a1"),
        F.count_distinct(b).alias("nb"), F.min(b).alias("b0"), F.max(b).alias("b1"),
    )
    has = F.col("na") > 0
    return grouped.select(
        "label",
        F.when(has, F.col("na")).otherwise(F.col("nb")).alias("concepts"),
        F.when(has, F.col("a0")).otherwise(F.col("b0")).alias("first"),
        F.when(has, F.col("a1")).otherwise(F.col("b1")).alias("last"),
    )


def phrase_index(terms: DataFrame) -> DataFrame:
    """``(phrase, words, concepts, first)`` from ``terms(concept_id, text)``; texts without a word have no phrase."""
    phrase = normalize.normalize_label(F.col("text"))
    return (
        terms.select("concept_id", phrase.alias("phrase"))
        .withColumn("words", F.size(normalize.tokens(F.col("phrase"))))
        .filter("words > 0")
        .groupBy("phrase", "words")
        .agg(F.count_distinct("concept_id").alias("concepts"), F.min("concept_id").alias("first"))
    )


def propose_mapping(labels: DataFrame, index: DataFrame) -> DataFrame:
    """Subject proposals: ``labels(topic_id, label)`` against :func:`subject_label_index`.

    One match over all labels of a topic resolves it, several are ambiguous, none unresolved.
    """
    hits = (
        labels.select("topic_id", normalize.normalize_label(F.col("label")).alias("label"))
        .join(index, "label", "left")
        .groupBy("topic_id")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
    )
    matches = F.when(F.col("first").isNull(), 0).when(F.col("first") == F.col("last"), 1).otherwise(2)
    return hits.select(
        "topic_id",
        F.when(matches == 1, F.col("first")).alias("concept_id"),
        F.when(matches == 1, "exact").otherwise("unresolved").alias("relation"),
        mapping_status(matches).alias("status"),
    )


def mapping_status(matches: Column) -> Column:
    return F.when(matches == 1, "resolved").when(matches > 1, "ambiguous").otherwise("unresolved")


def phrase_matches(texts: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Distinct dictionary phrases in each text, overlaps kept.

    Every run of as many words as some phrase has becomes a join key, so the work is one hash
    join and never a text-by-phrase comparison.
    """
    words = texts.select(
        key, normalize.tokens(normalize.normalize_label(F.col("text"))).alias("words")
    )
    return word_run_matches(words, index, key)


def word_run_matches(texts: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """As :func:`phrase_matches` for texts already split into ``words``.

    A row holds the runs of one size at a time; the sizes are read from the dictionary as part of the query.
    """
    sizes = index.agg(F.collect_set("words").alias("sizes"))
    each = texts.select(key, "words", F.explode(sizes.scalar()).alias("size"))
    runs = normalize.word_ngrams(F.col("words"), F.col("size"))
    spans = each.select(key, F.explode(F.array_distinct(runs)).alias("phrase"))
    return spans.join(index.select("phrase", "words", "concepts", "first"), "phrase")


def extract_candidates(
    topics: DataFrame, index: DataFrame, proposals: DataFrame, *, language: str = "english"
) -> DataFrame:
    """Candidate statements of each topic in one language.

    ``topics(topic_id, language, release, locator, title, summary_index, text)`` has one row per
    summary. A phrase counts once per topic; the ordinal follows summary then phrase.
    """
    chosen = topics.filter(F.lower("language") == language)
    texts = chosen.withColumn("_k", F.struct("topic_id", "summary_index"))
    hits = phrase_matches(texts, index, "_k").select(
        F.col("_k.topic_id").alias("topic_id"),
        F.col("_k.summary_index").alias("summary_index"),
        "phrase", "concepts", "first",
    )
    first = hits.groupBy("topic_id", "phrase").agg(
        F.min("summary_index").alias("summary_index"), F.min("concepts").alias("concepts"),
        F.min("first").alias("first"),
    )
    order = W.partitionBy("topic_id").orderBy("summary_index", "phrase")
    heads = chosen.groupBy("topic_id").agg(
        F.min("title").alias("title"), F.min("release").alias("release"),
        F.min("locator").alias("topic_locator"),
    )
    subject = proposals.select(
        "topic_id",
        F.struct("concept_id", "relation", "status").alias("subject_mapping"),
    )
    matches = F.col("concepts")
    out = (
        first.withColumn("ordinal", F.row_number().over(order) - 1)
        .join(heads, "topic_id")
        .join(subject, "topic_id", "left")
        .withColumn(
            "object_mapping",
            F.struct(
                F.when(matches == 1, F.col("first")).alias("concept_id"),
                F.when(matches == 1, "exact").otherwise("unresolved").alias("relation"),
                mapping_status(matches).alias("status"),
            ),
        )
        .withColumn(
            "source_locator",
            F.concat(
                F.col("topic_locator"), F.lit("/full-summary["),
                (F.col("summary_index") + 1).cast("string"), F.lit("]/"), F.col("phrase"),
            ),
        )
        .withColumn("source_record_id", ids.stable_id("source_record", F.col("release"), F.col("topic_id")))
    )
    # the candidate takes the ordinal, the assertion made from it the next one
    return out.select(
        ids.candidate_assertion_id(
            F.col("release"), F.col("source_record_id"), F.col("source_locator"), F.col("ordinal")
        ).alias("candidate_id"),
        "topic_id", "title", "release", "source_record_id", "source_locator",
        F.col("phrase").alias("object_text"),
        "subject_mapping", "object_mapping", "ordinal",
        (F.col("ordinal") + 1).alias("assertion_ordinal"),
        F.lit("unreviewed").alias("review_status"),
        rejection_reason(F.col("subject_mapping"), F.col("object_mapping")).alias("rejection"),
    )


def technically_eligible(subject: Column, obj: Column, review_status: Column) -> Column:
    def good(m):
        return (m["status"] == "resolved") & m["relation"].isin("exact", "equivalent")

    return F.coalesce((review_status != "rejected") & good(subject) & good(obj), F.lit(False))


def rejection_reason(subject: Column, obj: Column) -> Column:
    """Why a candidate cannot become an assertion; NULL when it can."""
    exact = subject["relation"].isin("exact", "equivalent") & obj["relation"].isin("exact", "equivalent")
    return (
        F.when(subject.isNull() | (subject["status"] == "unresolved"), "subject_unresolved")
        .when(subject["status"] == "ambiguous", "subject_ambiguous")
        .when(obj.isNull() | (obj["status"] == "unresolved"), "object_unresolved")
        .when(obj["status"] == "ambiguous", "object_ambiguous")
        .when(~exact, "non_exact_or_equivalent_mapping")
    )


# --- canonical statements and families ----------------------------------------------------


def with_canonical_id(assertions: DataFrame, *, frequency: str | None = None) -> DataFrame:
    """Add ``canonical_id`` from (subject, relation, finding, polarity and optionally frequency)."""
    obj = F.struct(F.col("finding").alias("concept_id"), F.lit("concept").alias("kind"))
    fields = {
        "polarity": F.col("polarity"),
        "population": F.array().cast("array<string>"),
    }
    if frequency:
        names = ("category", "denominator", "kind", "lower", "numerator", "raw", "upper")
        fields["frequency"] = F.struct(*[F.col(f"{frequency}.{n}").alias(n) for n in names])
    qualifiers = F.struct(
        *[fields.get(n, F.lit(None).cast("string")).alias(n) for n in QUALIFIER_FIELDS]
    )
    return assertions.withColumn(
        "canonical_id",
        ids.canonical_assertion_id(F.col("subject"), F.col("relation"), obj, qualifiers),
    )


def canonical_assertions(bridged: DataFrame) -> DataFrame:
    """One row per semantic signature."""
    return bridged.select("canonical_id", "subject", "relation", "finding", "polarity").distinct()


def derivations(bridged: DataFrame) -> DataFrame:
    return (
        bridged.select("source_id", "canonical_id")
        .distinct()
        .withColumn("derivation_id", ids.stable_id("derivation", F.col("source_id"), F.col("canonical_id")))
    )


def family_members(assertions: DataFrame) -> DataFrame:
    """Bridge of family and source assertion, in place of one long array per family."""
    return assertions.select("family", "source_id", "release").distinct()


def assign_families(
    assertions: DataFrame, *, shared_upstream: dict[str, str] | None = None, editorial: str | None = None
) -> DataFrame:
    """Family of each source assertion.

    Default: one family per canonical statement and release. A row whose ``upstream`` is listed in
    ``shared_upstream`` joins that family; rows flagged ``editorial_unknown`` join ``editorial``.
    """
    own = ids.stable_id("evidence_family", F.col("canonical_id"), F.col("release"))
    family = own
    if shared_upstream:
        table = F.create_map(*[F.lit(x) for pair in shared_upstream.items() for x in pair])
        family = F.coalesce(F.try_element_at(table, F.col("upstream")), family)
    if editorial:
        family = F.when(F.col("editorial_unknown"), F.lit(editorial)).otherwise(family)
    return assertions.withColumn("family", family)


def declared_family_conflicts(declarations: DataFrame) -> DataFrame:
    """Families declared twice with different definitions."""
    definition = [c for c in declarations.columns if c not in ("family", "source_id")]
    return (
        declarations.groupBy("family")
        .agg(F.count_distinct(ids.row_sha(*definition)).alias("definitions"))
        .filter(F.col("definitions") > 1)
    )


def pending_family_dependency(members: DataFrame) -> DataFrame:
    """Dependency of a pending family: unknown wins, then primary, then the alphabetically first."""
    kind = F.col("dependency_type")
    return members.groupBy("family").agg(
        F.when(F.max((kind == "unknown").cast("int")) == 1, "unknown")
        .when(F.max((kind == "primary").cast("int")) == 1, "primary")
        .otherwise(F.min(kind))
        .alias("dependency_type")
    )


def dependency_rows(sources: DataFrame) -> DataFrame:
    """One row per declared upstream, or a self-primary row where none is declared.

    ``sources(release, dependencies array<struct<upstream_reference,dependency_type,evidence>>)``.
    """
    rows = sources.select("release", F.explode_outer("dependencies").alias("d"))
    upstream = F.coalesce(F.col("d.upstream_reference"), F.col("release"))
    return rows.select(
        ids.stable_id("source_dependency", F.col("release"), upstream).alias("source_dependency_id"),
        "release",
        upstream.alias("upstream_reference"),
        F.coalesce(F.col("d.dependency_type"), F.lit("primary")).alias("dependency_type"),
        F.coalesce(F.col("d.evidence"), F.lit("no upstream dependency declared")).alias("evidence"),
    )


def aggregatable_families(
    families: DataFrame,
    members: DataFrame,
    dependencies: DataFrame,
    allow_unknown_releases: list[str] | None = None,
) -> DataFrame:
    """Families that may count as independent evidence.

    The family's own dependency must be known and no release of a member may have an
    unknown dependency, unless that release is on the allow list.
    """
    unknown = dependencies.filter(F.col("dependency_type") == "unknown").select("release").distinct()
    if allow_unknown_releases:
        unknown = unknown.filter(~F.col("release").isin(allow_unknown_releases))
    tainted = members.select("family", "release").distinct().join(unknown, "release", "left_semi")
    return (
        families.filter(F.col("dependency_type") != "unknown")
        .select("family")
        .join(tainted, "family", "left_anti")
    )


# --- observation resolution ----------------------------------------------------------------


def resolve_observations(
    inputs: DataFrame,
    concepts: DataFrame,
    identifiers: DataFrame,
    mappings: DataFrame,
    *,
    strict: bool = False,
) -> DataFrame:
    """Resolve ``inputs(input_id, concept_id, system, code)`` in three tiers.

    Active concept id, then a (system, code) identifier of an active concept, then a unique
    exact or equivalent resolved mapping. Strict mode refuses codes shared by several concepts
    and mappings whose target is not active.
    """
    active = concepts.filter(F.col("status") == "active").select(F.col("concept_id").alias("active_id"))
    by_code = (
        identifiers.join(active, identifiers.concept_id == active.active_id)
        .groupBy("system", "code")
        .agg(
            F.min("active_id").alias("code_concept"),
            F.count_distinct("active_id").alias("code_concepts"),
        )
    )
    exact = mappings.filter(
        F.col("relation").isin("exact", "equivalent")
        & (F.col("resolution_status") == "resolved")
        & F.col("target_concept_id").isNotNull()
    )
    if strict:
        exact = exact.join(active, exact.target_concept_id == active.active_id, "left_semi")
    by_mapping = (
        exact.groupBy(F.col("target_system").alias("system"), F.col("target_code").alias("code"))
        .agg(
            F.count("*").alias("mapping_count"),
            F.min("target_concept_id").alias("mapped_concept"),
            F.min("mapping_id").alias("only_mapping"),
        )
        .filter(F.col("mapping_count") == 1)
        .drop("mapping_count")
    )
    joined = (
        inputs.join(active, inputs.concept_id == active.active_id, "left")
        .join(by_code, ["system", "code"], "left")
        .join(by_mapping, ["system", "code"], "left")
    )
    code_ok = F.col("code_concept").isNotNull()
    if strict:
        code_value = F.when(F.col("code_concepts") == 1, F.col("code_concept"))
    else:
        code_value = F.col("code_concept")
    direct = F.col("active_id").isNotNull()
    return joined.select(
        "input_id",
        F.when(direct, F.col("active_id"))
        .when(code_ok, code_value)
        .otherwise(F.col("mapped_concept"))
        .alias("resolved_id"),
        F.when(~direct & ~code_ok, F.col("only_mapping")).alias("mapping_id"),
    )


# --- labels, identifiers, catalogue --------------------------------------------------------


def label_by_language(terms: DataFrame) -> DataFrame:
    """Rule a: per concept and language the preferred scope first, then the smallest text."""
    return terms.groupBy("concept_id", "language").agg(
        F.min(F.struct(F.col("scope") != "preferred", F.col("text"))).alias("m")
    ).select("concept_id", "language", F.col("m.text").alias("label"))


def label_last_wins(terms: DataFrame) -> DataFrame:
    """Rule b: among preferred and fully specified names the largest (scope, language) wins."""
    chosen = terms.filter(F.col("scope").isin("preferred", "fully_specified_name"))
    return chosen.groupBy("concept_id").agg(
        F.max(F.struct("scope", "language", "text")).alias("m")
    ).select("concept_id", F.col("m.text").alias("label"))


def label_catalogue(terms: DataFrame) -> DataFrame:
    """Rule c: preferred scope first, English first, then the smallest text."""
    return terms.groupBy("concept_id").agg(
        F.min(
            F.struct(
                (F.col("scope") != "preferred").alias("a"),
                (F.col("language") != "en").alias("b"),
                F.col("text"),
                F.col("language"),
            )
        ).alias("m")
    ).select("concept_id", F.col("m.text").alias("label"), F.col("m.language").alias("language"))


def identifier_smallest(identifiers: DataFrame) -> DataFrame:
    """Smallest (system, code)."""
    return identifiers.groupBy("concept_id").agg(
        F.min(F.struct("system", "code")).alias("m")
    ).select("concept_id", "m.system", "m.code")


def identifier_catalogue(identifiers: DataFrame) -> DataFrame:
    """Identity and source codes first, then the smallest code."""
    return identifiers.groupBy("concept_id").agg(
        F.min(
            F.struct(
                (~F.col("relation").isin("identity", "source_code")).alias("a"), "code", "system"
            )
        ).alias("m")
    ).select("concept_id", "m.system", "m.code")


def observable_catalogue(
    canonical: DataFrame, concepts: DataFrame, designations: DataFrame, identifiers: DataFrame
) -> DataFrame:
    """Findings that can be observed: kind sign > exam > symptom, with label and identifier."""
    kinds = (
        canonical.filter(F.col("relation").isin("has_sign", "has_exam_finding", "has_symptom"))
        .groupBy(F.col("finding").alias("concept_id"))
        .agg(
            F.max((F.col("relation") == "has_sign").cast("int")).alias("sign"),
            F.max((F.col("relation") == "has_exam_finding").cast("int")).alias("exam"),
        )
    )
    active = concepts.filter(F.col("status") == "active").select("concept_id")
    return (
        kinds.join(active, "concept_id")
        .join(identifier_catalogue(identifiers), "concept_id")
        .join(label_catalogue(designations), "concept_id", "left")
        .select(
            "concept_id", "system", "code",
            F.coalesce("label", "concept_id").alias("label"),
            F.coalesce("language", F.lit("und")).alias("language"),
            F.when(F.col("sign") == 1, "sign").when(F.col("exam") == 1, "exam").otherwise("symptom").alias("kind"),
        )
    )


def unique_codes(identifiers: DataFrame, system: str | None = None) -> DataFrame:
    """Codes that point to exactly one concept."""
    rows = identifiers.filter(F.col("relation").isin("primary", "identity", "source_code"))
    if system is not None:
        rows = rows.filter(F.col("system") == system)
    return (
        rows.groupBy("system", "code")
        .agg(F.min("concept_id").alias("concept_id"), F.count_distinct("concept_id").alias("n"))
        .filter(F.col("n") == 1)
        .drop("n")
    )


def navigation_list(requests: DataFrame, resolved: DataFrame) -> DataFrame:
    """Ordered codes per list with each concept kept at its first position.

    ``requests(list_id, position, code)``, ``resolved(code, concept_id)``.
    """
    rows = requests.join(resolved, "code")
    first = best_per_key(rows, ["list_id", "concept_id"], F.col("position"), F.col("code"))
    order = W.partitionBy("list_id").orderBy("position")
    return first.withColumn("rank", F.row_number().over(order)).select(
        "list_id", "rank", "code", "concept_id"
    )


def ambiguous_aliases(terms: DataFrame) -> DataFrame:
    """(language, normalised text) shared by two codes."""
    return (
        terms.select("language", normalize.normalize_search(F.col("text")).alias("normalized"), "code")
        .groupBy("language", "normalized")
        .agg(F.count_distinct("code").alias("codes"))
        .filter(F.col("codes") > 1)
    )


def upsert_identifiers(identifiers: DataFrame, order_col: str) -> DataFrame:
    """Identifiers keyed by (concept, code, release): the last relation written stays."""
    keys = ["concept_id", "code", "release"]
    return identifiers.groupBy(*keys).agg(
        F.max_by("relation", order_col).alias("relation")
    ).withColumn(
        "external_identifier_id",
        ids.stable_id("identifier", F.col("concept_id"), F.col("code"), F.col("release")),
    )


def corpus_metrics(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count and grouped counts of the canonical tables, as ``(metric, value)``."""
    parts = [
        df.agg(F.count("*").alias("value")).select(F.lit(f"{name}.rows").alias("metric"), "value")
        for name, df in tables.items()
    ]
    for name, column in (
        ("assertion", "relation"), ("assertion", "release"), ("assertion", "polarity"),
        ("concept", "kind"), ("concept", "status"), ("mapping", "resolution_status"),
    ):
        if name in tables and column in tables[name].columns:
            parts.append(
                tables[name].groupBy(column).agg(F.count("*").alias("value")).select(
                    F.concat(F.lit(f"{name}.{column}."), F.col(column)).alias("metric"), "value"
                )
            )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out

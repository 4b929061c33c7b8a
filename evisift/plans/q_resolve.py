"""Queries for identities, normalisers, resolution, validation and case transforms."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evisift.functions import codes, frequency, ids
from evisift.operators import cases, family, resolve, validate
from evisift.plans import oracle
from evisift.plans import testbed as tb
from evisift.plans.registry import query
from evisift.sources import sinks, snapshot

oracle.VIEWS["fx_input"] = """
  SELECT 'I:'||l_orderkey||':'||l_linenumber||':'||l_partkey||':'||l_suppkey AS input_id,
    CASE WHEN l_returnflag = 'A' THEN 'F:'||l_partkey ELSE 'unknown' END AS concept_id,
    CASE WHEN l_returnflag = 'R' THEN 'urn:evisift:brand' ELSE 'urn:evisift:crosswalk' END AS system,
    CASE WHEN l_returnflag = 'R' THEN p_brand||'/'||p_name ELSE 'X:'||p_name||'/'||p_size END AS code
  FROM lineitem JOIN part ON l_partkey = p_partkey"""
oracle.VIEWS["fx_by_code"] = """
  SELECT system, code, min(concept_id) AS concept_id, count(DISTINCT concept_id) AS n FROM fx_identifier GROUP BY 1, 2"""
oracle.VIEWS["fx_by_mapping"] = """
  SELECT target_system AS system, target_code AS code, min(target_concept_id) AS concept_id, min(mapping_id) AS mapping_id
  FROM fx_mapping WHERE relation IN ('exact', 'equivalent') AND resolution_status = 'resolved'
    AND target_concept_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1"""


def inputs(spark, sf):
    part = tb.table(spark, sf, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    line = tb.table(spark, sf, "lineitem")
    flag = F.col("l_returnflag")
    return line.join(part, line.l_partkey == part.p_partkey).select(
        F.concat(F.lit("I:"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("input_id"),
        F.when(flag == "A", F.concat(F.lit("F:"), "l_partkey")).otherwise("unknown").alias("concept_id"),
        F.when(flag == "R", "urn:evisift:brand").otherwise("urn:evisift:crosswalk").alias("system"),
        F.when(flag == "R", F.concat_ws("/", "p_brand", "p_name"))
        .otherwise(F.concat(F.lit("X:"), "p_name", F.lit("/"), "p_size")).alias("code"),
    )


def resolved(spark, sf, strict):
    return resolve.resolve_observations(
        inputs(spark, sf), tb.concepts(spark, sf), tb.identifiers(spark, sf), tb.mappings(spark, sf), strict=strict
    )


@query(
    "h1_stable_id",
    """SELECT 'F:'||p_partkey AS concept_id,
      'concept:'||sha256('["F:'||p_partkey||'","'||p_name||'"]') AS stable_id FROM part""",
)
def h1(spark, sf):
    return tb.table(spark, sf, "part").select(
        F.concat(F.lit("F:"), "p_partkey").alias("concept_id"),
        ids.stable_id("concept", F.concat(F.lit("F:"), "p_partkey"), F.col("p_name")).alias("stable_id"),
    )


@query(
    "h2_source_assertion_id",
    """SELECT source_id, 'source_assertion:'||sha256('["lines","'||release||'","[\\"'||least(family, relation)||'\\",\\"'
      ||greatest(family, relation)||'\\"]","'||source_id||'","0"]') AS id FROM fx_line""",
)
def h2(spark, sf):
    return tb.assertions(spark, sf).select(
        "source_id",
        ids.source_assertion_id(
            F.lit("lines"), F.col("release"), F.array("relation", "family"), F.col("source_id"), F.lit(0)
        ).alias("id"),
    )


oracle.VIEWS["fx_canonical_id"] = """SELECT DISTINCT 'canonical_assertion:'||sha256('["'||replace('{"object":{"concept_id":"'||finding||'","kind":"concept"},"qualifiers":{'
      ||'"age":null,"clinical_context":null,"evidence_level":null,"evidence_type":null,"frequency":null,"laterality":null,'
      ||'"location":null,"polarity":"'||polarity||'","population":[],"severity":null,"sex":null,"temporal_context":null},'
      ||'"relation":"'||relation||'","schema_version":2,"subject_concept_id":"'||subject||'"}', '"', '\\"')||'"]') AS canonical_id,
      subject, relation, finding, polarity FROM fx_line"""


@query("h3_canonical_assertion_id", "SELECT canonical_id, subject, relation, finding, polarity FROM fx_canonical_id")
def h3(spark, sf):
    return tb.canonical(spark, sf)


@query(
    "h4_candidate_id",
    """SELECT candidate_id, 'candidate_assertion:'||sha256('["topics:1","'||source||'","'||candidate_id||'","0"]') AS id FROM fx_candidate""",
)
def h4(spark, sf):
    return tb.candidates(spark, sf).select(
        "candidate_id",
        ids.candidate_assertion_id(F.lit("topics:1"), F.col("source"), F.col("candidate_id"), F.lit(0)).alias("id"),
    )


@query(
    "h6_table_hashes",
    """WITH leaf AS (
        SELECT 'designation' AS name, sha256('{"concept_id":"'||concept_id||'","language":"'||language||'","scope":"'||scope||'","text":"'||text||'"}') AS h FROM fx_designation
        UNION ALL SELECT 'statement', sha256('{"finding":"'||finding||'","polarity":"'||polarity||'","relation":"'||relation||'","subject":"'||subject||'"}') FROM fx_canonical),
      six AS (SELECT name, left(h, 6) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h, count(*) AS n FROM leaf GROUP BY 1, 2),
      three AS (SELECT name, left(p, 3) AS p, sha256(string_agg(h, '' ORDER BY six.p, h)) AS h, sum(n) AS n FROM six GROUP BY 1, left(p, 3))
    SELECT name AS "table", CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(h, '' ORDER BY p, h)) AS logical_sha256 FROM three GROUP BY 1""",
)
def h6(spark, sf):
    """Logical hashes of two canonical tables."""
    statement = tb.statements(spark, sf)
    parts = [
        snapshot.table_hash(df).select(F.lit(name).alias("table"), "rows", "logical_sha256")
        for name, df in (("statement", statement), ("designation", tb.designations(spark, sf)))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "h5_contribution_ids",
    """SELECT subject, finding, relation, polarity, family, 'reasoning_contribution:'||sha256('["'||subject||'","'||canonical_id||'","'||family||'"]') AS contribution_id
    FROM fx_statement_family JOIN fx_universe USING (subject) JOIN fx_canonical_id USING (subject, relation, finding, polarity)
    WHERE family IN (SELECT family FROM fx_family WHERE dependency_type <> 'unknown')""",
)
def h5(spark, sf):
    """Id of every contribution a statement can make through a family."""
    from evisift.plans.q_family import scorable

    rows = scorable(spark, sf)
    return rows.select(
        "subject", "finding", "relation", "polarity", "family",
        family.contribution_id(F.col("subject"), F.col("canonical_id"), F.col("family")).alias("contribution_id"),
    )


@query(
    "h7_family_manifest",
    """SELECT family, dependency_type, coalesce(members, 0) AS members FROM fx_family LEFT JOIN (
      SELECT family, count(DISTINCT (source_id, release)) AS members FROM fx_line GROUP BY 1) USING (family)""",
)
def h7(spark, sf):
    """Every family with its members."""
    return snapshot.family_manifest(tb.families(spark, sf), resolve.family_members(tb.canonical_bridge(spark, sf)))


@query("h7_family_summary", "SELECT dependency_type, count(*) AS families FROM fx_family GROUP BY 1")
def h7_summary(spark, sf):
    return snapshot.family_summary(tb.families(spark, sf))


@query(
    "h9_rebuild_differences",
    """SELECT subject, relation, finding, polarity, 'pinned' AS side FROM fx_canonical
    WHERE (subject, relation, finding, polarity) NOT IN
      (SELECT (subject, relation, finding, polarity) FROM fx_line WHERE release <> 'rel:P')""",
)
def h9(spark, sf):
    """A rebuild without one release against the full statement table."""
    rows = tb.lines(spark, sf).filter(F.col("release") != "rel:P")
    pinned = tb.statements(spark, sf)
    return snapshot.rebuild_differences(rows.select(*pinned.columns).distinct(), pinned)


@query(
    "n1_compact_codes",
    """SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'HP:'||p_partkey WHEN 1 THEN 'ORPHA:'||p_partkey ELSE 'MESH:D'||p_partkey END AS code
    FROM part""",
)
def n1(spark, sf):
    """Three spellings of every part key."""
    key = F.col("p_partkey")
    iri = (
        F.when(key % 3 == 0, F.concat(F.lit("http://purl.obolibrary.org/obo/HP_"), key))
        .when(key % 3 == 1, F.concat(F.lit("http://www.orpha.net/ORDO/Orphanet_"), key))
        .otherwise(F.concat(F.lit("MeSH:D"), key))
    )
    return tb.table(spark, sf, "part").select("p_partkey", codes.compact(iri, extended=True).alias("code"))


@query(
    "n2_code_systems",
    """SELECT 'HP:'||p_partkey AS code, 'http://purl.obolibrary.org/obo/hp.owl' AS system FROM part
    UNION ALL SELECT p_type||':'||p_partkey, 'urn:evisift:code-system:'||p_type FROM part""",
)
def n2(spark, sf):
    part = tb.table(spark, sf, "part")
    rows = part.select(
        F.explode(
            F.array(F.concat(F.lit("HP:"), "p_partkey"), F.concat_ws(":", "p_type", F.col("p_partkey").cast("string")))
        ).alias("code")
    )
    return rows.select("code", codes.system(F.col("code")).alias("system"))


@query(
    "n6_frequency_parser",
    """SELECT source_id, kind, round(estimate, 9) AS estimate FROM fx_assertion""",
)
def n6(spark, sf):
    return tb.assertions(spark, sf).select(
        "source_id", F.col("frequency.kind").alias("kind"), F.round("estimate", 9).alias("estimate")
    )


@query(
    "n7_frequency_validity",
    """SELECT kind, count(*) AS rows, count(*) FILTER (kind <> 'interval' OR
        TRY_CAST(replace(split_part(frequency_raw, '-', 2), ' %', '') AS DOUBLE) <= 100) AS valid FROM fx_assertion GROUP BY 1""",
)
def n7(spark, sf):
    rows = tb.assertions(spark, sf)
    return rows.groupBy(F.col("frequency.kind").alias("kind")).agg(
        F.count("*").alias("rows"), F.count_if(frequency.is_valid(F.col("frequency"))).alias("valid")
    )


@query(
    "n8_association_frequency",
    """SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, CASE WHEN l_returnflag = 'A' THEN 'excluded'
        WHEN l_linenumber <= CAST(l_quantity AS INTEGER) THEN 'count' ELSE 'percentage' END AS kind,
      round(CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_linenumber <= CAST(l_quantity AS INTEGER)
        THEN (l_linenumber + 1.0) / (CAST(l_quantity AS INTEGER) + 2) ELSE l_discount END, 9) AS estimate FROM lineitem""",
)
def n8(spark, sf):
    line = tb.table(spark, sf, "lineitem")
    freq = frequency.association_frequency(
        F.col("l_returnflag") == "A", F.col("l_linenumber"), F.col("l_quantity").cast("int"),
        F.round(F.col("l_discount") * 100),
    )
    return line.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", freq["kind"].alias("kind"),
        F.round(frequency.estimate(freq), 9).alias("estimate"),
    )


@query(
    "n9_kind_from_name",
    """SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'condition' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'finding' END AS kind FROM customer""",
)
def n9(spark, sf):
    segment = F.col("c_mktsegment")
    suffix = F.when(segment == "MACHINERY", " (disorder)").when(segment == "HOUSEHOLD", " (Observable Entity)").otherwise(" (x)")
    return tb.table(spark, sf, "customer").select(
        "c_custkey", codes.kind_from_name(F.concat("c_name", suffix)).alias("kind")
    )


@query(
    "n10_numeric_frequency",
    """SELECT p_partkey, CASE p_size % 7 WHEN 0 THEN 'HP:0040280' WHEN 1 THEN 'HP:0040281' WHEN 2 THEN 'HP:0040282'
      WHEN 3 THEN 'HP:0040283' WHEN 4 THEN 'HP:0040284' WHEN 5 THEN 'HP:0040285' END AS category FROM part""",
)
def n10(spark, sf):
    number = (F.lit(28405) + (F.col("p_size") % 7) * 7).cast("string")
    return tb.table(spark, sf, "part").select("p_partkey", frequency.numeric_category(number).alias("category"))


@query(
    "n11_iso_duration",
    """SELECT p_partkey, 'P'||CASE p_type WHEN 'SMALL' THEN 'T'||p_size||'H' WHEN 'ECONOMY' THEN p_size||'D' ELSE p_size||'W' END AS duration FROM part""",
)
def n11(spark, sf):
    unit = F.when(F.col("p_type") == "SMALL", "hour").when(F.col("p_type") == "ECONOMY", "day").otherwise("week")
    return tb.table(spark, sf, "part").select("p_partkey", codes.iso_duration(F.col("p_size"), unit).alias("duration"))


# --- resolution ----------------------------------------------------------------------------


@query(
    "d1_keyed_insert_conflicts",
    """SELECT p_name, count(DISTINCT p_type||'|'||p_brand) AS variants FROM part GROUP BY 1 HAVING count(DISTINCT p_type||'|'||p_brand) > 1""",
)
def d1(spark, sf):
    """Part names inserted as keys with differing rows."""
    rows = tb.table(spark, sf, "part").select("p_name", "p_type", "p_brand")
    return resolve.keyed_insert(rows, "p_name")[1]


@query(
    "d2_obsolete_resolution",
    """WITH RECURSIVE chain AS (SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt, event_type FROM events),
      step AS (SELECT 'F:'||p_partkey AS k, p_size > 25 AS obsolete,
        CASE WHEN p_size > 25 AND p_size <= 45 THEN 'F:'||(p_partkey + 1) END AS nxt FROM part
        UNION ALL SELECT 'E:'||event_id, nxt IS NOT NULL OR event_type = 'error', 'E:'||nxt FROM chain),
      walk AS (SELECT k, k AS cur, obsolete, nxt, 0 AS hops FROM step
        UNION ALL SELECT w.k, s.k, s.obsolete, s.nxt, hops + 1 FROM walk w JOIN step s ON s.k = w.nxt WHERE w.obsolete AND w.nxt IS NOT NULL)
    SELECT k AS concept_id, CASE WHEN NOT obsolete THEN cur END AS resolved,
      CASE WHEN NOT obsolete AND hops = 0 THEN 'active' WHEN NOT obsolete THEN 'replaced'
        WHEN hops = 0 AND nxt IS NULL THEN 'retired' ELSE 'unknown' END AS outcome
    FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY hops DESC) AS n FROM walk) WHERE n = 1""",
)
def d2(spark, sf):
    """Large parts are replaced by the next key, the largest by none; a user's events by the next, a chain of many links."""
    part = tb.table(spark, sf, "part")
    name = F.concat(F.lit("F:"), "p_partkey")
    following = F.when(F.col("p_size") <= 45, F.concat(F.lit("F:"), F.col("p_partkey") + 1))
    parts = part.select(name.alias("concept_id"), (F.col("p_size") > 25).alias("obsolete"), F.when(F.col("p_size") > 25, following).alias("replacement"))
    later = F.lead("event_id").over(W.partitionBy("user_id").orderBy("event_id"))
    events = tb.table(spark, sf, "events").withColumn("later", later).select(
        F.concat(F.lit("E:"), "event_id").alias("concept_id"), (F.col("later").isNotNull() | (F.col("event_type") == "error")).alias("obsolete"),
        F.concat(F.lit("E:"), "later").alias("replacement"),
    )
    rows = parts.unionByName(events)
    return resolve.resolve_obsolete(rows.select("concept_id", "obsolete"), rows.filter("replacement IS NOT NULL").select("concept_id", "replacement"))


@query(
    "d3_bilingual_merge",
    """SELECT o_orderkey AS record_id, min(o_orderstatus) AS payload, string_agg(DISTINCT l, ',' ORDER BY l) AS languages
    FROM orders, (VALUES ('en'), ('fr')) v(l) WHERE l = 'en' OR o_orderstatus <> 'P' GROUP BY 1""",
)
def d3(spark, sf):
    """Every order as an English record, most also as a French one."""
    rows = tb.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("payload"),
        F.explode(F.when(F.col("o_orderstatus") == "P", F.array(F.lit("en"))).otherwise(F.array(F.lit("en"), F.lit("fr")))).alias("language"),
    ).withColumn("provenance", F.concat_ws(":", "record_id", "language"))
    merged, _ = resolve.merge_bilingual(rows)
    return merged.select("record_id", "payload", F.array_join("languages", ",").alias("languages"))


@query(
    "d4_mapping_relations",
    """SELECT 'M:'||p_partkey AS mapping_id, CASE WHEN p_size > 40 THEN 'unresolved' WHEN p_type = 'ECONOMY' THEN 'exact' ELSE 'related' END AS relation,
      CASE WHEN p_size > 40 OR p_type <> 'ECONOMY' THEN 'source_to_target' ELSE 'bidirectional' END AS direction FROM part""",
)
def d4(spark, sf):
    part = tb.table(spark, sf, "part")
    rows = part.select(
        F.concat(F.lit("M:"), "p_partkey").alias("mapping_id"), F.concat(F.lit("F:"), "p_partkey").alias("target_external_id"),
        F.when(F.col("p_type") == "ECONOMY", "exactMatch").otherwise("xref").alias("relation"),
    )
    known = part.filter("p_size <= 40").select(
        F.concat(F.lit("F:"), "p_partkey").alias("external_id"), F.concat(F.lit("F:"), "p_partkey").alias("concept_id")
    )
    return resolve.normalise_mapping(rows, known).select("mapping_id", "relation", "direction")


@query(
    "d13_derivations",
    """SELECT source_id, subject, relation, finding, polarity FROM fx_line""",
)
def d13(spark, sf):
    """Source statements linked to their canonical statement."""
    bridge = tb.canonical_bridge(spark, sf)
    links = resolve.derivations(bridge).select("source_id", "canonical_id")
    return links.join(tb.canonical(spark, sf), "canonical_id").drop("canonical_id")


@query(
    "d14_family_assignment",
    """SELECT family, CASE WHEN bool_or(release = 'rel:P' AND family = '4-NOT SPECIFIED') THEN 'unknown' ELSE 'primary' END AS dependency_type
    FROM fx_line GROUP BY 1""",
)
def d14(spark, sf):
    """Dependency of families whose members disagree: unknown wins."""
    rows = tb.canonical_bridge(spark, sf).select(
        "family",
        F.when((F.col("release") == "rel:P") & (F.col("family") == "4-NOT SPECIFIED"), "unknown").otherwise("primary").alias("dependency_type"),
    )
    return resolve.pending_family_dependency(rows)


@query(
    "d15_dependencies",
    """SELECT 'n:'||n_nationkey AS release, CASE WHEN n_regionkey = 0 THEN 'n:'||n_nationkey ELSE 'r:'||n_regionkey END AS upstream_reference,
      CASE WHEN n_regionkey = 0 THEN 'primary' ELSE 'derived_from' END AS dependency_type FROM nation""",
)
def d15(spark, sf):
    """Nations as releases that derive from their region; one region declares nothing."""
    entry = F.struct(
        F.concat(F.lit("r:"), "n_regionkey").alias("upstream_reference"),
        F.lit("derived_from").alias("dependency_type"), F.lit("declared").alias("evidence"),
    )
    rows = tb.table(spark, sf, "nation").select(
        F.concat(F.lit("n:"), "n_nationkey").alias("release"),
        F.when(F.col("n_regionkey") != 0, F.array(entry)).alias("dependencies"),
    )
    return resolve.dependency_rows(rows).select("release", "upstream_reference", "dependency_type")


@query(
    "d17_observation_resolution",
    """SELECT input_id, CASE WHEN a.concept_id IS NOT NULL THEN a.concept_id WHEN c.concept_id IS NOT NULL THEN c.concept_id
        ELSE m.concept_id END AS resolved_id,
      CASE WHEN a.concept_id IS NULL AND c.concept_id IS NULL THEN m.mapping_id END AS mapping_id
    FROM fx_input i LEFT JOIN fx_concept a ON a.concept_id = i.concept_id AND a.status = 'active'
      LEFT JOIN fx_by_code c ON c.system = i.system AND c.code = i.code
      LEFT JOIN fx_by_mapping m ON m.system = i.system AND m.code = i.code""",
)
def d17(spark, sf):
    return resolved(spark, sf, False)


@query(
    "d18_strict_resolution",
    """SELECT input_id, CASE WHEN a.concept_id IS NOT NULL THEN a.concept_id
        WHEN c.concept_id IS NOT NULL THEN CASE WHEN c.n = 1 THEN c.concept_id END ELSE m.concept_id END AS resolved_id,
      CASE WHEN a.concept_id IS NULL AND c.concept_id IS NULL THEN m.mapping_id END AS mapping_id
    FROM fx_input i LEFT JOIN fx_concept a ON a.concept_id = i.concept_id AND a.status = 'active'
      LEFT JOIN fx_by_code c ON c.system = i.system AND c.code = i.code
      LEFT JOIN fx_by_mapping m ON m.system = i.system AND m.code = i.code""",
)
def d18(spark, sf):
    return resolved(spark, sf, True)


@query(
    "d19_preferred_label",
    """SELECT concept_id, language, text AS label FROM (SELECT *, row_number() OVER (PARTITION BY concept_id, language
      ORDER BY scope <> 'preferred', text) AS n FROM fx_designation) WHERE n = 1""",
)
def d19(spark, sf):
    return resolve.label_by_language(tb.designations(spark, sf))


@query(
    "d19_last_label",
    """SELECT concept_id, text AS label FROM (SELECT *, row_number() OVER (PARTITION BY concept_id
      ORDER BY scope DESC, language DESC) AS n FROM fx_designation WHERE scope IN ('preferred', 'fully_specified_name')) WHERE n = 1""",
)
def d19b(spark, sf):
    return resolve.label_last_wins(tb.designations(spark, sf))


@query(
    "d20_smallest_identifier",
    """SELECT concept_id, system, code FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY system, code) AS n FROM fx_identifier) WHERE n = 1""",
)
def d20(spark, sf):
    return resolve.identifier_smallest(tb.identifiers(spark, sf))


@query(
    "d21_observable_catalogue",
    """WITH k AS (SELECT finding AS concept_id, max(CASE WHEN relation = 'has_sign' THEN 1 ELSE 0 END) AS s FROM fx_canonical GROUP BY 1),
      l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY scope <> 'preferred', language <> 'en', text) AS n
        FROM fx_designation) WHERE n = 1),
      i AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY concept_id
        ORDER BY relation NOT IN ('identity', 'source_code'), code) AS n FROM fx_identifier) WHERE n = 1)
    SELECT concept_id, system, code, text AS label, language, CASE WHEN s = 1 THEN 'sign' ELSE 'symptom' END AS kind
    FROM k JOIN i USING (concept_id) JOIN l USING (concept_id)""",
)
def d21(spark, sf):
    return resolve.observable_catalogue(
        tb.lines(spark, sf), tb.concepts(spark, sf), tb.designations(spark, sf), tb.identifiers(spark, sf)
    )


@query(
    "d23_navigation_list",
    """WITH r AS (SELECT p_brand AS list_id, p_partkey AS position, p_brand||'/'||p_name AS code FROM part),
      u AS (SELECT code, min(concept_id) AS concept_id FROM fx_identifier WHERE system = 'urn:evisift:brand'
        GROUP BY 1 HAVING count(DISTINCT concept_id) = 1),
      f AS (SELECT list_id, concept_id, min(position) AS position, min(code) AS code FROM r JOIN u USING (code) GROUP BY 1, 2)
    SELECT list_id, row_number() OVER (PARTITION BY list_id ORDER BY position) AS rank, code, concept_id FROM f""",
)
def d23(spark, sf):
    """Unique brand codes of each brand in part order."""
    requests = tb.table(spark, sf, "part").select(
        F.col("p_brand").alias("list_id"), F.col("p_partkey").alias("position"),
        F.concat_ws("/", "p_brand", "p_name").alias("code"),
    )
    codes_df = resolve.unique_codes(tb.identifiers(spark, sf), "urn:evisift:brand").select("code", "concept_id")
    return resolve.navigation_list(requests, codes_df)


@query(
    "d25_corpus_metrics",
    """SELECT 'assertion.rows' AS metric, count(*) AS value FROM fx_line
    UNION ALL SELECT 'concept.rows', count(*) FROM fx_concept UNION ALL SELECT 'mapping.rows', count(*) FROM fx_mapping
    UNION ALL SELECT 'assertion.relation.'||relation, count(*) FROM fx_line GROUP BY relation
    UNION ALL SELECT 'assertion.release.'||release, count(*) FROM fx_line GROUP BY release
    UNION ALL SELECT 'assertion.polarity.'||polarity, count(*) FROM fx_line GROUP BY polarity
    UNION ALL SELECT 'concept.kind.'||kind, count(*) FROM fx_concept GROUP BY kind
    UNION ALL SELECT 'concept.status.'||status, count(*) FROM fx_concept GROUP BY status
    UNION ALL SELECT 'mapping.resolution_status.'||resolution_status, count(*) FROM fx_mapping GROUP BY resolution_status""",
)
def d25(spark, sf):
    return resolve.corpus_metrics(
        {"assertion": tb.assertions(spark, sf), "concept": tb.concepts(spark, sf), "mapping": tb.mappings(spark, sf)}
    )


@query(
    "d26_ambiguous_aliases",
    r"""SELECT language, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) AS normalized,
      count(DISTINCT concept_id) AS codes FROM fx_designation GROUP BY 1, 2 HAVING count(DISTINCT concept_id) > 1""",
)
def d26(spark, sf):
    return resolve.ambiguous_aliases(tb.designations(spark, sf).withColumn("code", F.col("concept_id")))


# --- validation ----------------------------------------------------------------------------


@query(
    "v1_foreign_keys",
    """SELECT DISTINCT 'assertion.subject' AS reference, subject AS value FROM fx_line
      WHERE subject NOT IN (SELECT concept_id FROM fx_concept WHERE status = 'active')
    UNION SELECT 'mapping.target', target_code FROM fx_mapping WHERE target_code NOT IN (SELECT code FROM fx_identifier)""",
)
def v1(spark, sf):
    """References to active concepts and known codes."""
    active = tb.concepts(spark, sf).filter("status = 'active'")
    return validate.foreign_keys(
        [
            ("assertion.subject", tb.assertions(spark, sf), "subject", active, "concept_id"),
            ("mapping.target", tb.mappings(spark, sf), "target_code", tb.identifiers(spark, sf), "code"),
        ]
    )


@query(
    "v2_duplicate_keys",
    """SELECT 'mapping' AS "table", target_code AS value, count(*) AS n FROM fx_mapping GROUP BY 2 HAVING count(*) > 1
    UNION ALL SELECT 'identifier', code, count(*) FROM fx_identifier GROUP BY 2 HAVING count(*) > 1""",
)
def v2(spark, sf):
    return validate.duplicate_keys(
        {"mapping": (tb.mappings(spark, sf), "target_code"), "identifier": (tb.identifiers(spark, sf), "code")}
    )


@query(
    "v5_registry_alignment",
    """SELECT o_orderstatus AS release, CAST(o_orderkey AS VARCHAR) AS filename,
      CASE WHEN o_orderpriority = '1-URGENT' THEN 'not_stored' WHEN o_orderpriority = '2-HIGH' THEN 'hash' ELSE 'not_declared' END AS problem
    FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')""",
)
def v5(spark, sf):
    """Orders as artifacts: one priority not stored, one changed, one not declared."""
    rows = tb.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("release"), F.col("o_orderkey").cast("string").alias("filename"),
        F.col("o_orderpriority").alias("p"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"),
    )
    declared = rows.filter("p <> '5-LOW'").drop("p")
    stored = rows.filter("p <> '1-URGENT'").withColumn(
        "sha256", F.when(F.col("p") == "2-HIGH", "changed").otherwise(F.col("sha256"))
    ).drop("p")
    return validate.registry_alignment(declared, stored)


def simple_cases(spark, sf):
    """Line items as raw case observations, repeated findings included; returned lines as answers."""
    line = tb.table(spark, sf, "lineitem").select(
        F.concat(F.lit("O:"), "l_orderkey").alias("case_id"), F.concat(F.lit("F:"), "l_partkey").alias("concept_id"),
        F.when(F.col("l_returnflag") == "N", "present").when(F.col("l_returnflag") == "A", "absent").otherwise("unknown").alias("status"),
        "l_linestatus",
    )
    return line.filter("l_linestatus = 'O'").drop("l_linestatus"), line.filter("l_linestatus = 'F'").select(
        "case_id", "concept_id", F.col("status").alias("answer")
    )


oracle.VIEWS["fx_raw"] = """
  SELECT 'O:'||l_orderkey AS case_id, 'F:'||l_partkey AS concept_id, l_linestatus AS ls,
    CASE l_returnflag WHEN 'N' THEN 'present' WHEN 'A' THEN 'absent' ELSE 'unknown' END AS status FROM lineitem"""
# one status per case and concept, as a valid case has
oracle.VIEWS["fx_valid_obs"] = "SELECT case_id, concept_id, min(status) AS status FROM fx_raw WHERE ls = 'O' GROUP BY 1, 2"
oracle.VIEWS["fx_valid_answer"] = "SELECT case_id, concept_id, min(status) AS answer FROM fx_raw WHERE ls = 'F' GROUP BY 1, 2"


def valid_cases(spark, sf):
    obs, answers = simple_cases(spark, sf)
    return (
        obs.groupBy("case_id", "concept_id").agg(F.min("status").alias("status")),
        answers.groupBy("case_id", "concept_id").agg(F.min("answer").alias("answer")),
    )


@query(
    "v6_simple_case_problems",
    """SELECT case_id, concept_id, 'repeated_observation' AS problem FROM fx_raw WHERE ls = 'O' GROUP BY 1, 2 HAVING count(*) > 1
    UNION ALL SELECT case_id, concept_id, 'repeated_question' FROM fx_raw WHERE ls = 'F' GROUP BY 1, 2 HAVING count(*) > 1
    UNION ALL SELECT DISTINCT a.case_id, a.concept_id, 'answer_conflicts_with_observation' FROM fx_raw a JOIN fx_raw b
      USING (case_id, concept_id) WHERE a.ls = 'O' AND b.ls = 'F' AND a.status <> b.status
    UNION ALL SELECT case_id, NULL, 'too_many_answers' FROM fx_raw WHERE ls = 'F' GROUP BY 1 HAVING count(*) > 12""",
)
def v6(spark, sf):
    return validate.case_v1(*simple_cases(spark, sf))


@query(
    "v8_status_legality",
    """SELECT l_returnflag||l_linestatus AS combination, count(*) AS rows,
      CASE WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'known_needs_plain_assessment'
        WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'unknown_needs_matching_reason' END AS problem
    FROM lineitem GROUP BY ALL""",
)
def v8(spark, sf):
    """Line flags read as status, evaluation and reason."""
    line = tb.table(spark, sf, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "unknown").otherwise("present")
    reason = (
        F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O"), "uncertain")
        .when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O"), "unknown_to_subject")
        .when(F.col("l_returnflag") == "R", "not_asked")
    )
    problem = validate.status_problem(status, F.lit("assessed"), reason)
    return line.groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("combination"), problem.alias("problem")
    ).agg(F.count("*").alias("rows"))


@query(
    "v11_candidate_contract",
    """SELECT candidate_id, CASE WHEN status = 'approved' AND toxic = 0 THEN 'approved_without_reviewer'
      WHEN n_chars > 1000 THEN 'quantity_and_unit_together' END AS problem FROM fx_candidate""",
)
def v11(spark, sf):
    reviewers = F.when(F.col("toxic") == 1, F.array(F.lit("R"))).otherwise(F.array().cast("array<string>"))
    mapping = F.struct(F.lit("resolved").alias("status"), F.col("source").alias("concept_id"))
    value = F.when(F.col("n_chars") > 1000, F.col("n_chars"))
    return tb.candidates(spark, sf).select(
        "candidate_id",
        validate.candidate_problem(F.col("status"), reviewers, value, F.lit(None).cast("string"), mapping, mapping).alias("problem"),
    )


# --- case transforms -----------------------------------------------------------------------


@query(
    "m1_effective_observations",
    """SELECT case_id, concept_id, coalesce(answer, status) AS status FROM fx_valid_obs FULL JOIN fx_valid_answer USING (case_id, concept_id)""",
)
def m1(spark, sf):
    return cases.effective_v1(*valid_cases(spark, sf))


def superseding(spark, sf):
    """Lines of a case as observations; a line replaces the one numbered before it for the same part."""
    line = tb.table(spark, sf, "lineitem")
    rows = line.select(
        F.concat(F.lit("O:"), "l_orderkey").alias("case_id"),
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("observation_id"),
        F.concat(F.lit("HP:"), F.lpad(F.col("l_partkey").cast("string"), 7, "0")).alias("code"),
        F.when(F.col("l_linestatus") == "O", "phenotype").otherwise("symptom").alias("kind"),
        F.when(F.col("l_returnflag") == "N", "present").otherwise("absent").alias("status"),
        F.lit(cases.FINDING_SYSTEM).alias("system"), "l_linenumber",
    )
    before = W.partitionBy("case_id", "code").orderBy("l_linenumber", "observation_id")
    return rows.withColumn("supersedes", F.lag("observation_id").over(before)).drop("l_linenumber")


oracle.VIEWS["fx_sup"] = """
  SELECT *, lag(observation_id) OVER (PARTITION BY case_id, code ORDER BY ln, observation_id) AS supersedes FROM (
    SELECT 'O:'||l_orderkey AS case_id, concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS observation_id,
      'HP:'||lpad(CAST(l_partkey AS VARCHAR), 7, '0') AS code, CASE WHEN l_linestatus = 'O' THEN 'phenotype' ELSE 'symptom' END AS kind,
      CASE WHEN l_returnflag = 'N' THEN 'present' ELSE 'absent' END AS status, l_linenumber AS ln FROM lineitem)"""
oracle.VIEWS["fx_active"] = """
  SELECT * FROM fx_sup s WHERE NOT EXISTS (SELECT 1 FROM fx_sup x WHERE x.case_id = s.case_id AND x.supersedes = s.observation_id)"""


@query("m2_active_observations", "SELECT case_id, observation_id, code, status FROM fx_active")
def m2(spark, sf):
    return family.active_observations(superseding(spark, sf)).select("case_id", "observation_id", "code", "status")


def projected(spark, sf):
    active = family.active_observations(superseding(spark, sf))
    answers = active.filter((F.col("kind") == "phenotype") & (F.col("status") == "absent")).select(
        "case_id", F.lit(0).alias("position"), "system", "code", F.lit("unknown").alias("status")
    )
    return active, cases.project_for_semantic(active, answers)


@query("m3_semantic_projection", "SELECT case_id, code, status FROM fx_active WHERE kind = 'phenotype' AND status <> 'absent'")
def m3(spark, sf):
    """Observations that no answer replaces; every absent one is answered."""
    return projected(spark, sf)[1]["observations"]


@query("m3_answers", "SELECT case_id, code, 'unknown' AS answer FROM fx_active WHERE kind = 'phenotype' AND status = 'absent'")
def m3_answers(spark, sf):
    return projected(spark, sf)[1]["answers"]


@query(
    "m6_semantic_coverage",
    """SELECT case_id, count(*) AS confirmed, count(*) FILTER (kind = 'phenotype') AS supported,
      count(*) FILTER (kind = 'phenotype' AND status = 'present') AS present,
      round(count(*) FILTER (kind = 'phenotype') / count(*), 9) AS ratio,
      CASE WHEN count(*) FILTER (kind = 'phenotype' AND status = 'present') = 0 THEN 'out_of_scope'
        WHEN count(*) FILTER (kind = 'phenotype') < count(*) THEN 'partial' ELSE 'in_scope' END AS scope
    FROM fx_active GROUP BY 1""",
)
def m6(spark, sf):
    active, parts = projected(spark, sf)
    return cases.semantic_coverage(active, parts["ignored"]).withColumn("ratio", F.round("ratio", 9))


@query(
    "m4_case_coverage",
    """WITH r AS (SELECT input_id, CASE WHEN a.concept_id IS NOT NULL THEN a.concept_id WHEN c.concept_id IS NOT NULL THEN c.concept_id
          ELSE m.concept_id END AS resolved_id
        FROM fx_input i LEFT JOIN fx_concept a ON a.concept_id = i.concept_id AND a.status = 'active'
        LEFT JOIN fx_by_code c ON c.system = i.system AND c.code = i.code
        LEFT JOIN fx_by_mapping m ON m.system = i.system AND m.code = i.code),
      o AS (SELECT 'O:'||l_orderkey AS case_id, 'I:'||l_orderkey||':'||l_linenumber||':'||l_partkey||':'||l_suppkey AS input_id,
        l_linestatus = 'O' AS used, l_returnflag = 'N' AS present FROM lineitem)
    SELECT case_id, count(*) AS confirmed, count(*) FILTER (used AND resolved_id IS NOT NULL) AS supported,
      count(*) FILTER (used AND resolved_id IS NOT NULL AND present) AS supported_present,
      round(count(*) FILTER (used AND resolved_id IS NOT NULL) / count(*), 9) AS ratio
    FROM o JOIN r USING (input_id) GROUP BY 1""",
)
def m4(spark, sf):
    """Coverage of every order once its inputs are resolved; filled lines have no usable kind."""
    active = tb.table(spark, sf, "lineitem").select(
        F.concat(F.lit("O:"), "l_orderkey").alias("case_id"),
        F.concat(F.lit("I:"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("observation_id"),
        F.when(F.col("l_linestatus") == "O", "symptom").otherwise("history").alias("kind"),
        F.when(F.col("l_returnflag") == "N", "present").otherwise("absent").alias("status"),
        F.lit("assessed").alias("evaluated"),
    )
    _, coverage = family.project_cases(active, resolved(spark, sf, False))
    return coverage.withColumn("ratio", F.round("ratio", 9))


@query(
    "c1_case_migration",
    """WITH e AS (SELECT case_id, concept_id, coalesce(answer, status) AS status, answer IS NOT NULL AS asked
      FROM fx_valid_obs FULL JOIN fx_valid_answer USING (case_id, concept_id))
    SELECT case_id, 'clinical_observation:'||sha256('["'||case_id||'","'||concept_id||'"]') AS observation_id,
      concept_id AS code, status, CASE WHEN status = 'unknown' THEN 'unknown_to_subject' END AS reason,
      CASE WHEN asked THEN 'question_response:'||sha256('["'||case_id||'","'||concept_id||'"]') END AS question_response_id FROM e""",
)
def c1(spark, sf):
    return cases.migrate_v1(*valid_cases(spark, sf))["observations"].select(
        "case_id", "observation_id", "code", "status", "reason", "question_response_id"
    )


@query(
    "c2_answers_applied",
    """SELECT a.case_id, a.concept_id, CASE WHEN a.answer = 'unknown' THEN 'unknown_to_subject' END AS reason,
      a.answer AS status, CASE WHEN o.case_id IS NOT NULL THEN 'obs|'||a.case_id||'|'||a.concept_id END AS supersedes
    FROM fx_valid_answer a LEFT JOIN fx_valid_obs o USING (case_id, concept_id)""",
)
def c2(spark, sf):
    obs, answers = valid_cases(spark, sf)
    active = obs.select("case_id", F.concat_ws("|", F.lit("obs"), "case_id", "concept_id").alias("observation_id"), "concept_id")
    asked = answers.select(
        "case_id", F.concat_ws("|", F.lit("q"), "concept_id").alias("question_id"), "concept_id",
        F.lit("symptom").alias("kind"), "answer",
    )
    return cases.apply_answers(active, asked)["observations"].select("case_id", "concept_id", "reason", "status", "supersedes")


@query(
    "c3_refinements",
    """SELECT case_id, observation_id, 'P'||'T'||'3H' AS duration FROM fx_active WHERE kind = 'symptom' AND status = 'present'""",
)
def c3(spark, sf):
    """A three-hour duration for every present symptom."""
    active = family.active_observations(superseding(spark, sf)).withColumn("acquisition_method", F.lit("reported"))
    catalogue = active.select("code").distinct().withColumn("fields", F.array(F.lit("duration")))
    options = cases.refinement_options(active, catalogue)
    asked = active.filter("kind = 'symptom'").select(
        "case_id", "observation_id", F.lit(3).alias("duration_value"), F.lit("hour").alias("duration_unit"),
        F.lit(None).cast("string").alias("laterality"), F.lit(None).cast("string").alias("severity"),
    )
    return cases.apply_refinements(options, asked)[0].drop("laterality")


@query("c4_demographics", "SELECT 'O:'||o_orderkey AS case_id, round(o_totalprice / 1000) AS age FROM orders")
def c4(spark, sf):
    rows = tb.table(spark, sf, "orders").select(
        F.concat(F.lit("O:"), "o_orderkey").alias("case_id"), F.round(F.col("o_totalprice") / 1000).alias("age"),
        F.col("o_orderstatus").alias("sex"),
    )
    return cases.demographics(rows)


@query(
    "c5_confirmed_mentions",
    """WITH t AS (SELECT 'V:'||conv_id AS case_id, turn, string_split(text, ' ') AS words FROM conversations),
      w AS (SELECT case_id, turn, i, words[i] AS word FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM t) WHERE words[i] <> ''),
      o AS (SELECT *, row_number() OVER (PARTITION BY case_id, lower(word) ORDER BY turn, i) AS n FROM w WHERE lower(word) <> 'the')
    SELECT case_id, 'W:'||lower(word) AS concept_id, word AS code FROM o WHERE n = 1""",
)
def c5(spark, sf):
    """Every word of every turn confirmed as a mention; one concept is already observed everywhere."""
    turns = tb.table(spark, sf, "conversations").select(
        F.concat(F.lit("V:"), "conv_id").alias("case_id"), F.col("turn").cast("long").alias("narrative_id"), F.col("text").alias("narrative"),
    )
    words = turns.select("case_id", "narrative_id", F.posexplode(F.split("narrative", " ")).alias("at", "word"), F.split("narrative", " ").alias("all"))
    before = F.when(F.col("at") == 0, 0).otherwise(F.length(F.array_join(F.slice("all", F.lit(1), F.col("at")), " ")) + 1)
    confirmed = words.filter("word <> ''").select(
        "case_id", "narrative_id", F.struct("narrative_id", "at").alias("position"), before.alias("start"), (before + F.length("word")).alias("end"),
        F.col("word").alias("text"), F.concat(F.lit("W:"), F.lower("word")).alias("concept_id"), F.lit("words").alias("system"),
        F.col("word").alias("code"), F.lit("symptom").alias("kind"), F.lit("present").alias("status"),
    )
    observed = turns.select("case_id", F.lit("W:the").alias("concept_id"))
    narratives = turns.select("case_id", "narrative_id", "narrative", F.lit("en").alias("language"))
    return cases.confirm_mentions(observed, confirmed, narratives)["observations"].select("case_id", "concept_id", "code")


@query(
    "s16_guarded_text",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN '''=1' WHEN event_type = 'view' THEN '''  -x' ELSE event_type END AS text FROM events""",
)
def s16(spark, sf):
    """Event types with formula-like texts among them, guarded for spreadsheets."""
    kind = F.col("event_type")
    text = F.when(kind == "error", "=1").when(kind == "view", "  -x").otherwise(kind)
    return sinks.guard_text(tb.table(spark, sf, "events").select("event_id", text.alias("text")))

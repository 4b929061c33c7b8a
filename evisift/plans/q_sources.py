"""Sources, sinks and record checks: files are written from the tables into the shared folder and scanned back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evisift.operators import family, validate
from evisift.plans import oracle
from evisift.plans import testbed as tb
from evisift.plans.q_resolve import superseding
from evisift.plans.registry import query
from evisift.session import checkpoint_dir
from evisift.sources import jsonl, sinks, snapshot, tabular


def fresh_folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- RF2 files -----------------------------------------------------------------------------


def rf2(spark, sf):
    """Parts as an RF2 release: sizes above 40 are inactive, the type gives the name's suffix."""
    part = tb.table(spark, sf, "part")
    suffix = F.when(F.col("p_type") == "ECONOMY", " (disorder)").when(F.col("p_type") == "PROMO", " (finding)").otherwise(" (thing)")
    key = F.col("p_partkey").cast("string")
    tables = {
        "concepts": part.select(key.alias("id"), F.when(F.col("p_size") <= 40, "1").otherwise("0").alias("active")),
        "descriptions": part.select(
            F.concat(F.lit("d"), key).alias("id"), F.lit("1").alias("active"), key.alias("conceptId"), F.lit("en").alias("languageCode"),
            F.lit(tabular.RF2_FSN).alias("typeId"), F.concat("p_name", suffix).alias("term"),
        ),
        "relationships": part.select(
            F.concat(F.lit("r"), key).alias("id"), F.lit("1").alias("active"), key.alias("sourceId"),
            (F.col("p_partkey") + 1).cast("string").alias("destinationId"), F.lit(tabular.RF2_IS_A).alias("typeId"),
        ),
    }
    folder = fresh_folder(spark, "rf2")
    for name, rows in tables.items():
        rows.write.option("sep", "\t").option("header", True).option("quote", "").csv(f"{folder}/{name}")
    paths = [f"{folder}/{name}" for name in tables]
    return tabular.scan_rf2(spark, *paths, system="urn:evisift:rf2", release="rf2:1")


oracle.VIEWS["fx_rf2"] = """
  SELECT p_partkey, p_name, CASE p_type WHEN 'ECONOMY' THEN 'condition' WHEN 'PROMO' THEN 'finding' END AS kind FROM part WHERE p_size <= 40"""


@query("s7_rf2_concepts", "SELECT CAST(p_partkey AS VARCHAR) AS code, kind FROM fx_rf2 WHERE kind IS NOT NULL")
def s7_concepts(spark, sf):
    return rf2(spark, sf)["concept"].select(F.col("primary_code").alias("code"), "kind")


@query(
    "s7_rf2_designations",
    """SELECT p_name||CASE kind WHEN 'condition' THEN ' (disorder)' ELSE ' (finding)' END AS text, 'en' AS language, 'fully_specified_name' AS scope
    FROM fx_rf2 WHERE kind IS NOT NULL""",
)
def s7_designations(spark, sf):
    return rf2(spark, sf)["designation"].select("text", "language", "scope")


@query(
    "s7_rf2_problems",
    """SELECT CAST(p_partkey AS VARCHAR) AS id, 'unsupported_kind' AS problem FROM fx_rf2 WHERE kind IS NULL
    UNION ALL SELECT 'r'||p_partkey, 'edge_outside_subset' FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM fx_rf2 WHERE kind IS NOT NULL)
      OR p_partkey + 1 NOT IN (SELECT p_partkey FROM fx_rf2 WHERE kind IS NOT NULL)""",
)
def s7_problems(spark, sf):
    return rf2(spark, sf)["problem"]


# --- candidates, snapshots, outputs --------------------------------------------------------


@query(
    "s11_candidate_roundtrip",
    """SELECT 'C:'||doc_id AS candidate_assertion_id, source AS source_release_id, text AS subject_text, CAST(n_chars AS DOUBLE) AS value FROM documents""",
)
def s11(spark, sf):
    """Documents as candidates, written in id order and read back."""
    rows = tb.table(spark, sf, "documents").select(
        F.concat(F.lit("C:"), "doc_id").alias("candidate_assertion_id"), F.col("source").alias("source_release_id"),
        F.col("text").alias("subject_text"), F.col("n_chars").cast("double").alias("value"),
    )
    path = fresh_folder(spark, "candidates")
    jsonl.write_candidates(rows, path)
    return jsonl.read_candidates(spark, path).select(*rows.columns)


@query("s15_snapshot_roundtrip", "SELECT subject, relation, finding, polarity FROM fx_canonical")
def s15(spark, sf):
    """Canonical statements as a snapshot, read back with their logical hash checked."""
    rows = tb.canonical(spark, sf).select("canonical_id", "subject", "relation", "finding", "polarity")
    folder = fresh_folder(spark, "snapshot")
    snapshot.write_tables({"statement": rows}, folder, {"statement": "canonical_id"})
    digest = snapshot.table_hash(rows).first()["logical_sha256"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return snapshot.read_tables(spark, folder, {"statement": schema}, {"statement": digest})["statement"].drop("canonical_id")


@query(
    "s17_output_roundtrip",
    """SELECT event_id, event_type, 'json' AS kind FROM events UNION ALL SELECT event_id, event_type, 'csv' FROM events WHERE event_type <> 'view'""",
)
def s17(spark, sf):
    """All events as JSON lines and some as CSV below one folder."""
    rows = tb.table(spark, sf, "events").select("event_id", "event_type")
    folder = fresh_folder(spark, "outputs")
    sinks.write_outputs({"all": (rows, "json"), "some": (rows.filter("event_type <> 'view'"), "csv")}, folder)
    schema = "event_id bigint, event_type string"
    back = spark.read.schema(schema).json(f"{folder}/all").withColumn("kind", F.lit("json"))
    return back.unionByName(spark.read.schema(schema).option("header", True).csv(f"{folder}/some").withColumn("kind", F.lit("csv")))


@query(
    "s18_review_workbook",
    """SELECT o_orderkey AS item_id, o_orderpriority AS source_artifact_id, 'http://'||o_orderpriority AS source_url,
      coalesce((SELECT string_agg(DISTINCT 'E'||l_suppkey||':'||l_returnflag, ', ' ORDER BY 'E'||l_suppkey||':'||l_returnflag)
        FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = o_orderstatus), '') AS reviewed_by FROM orders""",
)
def s18(spark, sf):
    """Orders as records, priorities as sources, and lines of the order's status as reviews of this version."""
    order = tb.table(spark, sf, "orders")
    records = order.select(
        F.col("o_orderkey").alias("item_id"), F.lit("order").alias("item_type"), F.col("o_orderstatus").alias("item_sha256"),
        F.col("o_orderpriority").alias("source_artifact_id"),
    )
    sources = order.select(F.col("o_orderpriority").alias("artifact_id")).distinct().select(
        "artifact_id", F.concat(F.lit("http://"), "artifact_id").alias("source_url"), F.lit("1").alias("release")
    )
    reviews = tb.table(spark, sf, "lineitem").select(
        F.lit("order").alias("item_type"), F.col("l_orderkey").alias("item_id"), F.col("l_linestatus").alias("item_sha256"),
        F.concat(F.lit("E"), "l_suppkey").alias("reviewer_id"), F.col("l_returnflag").alias("decision"),
    )
    return sinks.review_workbook(records, sources, reviews).select("item_id", "source_artifact_id", "source_url", "reviewed_by")


@query(
    "h8_checksum_violations",
    """SELECT CAST(doc_id AS VARCHAR) AS name, CASE WHEN lang = 'es' THEN 'missing' ELSE 'checksum' END AS problem FROM documents
    WHERE lang = 'es' OR trim(text) <> text OR starts_with(text, 'The')""",
)
def h8(spark, sf):
    """Documents as artifacts: Spanish ones are missing, texts with an article in front were changed."""
    docs = tb.table(spark, sf, "documents").withColumn("name", F.col("doc_id").cast("string"))
    actual = docs.filter("lang <> 'es'").select("name", F.sha2("text", 256).alias("sha256"))
    changed = F.when(F.col("text").startswith("The"), F.concat("text", F.lit("."))).otherwise(F.btrim("text"))
    return snapshot.checksum_violations(actual, docs.select("name", F.sha2(changed, 256).alias("sha256")))


# --- record checks -------------------------------------------------------------------------


@query(
    "v7_case_problems",
    """WITH obs AS (SELECT case_id, observation_id, CASE WHEN ln = 5 THEN code||'x' ELSE code END AS concept_id, status,
        CASE WHEN ln = 6 THEN coalesce(supersedes, 'none') ELSE supersedes END AS supersedes, ln FROM fx_sup),
      ans AS (SELECT case_id, 'R:'||observation_id AS response_id, CASE WHEN ln = 2 THEN 'other' ELSE concept_id END AS concept_id,
        CASE WHEN ln = 7 THEN 'gone' ELSE observation_id END AS observation_id FROM obs),
      got AS (SELECT a.*, o.concept_id AS rc, o.status AS rs, o.supersedes AS old FROM ans a LEFT JOIN obs o USING (case_id, observation_id))
    SELECT l.case_id, l.observation_id AS item, CASE WHEN p.observation_id IS NULL THEN 'supersedes_unknown_observation' ELSE 'supersedes_other_concept' END AS problem
      FROM obs l LEFT JOIN obs p ON p.case_id = l.case_id AND p.observation_id = l.supersedes
      WHERE l.supersedes IS NOT NULL AND (p.observation_id IS NULL OR p.concept_id <> l.concept_id)
    UNION ALL SELECT case_id, response_id, CASE WHEN rc IS NULL THEN 'answer_without_observation' ELSE 'answer_for_other_concept' END FROM got
      WHERE rc IS NULL OR rc <> concept_id
    UNION ALL SELECT case_id, response_id, 'contradiction_not_superseded' FROM got g WHERE rc IS NOT NULL AND EXISTS (
      SELECT 1 FROM obs o WHERE o.case_id = g.case_id AND o.concept_id = g.rc AND o.status <> g.rs AND o.observation_id IS DISTINCT FROM g.old)""",
)
def v7(spark, sf):
    """Order lines as observations, each answered; some answers and references are broken on purpose."""
    line = tb.table(spark, sf, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("observation_id"), F.col("l_linenumber").alias("ln")
    )
    rows = superseding(spark, sf).join(line, "observation_id")
    ln = F.col("ln")
    obs = rows.select(
        "case_id", "observation_id", F.when(ln == 5, F.concat("code", F.lit("x"))).otherwise(F.col("code")).alias("concept_id"), "status",
        F.when(ln == 6, F.coalesce("supersedes", F.lit("none"))).otherwise(F.col("supersedes")).alias("supersedes"), "ln",
    )
    answers = obs.select(
        "case_id", F.concat(F.lit("R:"), "observation_id").alias("response_id"), F.when(ln == 2, "other").otherwise(F.col("concept_id")).alias("concept_id"),
        F.when(ln == 7, "gone").otherwise(F.col("observation_id")).alias("observation_id"),
    )
    return validate.case_v2(obs.drop("ln"), answers)


@query(
    "v8_value_problems",
    """WITH v AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'vital' WHEN 1 THEN 'laboratory' ELSE 'phenotype' END AS kind,
        l_returnflag = 'N' AS present, CASE l_linestatus WHEN 'O' THEN CASE WHEN l_linenumber > 4 THEN 'coded' ELSE 'quantity' END END AS value_kind FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN NOT present THEN 'value_without_presence' WHEN kind = 'vital' THEN 'vital_needs_quantity' ELSE 'laboratory_needs_value' END AS problem
    FROM v WHERE (NOT present AND value_kind IS NOT NULL) OR (present AND kind = 'vital' AND coalesce(value_kind, '') <> 'quantity')
      OR (present AND kind = 'laboratory' AND value_kind IS NULL)""",
)
def v8_values(spark, sf):
    line, n = tb.table(spark, sf, "lineitem"), F.col("l_linenumber")
    kind = F.when(n % 3 == 0, "vital").when(n % 3 == 1, "laboratory").otherwise("phenotype")
    value = F.when(F.col("l_linestatus") == "O", F.when(n > 4, "coded").otherwise("quantity"))
    status = F.when(F.col("l_returnflag") == "N", "present").otherwise("absent")
    return line.select("l_orderkey", "l_linenumber", validate.value_problem(kind, status, value).alias("problem")).filter("problem IS NOT NULL")


@query("v8_reversed_ranges", "SELECT l_orderkey, l_linenumber, 'reversed_range' AS problem FROM lineitem WHERE l_quantity > l_extendedprice / 1000")
def v8_ranges(spark, sf):
    return tb.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", validate.range_problem(F.col("l_quantity"), F.col("l_extendedprice") / 1000).alias("problem")
    ).filter("problem IS NOT NULL")


@query(
    "v16_manifest_markers",
    """SELECT o_orderkey::VARCHAR||CASE WHEN o_orderstatus = 'F' THEN '' ELSE '-dev-unreviewed' END AS snapshot,
      CASE WHEN o_orderstatus = 'F' THEN 'safeguards_without_unreviewed_name'
        WHEN o_orderpriority = '1-URGENT' THEN 'unreviewed_name_without_safeguards'
        WHEN o_orderpriority = '2-HIGH' THEN 'incomplete_safeguards' ELSE 'pending_items_not_listed' END AS problem
    FROM orders WHERE (o_orderstatus = 'F' AND o_orderpriority <> '1-URGENT')
      OR (o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM'))""",
)
def v16_manifest(spark, sf):
    """Orders as manifests: the status gives the name, the priority how complete the safeguards are."""
    p, marked = F.col("o_orderpriority"), F.col("o_orderpriority") != "1-URGENT"
    listed = F.when(marked & (p != "3-MEDIUM"), F.array(F.lit("a"))).otherwise(F.array().cast("array<string>"))
    rows = tb.table(spark, sf, "orders").select(
        F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderstatus") == "F", "").otherwise("-dev-unreviewed")).alias("snapshot"),
        F.when(marked, "unreviewed").alias("validation_status"), F.when(marked & (p != "2-HIGH"), "local_research_only").alias("intended_use"),
        F.when(marked, F.lit(False)).alias("clinical_validation"), F.when(marked, F.lit(False)).alias("human_review_complete"),
        F.when(marked, F.lit(False)).alias("publishable"), marked.alias("research_override_used"),
        listed.alias("unreviewed_assertion_ids"), listed.alias("unreviewed_mapping_ids"),
    )
    return validate.unreviewed_manifest_problem(rows)


@query(
    "v16_receipt_markers",
    """SELECT o_orderkey AS receipt_id, CASE WHEN o_orderstatus = 'O' THEN 'incomplete_safeguards' ELSE 'markers_on_reviewed_receipt' END AS problem
    FROM orders WHERE (o_orderstatus = 'O' AND o_orderpriority IN ('2-HIGH', '5-LOW')) OR (o_orderstatus <> 'O' AND o_orderpriority <> '5-LOW')""",
)
def v16_receipt(spark, sf):
    p = F.col("o_orderpriority")
    rows = tb.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("receipt_id"), (F.col("o_orderstatus") == "O").alias("research_unreviewed"),
        F.when(p != "5-LOW", "unreviewed").alias("knowledge_validation_status"), F.when(p != "5-LOW", "local_research_only").alias("intended_use"),
        (p != "5-LOW").alias("research_override_used"), F.when(p.isin("2-HIGH", "5-LOW"), 0).otherwise(1).alias("unreviewed_assertion_count"),
        F.lit(0).alias("unreviewed_mapping_count"),
    )
    return validate.unreviewed_receipt_problem(rows)


@query(
    "v17_profile_compatibility",
    """SELECT p.s_suppkey AS profile_id, c.c_custkey AS snapshot_id, CASE WHEN p.s_nationkey > 19 THEN 'strategy' WHEN p.s_suppkey % 3 = 0 THEN 'strategy_version'
      WHEN p.s_suppkey % 5 = 0 THEN 'score_scale' WHEN p.s_suppkey % 7 = 0 THEN 'score_kind' WHEN p.s_suppkey % 11 = 0 THEN 'calibrated_scale'
      WHEN p.s_suppkey % 13 = 0 AND c.c_custkey % 2 = 0 THEN 'snapshot' WHEN p.s_suppkey % 17 = 0 THEN 'profile_not_declared' END AS reason
    FROM supplier p JOIN customer c ON c.c_custkey % 100 IN (p.s_suppkey % 100, (p.s_suppkey + 1) % 100)""",
)
def v17(spark, sf):
    """Suppliers as profiles, nations as strategies, customers as snapshots of a hundred schema versions; a profile reads two versions."""
    n, version = F.col("s_suppkey"), F.col("c_custkey") % 100
    suppliers = tb.table(spark, sf, "supplier")
    profiles = suppliers.select(
        n.alias("profile_id"), F.col("s_nationkey").alias("strategy_id"), F.when(n % 3 == 0, "2").otherwise("1").alias("strategy_version"),
        F.when(n % 5 == 0, "y").otherwise("x").alias("scale_id"), F.when(n % 7 == 0, "b").otherwise("a").alias("scale_kind"), (n % 11 == 0).alias("calibrated"),
        F.explode(F.array(n % 100, (n + 1) % 100)).alias("snapshot_schema_version"),
    )
    snapshots = tb.table(spark, sf, "customer").select(F.col("c_custkey").alias("snapshot_id"), version.alias("snapshot_schema_version"))
    # every thirteenth profile is limited to the snapshots of odd number among those it can read
    allowed = profiles.filter("profile_id % 13 = 0").join(snapshots.filter("snapshot_id % 2 = 1"), "snapshot_schema_version").select("profile_id", "snapshot_id")
    declared = suppliers.filter("s_suppkey % 17 <> 0").select(F.col("s_nationkey").alias("strategy_id"), n.alias("profile_id"))
    strategies = tb.table(spark, sf, "nation").filter("n_nationkey <= 19").select(
        F.col("n_nationkey").alias("strategy_id"), F.lit("1").alias("descriptor_version"), F.lit("x").alias("descriptor_scale_id"), F.lit("a").alias("descriptor_scale_kind"),
    )
    return validate.profile_compatibility(profiles, strategies, snapshots, allowed, declared)

"""Audit, sampling and review-log queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evisift.operators import audit, hierarchy, resolve, review, sampling
from evisift.plans import testbed as tb
from evisift.plans.q_family import allowed, general_scope, scorable, universe
from evisift.plans.registry import query
from evisift.session import checkpoint_dir
from evisift.streaming import review_stream

STATUS_COLUMNS = ["relation", "polarity", "release", "family"]
QUOTAS = [("en", 20), ("toxic", 15), ("approved", 30), ("any", 40)]


def bridge(spark, sf):
    return tb.canonical_bridge(spark, sf)


@query(
    "a1_frequency_tables",
    """SELECT 'relation' AS attribute, relation AS value, count(*) AS n FROM fx_line GROUP BY 2
    UNION ALL SELECT 'polarity', polarity, count(*) FROM fx_line GROUP BY 2
    UNION ALL SELECT 'release', release, count(*) FROM fx_line GROUP BY 2
    UNION ALL SELECT 'family', family, count(*) FROM fx_line GROUP BY 2
    UNION ALL SELECT 'kind', kind, count(*) FROM fx_assertion GROUP BY 2""",
)
def a1(spark, sf):
    rows = tb.assertions(spark, sf).withColumn("kind", F.col("frequency.kind"))
    return audit.frequency_tables(rows, [*STATUS_COLUMNS, "kind"])


@query(
    "a2_histogram",
    """WITH p AS (SELECT subject, count(*) AS n FROM fx_canonical GROUP BY 1)
    SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 2 THEN '2' WHEN n <= 5 THEN '3-5' WHEN n <= 10 THEN '6-10'
      WHEN n <= 20 THEN '11-20' WHEN n <= 50 THEN '21-50' ELSE '51+' END AS bucket,
      count(*) AS subjects, CAST(sum(n) AS BIGINT) AS statements FROM p GROUP BY 1""",
)
def a2(spark, sf):
    return audit.per_subject_histogram(tb.canonical(spark, sf))


@query(
    "a2_thresholds",
    """WITH p AS (SELECT subject, count(*) AS n FROM fx_canonical GROUP BY 1)
    SELECT count(*) FILTER (n >= 5) AS at_least_5, count(*) FILTER (n >= 20) AS at_least_20,
      count(*) FILTER (n >= 40) AS at_least_40 FROM p""",
)
def a2t(spark, sf):
    return audit.threshold_counts(tb.canonical(spark, sf), [5, 20, 40])


def markers(spark, sf):
    customer = tb.table(spark, sf, "customer")
    key = F.concat(F.lit("C:"), "c_custkey").alias("subject")
    return {
        "machinery": customer.filter("c_mktsegment = 'MACHINERY'").select(key),
        "negative": customer.filter("c_acctbal < 0").select(key),
        "rich": customer.filter("c_acctbal > 5000").select(key),
    }


@query(
    "a3_exclusive_classes",
    """SELECT 'C:'||c_custkey AS subject, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'machinery'
      WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'unclassified' END AS class,
      CAST((c_mktsegment = 'MACHINERY') AS INTEGER) + CAST((c_acctbal < 0) AS INTEGER)
        + CAST((c_acctbal > 5000) AS INTEGER) AS markers
    FROM customer WHERE 'C:'||c_custkey IN (SELECT subject FROM fx_line)""",
)
def a3(spark, sf):
    return audit.exclusive_classes(tb.canonical(spark, sf), markers(spark, sf))


@query(
    "a4_domain_by_release",
    """SELECT coalesce(domain, 'unclassified') AS domain, release, count(*) AS assertions, count(DISTINCT subject) AS subjects
    FROM fx_line LEFT JOIN (SELECT node AS finding, ancestor AS domain FROM fx_closure WHERE ancestor LIKE 'B:%') USING (finding)
    GROUP BY 1, 2""",
)
def a4(spark, sf):
    """Assertions per brand of their finding and release."""
    roots = tb.edges(spark, sf).filter(F.col("parent").startswith("B:")).select(
        F.col("parent").alias("root"), F.col("parent").alias("domain")
    ).distinct()
    domains = hierarchy.domain_assignment(tb.closure(spark, sf), roots)
    rows = tb.assertions(spark, sf).select(F.col("finding"), F.col("subject").alias("who"), "release")
    found = audit.cross_counts(
        rows.withColumnRenamed("finding", "subject"), domains.withColumnRenamed("concept_id", "subject")
    ).drop("subjects")
    joined = rows.join(domains.withColumnRenamed("concept_id", "finding"), "finding", "left")
    subjects = joined.groupBy(F.coalesce("domain", F.lit("unclassified")).alias("domain"), "release").agg(
        F.count_distinct("who").alias("subjects")
    )
    return found.join(subjects, ["domain", "release"])


_OPP = """o AS (SELECT finding, relation, count(DISTINCT subject) FILTER (polarity = 'present') AS present,
    count(DISTINCT subject) FILTER (polarity = 'excluded') AS excluded FROM fx_canonical GROUP BY 1, 2)"""


@query(
    "a5_opposing",
    f"WITH {_OPP} SELECT finding, relation, present, excluded, least(present, excluded) AS separation FROM o WHERE present > 0 AND excluded > 0",
)
def a5(spark, sf):
    return audit.opposing_findings(tb.canonical(spark, sf))


@query(
    "a5_strongest",
    f"""WITH {_OPP} SELECT finding, relation, present, excluded, least(present, excluded) AS separation FROM o
    WHERE present > 0 AND excluded > 0 ORDER BY separation DESC, present + excluded DESC, finding, relation LIMIT 12""",
)
def a5_top(spark, sf):
    rows = audit.opposing_findings(tb.canonical(spark, sf))
    return audit.top_k(
        rows, 12, F.col("separation").desc(), (F.col("present") + F.col("excluded")).desc(), F.col("finding"), F.col("relation")
    )


@query(
    "a5_subjects_with_discriminant",
    f"""WITH {_OPP} SELECT count(DISTINCT subject) AS subjects FROM fx_canonical
    WHERE (finding, relation) IN (SELECT (finding, relation) FROM o WHERE present > 0 AND excluded > 0)""",
)
def a5_subjects(spark, sf):
    statements = tb.statements(spark, sf)
    return audit.subjects_with_discriminant(statements, audit.opposed(statements))


@query(
    "a6_dedup_statistics",
    """WITH p AS (SELECT subject, relation, finding, polarity, count(DISTINCT source_id) AS s, count(DISTINCT release) AS r
      FROM fx_line GROUP BY ALL)
    SELECT CAST(sum(s) AS BIGINT) AS source_assertions, count(*) AS canonical_assertions,
      CAST(sum(s) - count(*) AS BIGINT) AS collapsed, count(*) FILTER (r > 1) AS multi_release,
      (SELECT count(DISTINCT (subject, relation, finding, polarity)) FROM fx_statement_family JOIN fx_universe USING (subject)
        WHERE family IN (SELECT family FROM fx_family WHERE dependency_type <> 'unknown')) AS scorable_canonical FROM p""",
)
def a6(spark, sf):
    return audit.dedup_statistics(bridge(spark, sf), scorable(spark, sf))


@query(
    "a7_overlap",
    """WITH d AS (SELECT DISTINCT subject, relation, finding, polarity, release FROM fx_line)
    SELECT a.release AS release_a, b.release AS release_b, count(*) AS shared FROM d a JOIN d b
      USING (subject, relation, finding, polarity) WHERE a.release < b.release GROUP BY 1, 2""",
)
def a7(spark, sf):
    return audit.release_overlap(bridge(spark, sf))


@query(
    "a8_eligibility",
    """WITH s AS (SELECT * FROM fx_line WHERE family IN (SELECT family FROM fx_family WHERE dependency_type <> 'unknown')
        AND subject IN (SELECT subject FROM fx_universe))
    SELECT count(DISTINCT (subject, relation, finding, polarity)) AS statements, count(DISTINCT subject) AS subjects,
      count(DISTINCT finding) AS findings, count(DISTINCT (subject, finding)) AS pairs FROM s""",
)
def a8(spark, sf):
    return audit.eligibility_counts(scorable(spark, sf))


@query(
    "a9_single_release_subjects",
    "SELECT subject FROM fx_scope GROUP BY 1 HAVING count(DISTINCT family) = 1 AND min(family) = '3-MEDIUM'",
)
def a9(spark, sf):
    """Subjects of the scope that one family alone documents."""
    rows = general_scope(spark, sf).select("subject", F.col("family").alias("release"))
    return audit.single_release_subjects(rows, "3-MEDIUM")


@query(
    "a10_subject_profiles",
    """SELECT subject, count(*) AS sources, count(DISTINCT (relation, finding, polarity)) AS statements,
      count(DISTINCT finding) AS findings, string_agg(DISTINCT release, ', ' ORDER BY release) AS releases,
      string_agg(DISTINCT family, ', ' ORDER BY family) AS families,
      string_agg(DISTINCT relation, ', ' ORDER BY relation) AS relations FROM fx_line GROUP BY 1""",
)
def a10(spark, sf):
    return audit.subject_profiles(bridge(spark, sf))


@query(
    "a10_top_findings",
    "SELECT finding, count(*) AS statements, count(DISTINCT subject) AS subjects FROM fx_canonical GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
)
def a10_top(spark, sf):
    rows = tb.canonical(spark, sf).groupBy("finding").agg(
        F.count("*").alias("statements"), F.count_distinct("subject").alias("subjects")
    )
    return audit.top_k(rows, 20, F.col("statements").desc(), F.col("finding"))


@query(
    "a11_stratified_sample",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY md5(candidate_id), candidate_id) AS position
      FROM fx_candidate) SELECT candidate_id, lang, source, status, position FROM r WHERE position <= 3""",
)
def a11(spark, sf):
    rows = tb.candidates(spark, sf).select("candidate_id", "lang", "source", "status")
    return sampling.stratified(rows, ["lang", "source"], "candidate_id", 3)


@query(
    "a12_sample_enrichment",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY release, polarity ORDER BY md5(source_id), source_id) AS n FROM fx_line)
    SELECT source_id, r.subject, finding, release, dependency_type, c_mktsegment AS segment,
      (SELECT count(*) FROM fx_line x WHERE x.subject = r.subject AND x.finding = r.finding) AS same_pair
    FROM r JOIN fx_family USING (family) JOIN customer ON 'C:'||c_custkey = r.subject WHERE n <= 5""",
)
def a12(spark, sf):
    """Sampled assertions with family, subject class and sibling count."""
    rows = bridge(spark, sf)
    picked = sampling.stratified(rows, ["release", "polarity"], "source_id", 5)
    siblings = rows.groupBy("subject", "finding").agg(F.count("*").alias("same_pair"))
    customer = tb.table(spark, sf, "customer").select(
        F.concat(F.lit("C:"), "c_custkey").alias("subject"), F.col("c_mktsegment").alias("segment")
    )
    return (
        picked.join(tb.families(spark, sf), "family").join(customer, "subject")
        .join(siblings, ["subject", "finding"])
        .select("source_id", "subject", "finding", "release", "dependency_type", "segment", "same_pair")
    )


def pools(spark, sf):
    rows = tb.candidates(spark, sf)
    member = F.array_compact(
        F.array(
            F.when(F.col("lang") == "en", "en"), F.when(F.col("toxic") == 1, "toxic"),
            F.when(F.col("status") == "approved", "approved"), F.lit("any"),
        )
    )
    return rows.select(F.explode(member).alias("stratum"), "candidate_id")


@query(
    "a13_quota_sample",
    """WITH c AS (SELECT *, sha256(candidate_id) AS h FROM fx_candidate),
      s1 AS (SELECT candidate_id FROM c WHERE lang = 'en' ORDER BY h, candidate_id LIMIT 20),
      s2 AS (SELECT candidate_id FROM c WHERE toxic = 1 AND candidate_id NOT IN (SELECT * FROM s1)
        ORDER BY h, candidate_id LIMIT 15),
      s3 AS (SELECT candidate_id FROM c WHERE status = 'approved' AND candidate_id NOT IN (SELECT * FROM s1)
        AND candidate_id NOT IN (SELECT * FROM s2) ORDER BY h, candidate_id LIMIT 30),
      s4 AS (SELECT candidate_id FROM c WHERE candidate_id NOT IN (SELECT * FROM s1)
        AND candidate_id NOT IN (SELECT * FROM s2) AND candidate_id NOT IN (SELECT * FROM s3)
        ORDER BY h, candidate_id LIMIT 40)
    SELECT 'en' AS stratum, candidate_id FROM s1 UNION ALL SELECT 'toxic', candidate_id FROM s2
    UNION ALL SELECT 'approved', candidate_id FROM s3 UNION ALL SELECT 'any', candidate_id FROM s4""",
)
def a13(spark, sf):
    return sampling.sequential_quota(pools(spark, sf), QUOTAS, "candidate_id")


def _greedy_sql(domains: list[str]) -> str:
    """A pass per domain and one over all, each without what the passes before have taken."""
    parts = ["c AS (SELECT candidate_id AS id, source||'/'||status AS topic, lang, sha256(candidate_id) AS h FROM fx_candidate)"]
    before = "SELECT id, topic FROM c WHERE false"
    for i, (name, pool, size) in enumerate([*((d, f"lang = '{d}'", "12") for d in domains), ("rest", "true", "120 - (SELECT count(*) FROM t)")]):
        taken = before if i == 0 else " UNION ALL ".join(f"SELECT id, topic FROM p{k}" for k in range(i))
        parts.append(
            f"""p{i} AS (WITH t AS ({taken}), f AS (SELECT id, topic, h, row_number() OVER (PARTITION BY topic ORDER BY h, id) AS n
        FROM (SELECT DISTINCT id, topic, h FROM c WHERE {pool}) WHERE id NOT IN (SELECT id FROM t)),
      o AS (SELECT id, topic, row_number() OVER (ORDER BY h, id) AS r FROM f WHERE n <= 3 - (SELECT count(*) FROM t WHERE t.topic = f.topic))
      SELECT id, topic, '{name}' AS pass FROM o WHERE r <= {size})"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(len(domains) + 1))
    return f"WITH {', '.join(parts)} {every}"


@query("a14_capped_greedy_sample", _greedy_sql(["en", "de", "fr", "es"]))
def a14(spark, sf):
    """At most twelve per language and three per source, one hundred twenty in all."""
    rows = tb.candidates(spark, sf).select(
        F.col("candidate_id").alias("id"), F.concat_ws("/", "source", "status").alias("topic"),
        F.col("lang").alias("domain"),
    )
    return sampling.capped_greedy(
        rows, ["en", "de", "fr", "es"], per_domain=12, per_topic=3, total=120
    )


@query(
    "a15_round_robin",
    """WITH r AS (SELECT candidate_id, lang, status, row_number() OVER (PARTITION BY lang, status
        ORDER BY sha256(candidate_id), candidate_id) AS round FROM fx_candidate)
    SELECT candidate_id, lang, status, round FROM r ORDER BY round, sha256(lang||'|'||status) LIMIT 180""",
)
def a15(spark, sf):
    rows = tb.candidates(spark, sf).select("candidate_id", "lang", "status")
    return sampling.round_robin(rows, ["lang", "status"], "candidate_id", 180)


@query(
    "a16_control_sample",
    """WITH c AS (SELECT candidate_id, lang, source, status, sha256(candidate_id) AS h, sha256(lang||'|'||source) AS k FROM fx_candidate),
      i AS (SELECT status, row_number() OVER (ORDER BY status) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT status FROM c)),
      r AS (SELECT *, row_number() OVER (PARTITION BY status, lang, source ORDER BY h, candidate_id) AS turn FROM c),
      n AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY turn, k) AS place FROM r),
      p AS (SELECT candidate_id, lang, source, n.status FROM n JOIN i USING (status) WHERE place <= 180 // i.n + CAST(i.i < 180 % i.n AS INT)),
      l AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h, candidate_id) AS turn FROM c WHERE candidate_id NOT IN (SELECT candidate_id FROM p)),
      m AS (SELECT *, row_number() OVER (ORDER BY turn, k) AS place FROM l)
    SELECT * FROM p UNION ALL SELECT candidate_id, lang, source, status FROM m WHERE place <= 180 - (SELECT count(*) FROM p)""",
)
def a16(spark, sf):
    rows = tb.candidates(spark, sf).select("candidate_id", "lang", "source", "status")
    return sampling.control(rows, ["lang", "source"], "candidate_id", "status", 180)


@query(
    "a17_topic_rollup",
    """SELECT source AS topic_id, count(*) AS candidates, min(lang) AS title, min(status) AS subject_status
    FROM fx_candidate GROUP BY 1""",
)
def a17(spark, sf):
    rows = tb.candidates(spark, sf).select(
        F.col("source").alias("topic_id"), F.col("lang").alias("title"), F.col("status").alias("subject_status")
    )
    return audit.topic_rollup(rows)


@query(
    "a18_mapping_suggestions",
    """WITH t AS (SELECT 'S:'||s_suppkey AS topic_id, 'supplier '||s_suppkey AS label, s_nationkey AS heading FROM supplier),
      l AS (SELECT 'supplier '||c_custkey AS label, 'C:'||c_custkey AS code FROM customer WHERE c_mktsegment = 'MACHINERY'),
      h AS (SELECT n_nationkey AS heading, 'N:'||n_nationkey AS code FROM nation WHERE n_regionkey <= 2),
      a AS (SELECT DISTINCT topic_id, code FROM t JOIN l USING (label)),
      b AS (SELECT DISTINCT topic_id, code FROM t JOIN h USING (heading)),
      m AS (SELECT coalesce(a.topic_id, b.topic_id) AS topic_id, coalesce(a.code, b.code) AS code,
        concat_ws('; ', CASE WHEN b.code IS NOT NULL THEN 'heading' END,
          CASE WHEN a.code IS NOT NULL THEN 'normalized_label' END) AS basis
        FROM a FULL JOIN b ON a.topic_id = b.topic_id AND a.code = b.code)
    SELECT t.topic_id, coalesce(code, '') AS code, coalesce(basis, '') AS basis FROM t LEFT JOIN m USING (topic_id)""",
)
def a18(spark, sf):
    """Supplier topics against customer labels and nation headings."""
    topics = tb.table(spark, sf, "supplier").select(
        F.concat(F.lit("S:"), "s_suppkey").alias("topic_id"),
        F.concat(F.lit("supplier "), "s_suppkey").alias("label"), F.col("s_nationkey").alias("heading"),
    )
    labels = tb.table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(
        F.concat(F.lit("supplier "), "c_custkey").alias("label"), F.concat(F.lit("C:"), "c_custkey").alias("code")
    )
    headings = tb.table(spark, sf, "nation").filter("n_regionkey <= 2").select(
        F.col("n_nationkey").alias("heading"), F.concat(F.lit("N:"), "n_nationkey").alias("code")
    )
    return audit.mapping_suggestions(topics, labels, headings)


@query(
    "a19_dependency_rows",
    """SELECT release, family, dependency_type, count(*) AS assertions, count(DISTINCT subject) AS subjects
    FROM fx_line JOIN fx_family USING (family) GROUP BY 1, 2, 3""",
)
def a19(spark, sf):
    return tb.lines(spark, sf).join(tb.families(spark, sf), "family").groupBy(
        "release", "family", "dependency_type"
    ).agg(F.count("*").alias("assertions"), F.count_distinct("subject").alias("subjects"))


@query(
    "a20_adjudication_dataset",
    """SELECT candidate_id, CASE WHEN count(*) OVER (PARTITION BY source) >= 20 THEN 'frequent_in_candidates'
        ELSE 'less_frequent_in_candidates' END AS band,
      CASE status WHEN 'unreviewed' THEN 0 WHEN 'approved' THEN 1 ELSE 2 END AS priority FROM fx_candidate""",
)
def a20(spark, sf):
    """Candidates with the frequency band of their source and their review priority."""
    rows = tb.candidates(spark, sf)
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    return rows.join(counts, "source").select(
        "candidate_id",
        F.when(F.col("n") >= 20, "frequent_in_candidates").otherwise("less_frequent_in_candidates").alias("band"),
        F.when(F.col("status") == "unreviewed", 0).when(F.col("status") == "approved", 1).otherwise(2).alias("priority"),
    )


@query(
    "a21_pinned_counts",
    """SELECT 'approved' AS metric, CAST(1 AS BIGINT) AS expected, count(*) FILTER (status = 'approved') AS value FROM fx_candidate
    UNION ALL SELECT 'documents', 0, count(*) FROM fx_candidate""",
)
def a21(spark, sf):
    """Counts that differ from what was pinned; both pins are wrong on purpose."""
    actual = tb.candidates(spark, sf).agg(
        F.count("*").alias("documents"), F.count_if(F.col("status") == "approved").alias("approved")
    ).select(
        F.inline(
            F.array(
                F.struct(F.lit("documents").alias("metric"), F.col("documents").alias("value")),
                F.struct(F.lit("approved").alias("metric"), F.col("approved").alias("value")),
            )
        )
    )
    pinned = spark.createDataFrame([("documents", 0), ("approved", 1)], "metric string, value bigint")
    return audit.expectations(actual, pinned)


# --- review log ----------------------------------------------------------------------------


def events(spark, sf):
    return tb._memo(spark, sf, "review_events", lambda: tb.review_events(spark, sf))


@query("r1_latest_review", "SELECT item, reviewer, decision, category, mapping, event_hash, sequence FROM fx_latest")
def r1(spark, sf):
    return review.latest_reviews(events(spark, sf))


@query("r2_agreement", "SELECT * FROM fx_agreement")
def r2(spark, sf):
    return review.agreement(events(spark, sf))


@query("r7_agreement_stream", "SELECT * FROM fx_agreement")
def r7(spark, sf):
    """The event log as a stream of three files, one a trigger; the last state of every item."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/review-stream-{uuid.uuid4().hex}"
    log = events(spark, sf)
    log.repartition(3, "event_hash").write.parquet(f"{folder}/log")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/log")

    def keep(batch, number):
        batch.write.parquet(f"{folder}/states/batch={number}")

    stream = (
        review_stream.agreement_stream(source).writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    columns = ["item", "reviewers", "reviewed", "agreement", "disagreement", "deferred", "adjudicated", "unresolved"]
    states = spark.read.parquet(f"{folder}/states")
    last = states.groupBy("item").agg(F.max_by(F.struct(*columns[1:]), "batch").alias("s"))
    return last.select("item", *(f"s.{c}" for c in columns[1:]))


@query(
    "r3_queue_progress",
    """WITH c AS (SELECT strftime(ts, '%Y-%m-%d')||':'||(user_id // 10) AS item, event_type FROM events GROUP BY 1, 2),
      q AS (SELECT DISTINCT item FROM c WHERE contains(item, '-1'))
    SELECT count(*) AS total, count(*) FILTER (reviewed) AS reviewed, count(*) FILTER (agreement) AS agreement,
      count(*) FILTER (disagreement) AS disagreement, count(*) FILTER (deferred) AS deferred,
      count(*) FILTER (unresolved) AS unresolved, count(*) FILTER (adjudicated) AS adjudicated
    FROM q LEFT JOIN fx_agreement USING (item)""",
)
def r3(spark, sf):
    """Progress of the items whose name contains a text."""
    rows = events(spark, sf).select("item").distinct()
    return review.progress(review.queue(rows, review.agreement(events(spark, sf)), {"item": "-1"}))


@query(
    "r4_disagreement_export",
    """SELECT item, reviewer, stage, decision, category, sequence, event_hash FROM fx_review
    WHERE item IN (SELECT item FROM fx_agreement WHERE disagreement)""",
)
def r4(spark, sf):
    log = events(spark, sf)
    return review.export(log, review.agreement(log), "disagreements").select(
        "item", "reviewer", "stage", "decision", "category", "sequence", "event_hash"
    )


LOG = ["item", "reviewer", "stage", "decision", "category", "sequence", "event_hash"]


@query("r4_individual_export", "SELECT item, reviewer, stage, decision, category, sequence, event_hash FROM fx_review WHERE stage <> 'adjudication'")
def r4_individual(spark, sf):
    log = events(spark, sf)
    return review.export(log, log, "individual_decisions").select(*LOG)


@query("r4_adjudication_export", "SELECT item, reviewer, stage, decision, category, sequence, event_hash FROM fx_review WHERE stage = 'adjudication'")
def r4_adjudications(spark, sf):
    log = events(spark, sf)
    return review.export(log, log, "adjudications").select(*LOG)


@query(
    "r4_summary_export",
    """SELECT count(*) AS total, count(*) FILTER (reviewed) AS reviewed, count(*) FILTER (agreement) AS agreement, count(*) FILTER (disagreement) AS disagreement,
      count(*) FILTER (deferred) AS deferred, count(*) FILTER (unresolved) AS unresolved, count(*) FILTER (adjudicated) AS adjudicated FROM fx_agreement""",
)
def r4_summary(spark, sf):
    log = events(spark, sf)
    return review.export(log, review.agreement(log), "summary")


@query(
    "r4_control_export",
    "SELECT decision, count(*) AS reviews FROM fx_latest WHERE item IN (SELECT item FROM fx_review WHERE category = 'minor') GROUP BY 1",
)
def r4_control(spark, sf):
    """Current reviews of the items with any minor event, which stand in for a control sample."""
    log = events(spark, sf)
    samples = log.filter("category = 'minor'").select("item").distinct()
    return review.export(log, log, "control", samples)


@query(
    "r5_current_decision",
    """SELECT item, stage, arg_max(decision, sequence) AS decision, max(sequence) AS sequence,
      arg_max(event_hash, sequence) AS event_hash FROM fx_review GROUP BY 1, 2""",
)
def r5(spark, sf):
    return review.current_decisions(events(spark, sf), ["item", "stage"]).select(
        "item", "stage", "decision", "sequence", "event_hash"
    )


@query(
    "r6_admissibility",
    """WITH p AS (SELECT sequence, item, reviewer, stage, decision, mapping, basis FROM fx_review),
      own AS (SELECT DISTINCT item, reviewer FROM fx_latest),
      h AS (SELECT item, list_sort(list(event_hash)) AS hashes FROM fx_latest GROUP BY 1)
    SELECT sequence AS proposal_id, CASE
      WHEN mapping IS NOT NULL THEN 'relation_not_allowed'
      WHEN stage = 'adjudication' AND (a.reviewers < 2 OR a.agreement) THEN 'needs_two_unresolved_reviews'
      WHEN stage = 'adjudication' AND own.item IS NOT NULL THEN 'adjudicator_not_distinct'
      WHEN stage = 'adjudication' AND list_sort(p.basis) <> coalesce(h.hashes, CAST([] AS VARCHAR[]))
        THEN 'needs_current_hashes_and_justification'
      WHEN stage = 'review' AND len(p.basis) > 0 THEN 'review_must_be_independent' END AS reason
    FROM p JOIN fx_agreement a USING (item) LEFT JOIN own ON own.item = p.item AND own.reviewer = p.reviewer
      LEFT JOIN h ON h.item = p.item""",
)
def r6(spark, sf):
    """Every logged decision proposed once more against the finished log."""
    log = events(spark, sf)
    proposals = log.select(
        F.col("sequence").alias("proposal_id"), "item", F.col("item").alias("row_id"),
        F.lit("assertion").alias("dataset"), "reviewer", "stage", "decision", "mapping",
        F.lit("checked").alias("comment"), "basis",
    )
    rows = log.select("item").distinct().select("item", F.col("item").alias("row_id"), F.lit("").alias("code"))
    return review.admissibility(proposals, rows, log)


@query(
    "v15_hash_chain",
    """WITH e AS (SELECT event_id + 1 AS sequence, user_id, md5(concat_ws('|', event_id + 1, user_id, event_type)) AS event_hash,
        event_type FROM events),
      c AS (SELECT e.*, CASE WHEN e.event_type = 'error' THEN 'broken' ELSE coalesce(p.event_hash, 'genesis') END AS previous_hash,
        coalesce(p.event_hash, 'genesis') AS expected FROM e LEFT JOIN e p ON p.sequence = e.sequence - 1)
    SELECT sequence, CASE WHEN previous_hash <> expected THEN 'previous_hash' END AS problem FROM c WHERE previous_hash <> expected""",
)
def v15(spark, sf):
    """A chain over the whole event log whose links are broken at every error event."""
    event = tb.table(spark, sf, "events")
    digest = F.md5(F.concat_ws("|", F.col("sequence").cast("string"), F.col("user_id").cast("string"), "event_type"))
    rows = event.select(
        (F.col("event_id") + 1).alias("sequence"), "user_id", "event_type",
        F.concat(F.lit("U:"), "user_id").alias("row_id"),
    ).withColumn("event_hash", digest)
    before = rows.select((F.col("sequence") + 1).alias("sequence"), F.col("event_hash").alias("previous"))
    chained = rows.join(before, "sequence", "left").withColumn(
        "previous_hash",
        F.when(F.col("event_type") == "error", "broken").otherwise(F.coalesce("previous", F.lit("genesis"))),
    )
    return review.chain_violations(chained, rows, digest, "genesis")

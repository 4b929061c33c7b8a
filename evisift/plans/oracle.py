"""SQL twins of the canonical views, composed into one WITH clause per checked query."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["fx_edge"] = """
  SELECT DISTINCT child, parent FROM (
    SELECT 'F:'||p_partkey AS child, 'S:'||(p_partkey // 10) AS parent FROM part
    UNION ALL SELECT 'F:'||p_partkey, 'K:'||p_type||'|'||p_brand FROM part
    UNION ALL SELECT 'S:'||(p_partkey // 10), 'ROOT' FROM part
    UNION ALL SELECT 'K:'||p_type||'|'||p_brand, 'T:'||p_type FROM part
    UNION ALL SELECT 'K:'||p_type||'|'||p_brand, 'B:'||p_brand FROM part
    UNION ALL SELECT 'T:'||p_type, 'ROOT' FROM part
    UNION ALL SELECT 'B:'||p_brand, 'ROOT' FROM part)"""

VIEWS["fx_node"] = "SELECT child AS node FROM fx_edge UNION SELECT parent FROM fx_edge"

# the hierarchy is at most three levels deep below ROOT
VIEWS["fx_closure"] = """
  SELECT node, node AS ancestor FROM fx_node
  UNION SELECT child, parent FROM fx_edge
  UNION SELECT a.child, b.parent FROM fx_edge a JOIN fx_edge b ON a.parent = b.child
  UNION SELECT a.child, c.parent FROM fx_edge a JOIN fx_edge b ON a.parent = b.child
    JOIN fx_edge c ON b.parent = c.child"""

VIEWS["fx_line"] = """
  SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS source_id,
    'C:'||o_custkey AS subject,
    CASE WHEN l_linenumber = 7 THEN 'S:'||(l_partkey // 10) ELSE 'F:'||l_partkey END AS finding,
    CASE WHEN l_linestatus = 'O' THEN 'has_symptom' ELSE 'has_sign' END AS relation,
    CASE WHEN l_returnflag = 'A' THEN 'excluded' ELSE 'present' END AS polarity,
    CASE WHEN l_returnflag = 'A' THEN 'HP:0040285'
      WHEN round(l_tax * 100) <= 1 THEN NULL
      WHEN round(l_tax * 100) <= 3 THEN 'HP:004028'||least(l_linenumber, 4)
      WHEN round(l_tax * 100) <= 5
        THEN least(CAST(l_quantity AS INTEGER), 9)||'/'||CAST(l_quantity AS INTEGER)
      WHEN round(l_tax * 100) <= 6 THEN CAST(round(l_discount * 100) AS INTEGER)||'%'
      ELSE CAST(round(l_discount * 100) AS INTEGER)||'-'||
           (CAST(round(l_discount * 100) AS INTEGER) + CAST(l_quantity AS INTEGER))||' %'
    END AS frequency_raw,
    'rel:'||o_orderstatus AS release, o_orderpriority AS family,
    'O:'||o_orderkey AS record_id, 'E:'||l_suppkey AS curator
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""

VIEWS["fx_band"] = """
  SELECT * FROM (VALUES ('HP:0040280', 1.0::DOUBLE, 1.0::DOUBLE), ('HP:0040281', 0.80, 0.99),
    ('HP:0040282', 0.30, 0.79), ('HP:0040283', 0.05, 0.29), ('HP:0040284', 0.01, 0.04),
    ('HP:0040285', 0.0, 0.0)) AS b(code, lo, hi)"""

VIEWS["fx_assertion"] = """
  SELECT l.*,
    CASE WHEN frequency_raw IS NULL THEN 'missing' WHEN frequency_raw = 'HP:0040285' THEN 'excluded'
      WHEN lo IS NOT NULL THEN 'category' WHEN frequency_raw LIKE '%/%' THEN 'count'
      WHEN frequency_raw LIKE '%-%' THEN 'interval' ELSE 'percentage' END AS kind,
    CASE WHEN frequency_raw IS NULL THEN NULL WHEN lo IS NOT NULL THEN (lo + hi) / 2
      WHEN frequency_raw LIKE '%/%'
        THEN (CAST(split_part(frequency_raw, '/', 1) AS DOUBLE) + 1)
             / (CAST(split_part(frequency_raw, '/', 2) AS DOUBLE) + 2)
      WHEN frequency_raw LIKE '%-%'
        THEN (CAST(split_part(frequency_raw, '-', 1) AS DOUBLE) / 100
              + CAST(replace(split_part(frequency_raw, '-', 2), ' %', '') AS DOUBLE) / 100) / 2
      ELSE CAST(replace(frequency_raw, '%', '') AS DOUBLE) / 100 END AS estimate
  FROM fx_line l LEFT JOIN fx_band ON frequency_raw = code"""

VIEWS["fx_canonical"] = "SELECT DISTINCT subject, relation, finding, polarity FROM fx_line"
VIEWS["fx_statement_family"] = """
  SELECT DISTINCT subject, relation, finding, polarity, family FROM fx_line"""

VIEWS["fx_family"] = """
  SELECT DISTINCT o_orderpriority AS family,
    CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown' ELSE 'primary' END AS dependency_type
  FROM orders"""

VIEWS["fx_weight"] = """
  SELECT * FROM (VALUES ('1-URGENT', 2.0::DOUBLE), ('2-HIGH', 1.5), ('3-MEDIUM', 1.0),
    ('4-NOT SPECIFIED', 1.0)) AS w(family, weight)"""

VIEWS["fx_obs"] = """
  SELECT 'O:'||l_orderkey AS case_id,
    CASE WHEN l_linenumber = 7 THEN 'S:'||(l_partkey // 10) ELSE 'F:'||l_partkey END AS finding,
    min(CASE WHEN l_linestatus = 'O' THEN 'has_symptom' ELSE 'has_sign' END) AS relation,
    CASE WHEN max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) = 1 THEN 'present'
      WHEN max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 1 THEN 'absent'
      ELSE 'unknown' END AS status
  FROM lineitem GROUP BY 1, 2"""

VIEWS["fx_positive"] = "SELECT DISTINCT subject, finding FROM fx_line WHERE polarity = 'present'"
VIEWS["fx_propagated"] = """
  SELECT DISTINCT subject, ancestor AS node FROM fx_positive JOIN fx_closure ON finding = node"""
VIEWS["fx_ic"] = """
  SELECT node, count(*) AS subjects,
    -ln(count(*)::DOUBLE / (SELECT count(DISTINCT subject) FROM fx_positive)) + 0.0 AS ic
  FROM fx_propagated GROUP BY node"""
VIEWS["fx_conflict"] = """
  SELECT subject, finding FROM fx_line GROUP BY 1, 2
  HAVING count(DISTINCT coalesce(frequency_raw, '-')) > 1"""

VIEWS["fx_present"] = """
  SELECT case_id, finding AS query, count(*) OVER (PARTITION BY case_id) AS n_present
  FROM fx_obs WHERE status = 'present'"""
VIEWS["fx_absent"] = "SELECT case_id, finding AS query FROM fx_obs WHERE status = 'absent'"
VIEWS["fx_candidate_pair"] = """
  SELECT DISTINCT case_id, subject FROM (
    SELECT case_id, subject FROM fx_present JOIN fx_propagated ON query = node
    UNION ALL
    SELECT case_id, p.subject FROM fx_present JOIN fx_closure c ON query = c.node
      AND c.ancestor <> c.node JOIN fx_positive p ON p.finding = c.ancestor)"""
VIEWS["fx_triple"] = "SELECT case_id, subject, query, n_present FROM fx_candidate_pair JOIN fx_present USING (case_id)"
VIEWS["fx_support"] = """
  SELECT subject, query, max(ic) AS ic FROM (SELECT DISTINCT subject, query FROM fx_triple)
    JOIN fx_closure c ON query = c.node
    JOIN fx_propagated p USING (subject) JOIN fx_ic i ON i.node = c.ancestor
  WHERE p.node = c.ancestor GROUP BY 1, 2"""
VIEWS["fx_exclusion"] = """
  SELECT query, subject, count(*) AS n FROM (SELECT DISTINCT query FROM fx_present)
    JOIN fx_closure c ON query = c.node
    JOIN fx_line a ON a.finding = c.ancestor AND a.polarity = 'excluded'
  WHERE (a.subject, a.finding) NOT IN (SELECT (subject, finding) FROM fx_conflict)
  GROUP BY 1, 2"""
VIEWS["fx_absence"] = """
  SELECT query, subject, max(estimate) AS estimate FROM (SELECT DISTINCT query FROM fx_absent)
    JOIN fx_closure c ON query = c.ancestor
    JOIN fx_assertion a ON a.finding = c.node AND a.polarity = 'present' AND a.estimate IS NOT NULL
  WHERE (a.subject, a.finding) NOT IN (SELECT (subject, finding) FROM fx_conflict)
  GROUP BY 1, 2"""
VIEWS["fx_contribution"] = """
  SELECT case_id, subject, query, 'maximum_resnik_divided_by_present_count' AS reason,
    coalesce(s.ic, 0.0) / n_present AS value
  FROM fx_triple LEFT JOIN fx_support s USING (subject, query)
  UNION ALL
  SELECT case_id, subject, query, 'source_exclusion', -coalesce(i.ic, 0.0) / n_present
  FROM fx_present JOIN fx_exclusion USING (query) JOIN fx_candidate_pair USING (case_id, subject)
    LEFT JOIN fx_ic i ON i.node = query
  UNION ALL
  SELECT case_id, subject, query, 'explicit_absence_frequency_penalty', -coalesce(i.ic, 0.0) * estimate
  FROM fx_absent JOIN fx_absence USING (query) JOIN fx_candidate_pair USING (case_id, subject)
    LEFT JOIN fx_ic i ON i.node = query"""
VIEWS["fx_score"] = """
  SELECT case_id, subject, round(sum(value), 9) + 0.0 AS score FROM fx_contribution GROUP BY 1, 2"""
VIEWS["fx_ranked"] = """
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, subject) AS rank,
    count(*) OVER (PARTITION BY case_id) AS candidate_count
  FROM fx_score"""

# family scoring over distinct statements
VIEWS["fx_vote"] = """
  SELECT o.case_id, f.subject, f.family, f.finding,
    CASE WHEN (f.polarity = 'present') = (o.status = 'present') THEN 1.0 ELSE -1.0 END AS value
  FROM fx_obs o JOIN fx_statement_family f ON f.finding = o.finding AND f.relation = o.relation
  WHERE o.status IN ('present', 'absent')
    AND f.family IN (SELECT family FROM fx_family WHERE dependency_type <> 'unknown')
    AND f.subject IN (SELECT concept_id FROM fx_concept WHERE kind = 'condition' AND status = 'active')"""
VIEWS["fx_family_mean"] = """
  SELECT case_id, subject, family, avg(value) AS mean, count(*) AS n FROM fx_vote GROUP BY 1, 2, 3"""
VIEWS["fx_family_score"] = """
  SELECT case_id, subject, round(sum(mean * weight) / sum(weight), 9) + 0.0 AS score,
    CAST(sum(n) AS BIGINT) AS evaluated
  FROM fx_family_mean LEFT JOIN fx_weight USING (family) GROUP BY 1, 2 HAVING sum(weight) IS NOT NULL"""
VIEWS["fx_family_ranked"] = """
  SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, evaluated DESC, subject) AS rank
  FROM fx_family_score"""

VIEWS["fx_concept"] = """
  SELECT node AS concept_id, 'finding' AS kind, 'active' AS status FROM fx_node
  UNION ALL SELECT 'C:'||c_custkey, 'condition',
    CASE WHEN c_acctbal < 0 THEN 'obsolete' ELSE 'active' END FROM customer"""
VIEWS["fx_designation"] = """
  SELECT 'F:'||p_partkey AS concept_id, 'en' AS language, 'preferred' AS scope, p_name AS text FROM part
  UNION ALL SELECT 'F:'||p_partkey, 'en', 'synonym', p_brand||' '||p_name FROM part
  UNION ALL SELECT 'F:'||p_partkey, 'fr', 'preferred', lower(p_type)||' '||p_name FROM part
  UNION ALL SELECT 'F:'||p_partkey, 'fr', 'ui_alias', p_name||' '||p_partkey FROM part
  UNION ALL SELECT 'F:'||p_partkey, 'de', 'fully_specified_name', p_name||' '||p_partkey||' '||lower(p_type) FROM part
  UNION ALL SELECT 'F:'||p_partkey, 'de', 'ui_preferred', p_name||' '||lower(p_brand)||' '||p_partkey FROM part"""
VIEWS["fx_identifier"] = """
  SELECT 'F:'||p_partkey AS concept_id, 'urn:evisift:part' AS system, 'P-'||p_partkey AS code,
    'primary' AS relation FROM part
  UNION ALL SELECT 'F:'||p_partkey, 'urn:evisift:brand', p_brand||'/'||p_name, 'source_code' FROM part"""
VIEWS["fx_mapping"] = """
  SELECT 'M:'||p_partkey AS mapping_id, 'X:'||p_name||'/'||p_size AS target_code,
    'urn:evisift:crosswalk' AS target_system,
    CASE WHEN p_type = 'ECONOMY' THEN 'related' ELSE 'exact' END AS relation,
    CASE WHEN p_size <= 40 THEN 'resolved' ELSE 'unresolved' END AS resolution_status,
    CASE WHEN p_size <= 40 THEN 'F:'||p_partkey END AS target_concept_id FROM part"""
VIEWS["fx_candidate"] = """
  SELECT 'D:'||d.doc_id AS candidate_id, lang, source, n_chars,
    CASE WHEN quality IS NULL THEN 'unreviewed' WHEN quality = 1 THEN 'approved' ELSE 'rejected' END AS status,
    coalesce(toxic, 0) AS toxic
  FROM documents d LEFT JOIN labels USING (doc_id)"""
VIEWS["fx_review"] = """
  SELECT *, CASE WHEN stage = 'adjudication' AND lag(stage) OVER w = 'review'
      THEN [lag(event_hash) OVER w] ELSE CAST([] AS VARCHAR[]) END AS basis
  FROM (SELECT strftime(ts, '%Y-%m-%d')||':'||(user_id // 10) AS item, 'R:'||user_id AS reviewer,
      CASE WHEN event_type = 'error' THEN 'adjudication' ELSE 'review' END AS stage,
      CASE event_type WHEN 'view' THEN 'reject' WHEN 'signup' THEN 'defer' ELSE 'approve' END AS decision,
      CASE WHEN value < 10 THEN 'minor' ELSE 'major' END AS category,
      CASE WHEN event_type = 'purchase' THEN 'exact' END AS mapping,
      event_id AS sequence, md5(concat_ws('|', event_id, user_id, event_type)) AS event_hash FROM events)
  WINDOW w AS (PARTITION BY item ORDER BY sequence)"""
VIEWS["fx_latest"] = """
  SELECT item, reviewer, decision, category, mapping, event_hash, sequence FROM (
    SELECT *, row_number() OVER (PARTITION BY item, reviewer ORDER BY sequence DESC) AS n
    FROM fx_review WHERE stage = 'review') WHERE n = 1"""
VIEWS["fx_agreement"] = """
  SELECT item, coalesce(reviewers, 0) AS reviewers, coalesce(reviewers, 0) > 0 AS reviewed,
    coalesce(agreed, false) AS agreement,
    coalesce(reviewers, 0) >= 2 AND NOT coalesce(agreed, false) AND NOT coalesce(open, false) AS disagreement,
    coalesce(open, false) OR coalesce(final IN ('defer', 'needs_second_review'), false) AS deferred,
    final IS NOT NULL AS adjudicated,
    NOT coalesce(agreed, false) AND (final IS NULL OR final IN ('defer', 'needs_second_review')) AS unresolved
  FROM (SELECT DISTINCT item FROM fx_review) LEFT JOIN (
    SELECT item, count(*) AS reviewers, bool_or(decision = 'defer') AS open,
      count(*) >= 2 AND count(DISTINCT decision) = 1 AND count(DISTINCT category) = 1
        AND count(DISTINCT coalesce(mapping, '-')) = 1 AND NOT bool_or(decision = 'defer') AS agreed
    FROM fx_latest GROUP BY 1) USING (item) LEFT JOIN (
    SELECT a.item, arg_max(a.decision, a.sequence) AS final FROM fx_review a
    LEFT JOIN (SELECT item, list_sort(list(event_hash)) AS hashes FROM fx_latest GROUP BY 1) h ON h.item = a.item
    WHERE a.stage = 'adjudication' AND list_sort(a.basis) = coalesce(h.hashes, CAST([] AS VARCHAR[]))
    GROUP BY 1) USING (item)"""
VIEWS["fx_doc_words"] = """
  SELECT doc_id, lang, source, list_filter(string_split(trim(regexp_replace(
    strip_accents(lower(replace(text, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS words
  FROM documents"""
VIEWS["fx_bench_words"] = """
  SELECT item_id, list_filter(string_split(trim(regexp_replace(
    strip_accents(lower(replace(text, 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> '') AS words
  FROM benchmark"""
VIEWS["fx_phrase"] = """
  SELECT DISTINCT 'I:'||item_id AS concept_id, array_to_string(words[i:i+3], ' ') AS phrase
  FROM fx_bench_words, unnest(range(1, len(words) - 2)) AS t(i)"""


VIEWS["fx_scope"] = """
  SELECT l.* FROM fx_line l
  WHERE release = 'rel:P'
    AND curator IN (SELECT 'E:'||s_suppkey FROM supplier WHERE s_acctbal >= 0)
    AND subject NOT IN (SELECT 'C:'||c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')"""
VIEWS["fx_rare_scope"] = """
  SELECT l.* FROM fx_line l WHERE release = 'rel:F' OR (release = 'rel:O' AND family IN ('1-URGENT', '2-HIGH'))"""
VIEWS["fx_universe"] = """
  SELECT DISTINCT subject FROM fx_line
  WHERE subject IN (SELECT concept_id FROM fx_concept WHERE kind = 'condition' AND status = 'active')"""
VIEWS["fx_general_match"] = """
  SELECT DISTINCT o.case_id, s.subject FROM fx_obs o JOIN fx_scope s ON s.finding = o.finding
    AND s.relation = 'has_symptom' JOIN fx_universe USING (subject)
  WHERE o.status IN ('present', 'absent')"""
VIEWS["fx_variation"] = """
  SELECT case_id, finding, documented, matched, least(documented, matched - documented) AS variation,
    row_number() OVER (PARTITION BY case_id ORDER BY least(documented, matched - documented) DESC,
      documented DESC, finding) AS step
  FROM (SELECT m.case_id, s.finding, count(*) AS documented, any_value(m.matched) AS matched
    FROM (SELECT *, count(*) OVER (PARTITION BY case_id) AS matched FROM fx_general_match) m
    JOIN (SELECT DISTINCT subject, finding FROM fx_scope WHERE polarity = 'present') s USING (subject)
    GROUP BY 1, 2)
  WHERE documented < matched AND (case_id, finding) NOT IN (SELECT (case_id, finding) FROM fx_obs)"""
VIEWS["fx_statement_vote"] = """
  SELECT r.case_id, r.subject, f.family, f.finding, f.relation, f.polarity, o.status,
    CASE WHEN o.status IS NULL THEN 'finding_not_observed'
      WHEN o.relation <> f.relation THEN 'observation_relation_mismatch'
      WHEN o.status = 'unknown' THEN 'finding_unknown_or_not_assessable'
      WHEN (f.polarity = 'present') = (o.status = 'present') THEN 'explicit_polarity_match'
      ELSE 'explicit_polarity_conflict' END AS reason,
    CASE WHEN o.status IN ('present', 'absent') AND o.relation = f.relation THEN
      CASE WHEN (f.polarity = 'present') = (o.status = 'present') THEN 1.0 ELSE -1.0 END END AS value
  FROM fx_family_ranked r JOIN fx_statement_family f USING (subject)
    LEFT JOIN fx_obs o ON o.case_id = r.case_id AND o.finding = f.finding
  WHERE r.rank <= 20 AND f.family IN (SELECT family FROM fx_family WHERE dependency_type <> 'unknown')"""


def compose(sql: str) -> str:
    """Prefix ``sql`` with the views it uses, dependencies first."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+\b", text):
            if name in VIEWS and name not in ordered:
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    visit(sql)
    body = sql.strip()
    if not ordered:
        return body
    heads = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in ordered)
    if body.upper().startswith("WITH "):
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"

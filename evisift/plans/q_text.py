"""Label matching and text-context queries over documents, benchmark items and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from evisift.functions import normalize
from evisift.operators import resolve, textfilter
from evisift.plans import oracle
from evisift.plans import testbed as tb
from evisift.plans.registry import query
from evisift.session import materialize

oracle.VIEWS["fx_doc_runs"] = """
  SELECT DISTINCT doc_id, lang, array_to_string(words[i:i+3], ' ') AS phrase
  FROM fx_doc_words, unnest(range(1, greatest(len(words) - 2, 1))) AS t(i)"""
oracle.VIEWS["fx_doc_hit"] = """
  SELECT doc_id, lang, phrase, count(DISTINCT concept_id) AS concepts, min(concept_id) AS first
  FROM fx_doc_runs JOIN fx_phrase USING (phrase) GROUP BY 1, 2, 3"""
oracle.VIEWS["fx_doc_title"] = """
  SELECT doc_id, lang, trim(regexp_replace(strip_accents(lower(replace(split_part(text, chr(10), 1), 'ß', 'ss'))),
    '[^a-z0-9]+', ' ', 'g')) AS label FROM documents"""


def dictionary(spark, sf):
    return tb._memo(
        spark, sf, "phrase_index",
        lambda: resolve.phrase_index(
            tb.phrases(spark, sf).select("concept_id", F.col("phrase").alias("text"))
        ),
    )


def hits(spark, sf):
    docs = tb.table(spark, sf, "documents").select("doc_id", "text")
    return tb._memo(
        spark, sf, "doc_hits", lambda: resolve.phrase_matches(docs, dictionary(spark, sf), "doc_id")
    )


@query(
    "n3_label_normaliser",
    "SELECT doc_id, array_to_string(words, ' ') AS normalized FROM fx_doc_words",
)
def n3(spark, sf):
    return tb.table(spark, sf, "documents").select(
        "doc_id", normalize.normalize_label(F.col("text")).alias("normalized")
    )


@query(
    "d7_phrase_index",
    """SELECT phrase, 4 AS words, count(DISTINCT concept_id) AS concepts, min(concept_id) AS first
    FROM fx_phrase GROUP BY 1""",
)
def d7(spark, sf):
    return dictionary(spark, sf)


@query("d9_phrase_match", "SELECT doc_id, phrase, concepts FROM fx_doc_hit")
def d9(spark, sf):
    """Benchmark phrases in whole document texts."""
    return hits(spark, sf).select("doc_id", "phrase", "concepts")


def subject_index(spark, sf):
    """First lines of documents as subject labels: English the preferred vocabulary, others the fallback."""
    docs = tb.table(spark, sf, "documents")
    code = F.concat(F.when(F.col("lang") == "en", "A:").otherwise("B:"), "doc_id")
    concepts = docs.select(
        F.concat(F.lit("D:"), "doc_id").alias("concept_id"), F.lit("condition").alias("kind"),
        F.lit("active").alias("status"), code.alias("primary_code"),
    )
    labels = docs.select(
        F.concat(F.lit("D:"), "doc_id").alias("concept_id"), F.split("text", "\n")[0].alias("text")
    )
    return resolve.subject_label_index(labels, concepts, "A:", "B:")


@query(
    "d6_subject_label_index",
    """WITH p AS (SELECT label, 'D:'||doc_id AS id, lang = 'en' AS en, bool_or(lang = 'en') OVER (PARTITION BY label) AS any_en
      FROM fx_doc_title)
    SELECT label, count(*) AS concepts, min(id) AS first, max(id) AS last FROM p WHERE en OR NOT any_en GROUP BY 1""",
)
def d6(spark, sf):
    return subject_index(spark, sf)


@query(
    "d8_subject_mapping",
    """WITH idx AS (SELECT label, CASE WHEN count(*) FILTER (lang = 'en') > 0 THEN count(*) FILTER (lang = 'en')
        ELSE count(*) END AS n FROM fx_doc_title GROUP BY 1)
    SELECT 'D:'||doc_id AS topic_id, CASE WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status,
      CASE WHEN n = 1 THEN 'exact' ELSE 'unresolved' END AS relation
    FROM fx_doc_title JOIN idx USING (label)""",
)
def d8(spark, sf):
    """Every document title proposed against the subject labels."""
    labels = tb.table(spark, sf, "documents").select(
        F.concat(F.lit("D:"), "doc_id").alias("topic_id"), F.split("text", "\n")[0].alias("label")
    )
    return resolve.propose_mapping(labels, subject_index(spark, sf)).drop("concept_id")


def extracted(spark, sf):
    docs = tb.table(spark, sf, "documents").select(
        F.concat(F.lit("D:"), "doc_id").alias("topic_id"),
        F.when(F.col("lang") == "en", "English").otherwise(F.col("lang")).alias("language"),
        F.lit("topics:1").alias("release"),
        F.concat(F.lit("health-topic[@id='"), "doc_id", F.lit("']")).alias("locator"),
        F.split("text", "\n")[0].alias("title"),
        F.lit(0).alias("summary_index"),
        "text",
    )
    labels = docs.select("topic_id", F.col("title").alias("label"))
    proposals = resolve.propose_mapping(labels, subject_index(spark, sf))
    return tb._memo(
        spark, sf, "extracted",
        lambda: resolve.extract_candidates(docs, dictionary(spark, sf), proposals),
    )


@query(
    "d10_extracted_candidates",
    """SELECT 'D:'||doc_id AS topic_id, phrase AS object_text,
      row_number() OVER (PARTITION BY doc_id ORDER BY phrase) - 1 AS ordinal,
      'health-topic[@id='''||doc_id||''']/full-summary[1]/'||phrase AS source_locator,
      CASE WHEN concepts = 1 THEN first END AS object_concept FROM fx_doc_hit WHERE lang = 'en'""",
)
def d10(spark, sf):
    return extracted(spark, sf).select(
        "topic_id", "object_text", F.col("ordinal").cast("bigint").alias("ordinal"), "source_locator",
        F.col("object_mapping.concept_id").alias("object_concept"),
    )


@query(
    "d11_candidate_rejections",
    """WITH idx AS (SELECT label, count(*) FILTER (lang = 'en') AS n FROM fx_doc_title GROUP BY 1),
      c AS (SELECT CASE WHEN n > 1 THEN 'subject_ambiguous' WHEN concepts > 1 THEN 'object_ambiguous'
        ELSE 'eligible' END AS rejection FROM fx_doc_hit h JOIN fx_doc_title t ON t.doc_id = h.doc_id
        JOIN idx USING (label) WHERE h.lang = 'en')
    SELECT rejection, count(*) AS candidates FROM c GROUP BY 1""",
)
def d11(spark, sf):
    return extracted(spark, sf).groupBy(F.coalesce("rejection", F.lit("eligible")).alias("rejection")).agg(
        F.count("*").alias("candidates")
    )


@query(
    "x2_locator_parts",
    "SELECT CAST(doc_id AS VARCHAR) AS topic_id, 0 AS summary_index, phrase, true AS consistent FROM fx_doc_hit WHERE lang = 'en'",
)
def x2(spark, sf):
    return extracted(spark, sf).select(
        textfilter.parse_locator(F.col("source_locator"), F.col("object_text")).alias("p")
    ).select("p.*")


# --- page blocks ---------------------------------------------------------------------------


def blocks(spark, sf):
    return tb._memo(
        spark, sf, "blocks",
        lambda: textfilter.visible_blocks(tb.table(spark, sf, "pages").select("page_id", "html"), ["page_id"]),
    )


def page_dictionary(spark, sf):
    """Distinct words of the benchmark texts, and their two-word runs, as finding phrases."""
    words = normalize.tokens(normalize.normalize_label(F.col("text")))
    runs = F.concat(words, normalize.word_ngrams(words, 2))
    terms = tb.table(spark, sf, "benchmark").select(
        F.concat(F.lit("I:"), "item_id").alias("concept_id"), F.explode(F.array_distinct(runs)).alias("text")
    )
    return tb._memo(spark, sf, "page_dictionary", lambda: resolve.phrase_index(terms))


def flagged(spark, sf):
    def build():
        rows = materialize(textfilter.sentences(blocks(spark, sf), ["page_id"]), "sentences")
        return textfilter.context_flags(
            textfilter.occurrences(rows, ["page_id"], page_dictionary(spark, sf))
        )

    return tb._memo(spark, sf, "flagged", build)


def page_candidates(spark, sf):
    """Dictionary phrases anywhere in the visible or hidden page text, with the page heading as title."""
    text = F.regexp_replace("html", "<[^>]*>", " ")
    pages = tb.table(spark, sf, "pages").select(
        "page_id", text.alias("text"), F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1).alias("title")
    )
    found = resolve.phrase_matches(pages.select("page_id", "text"), page_dictionary(spark, sf), "page_id")
    conditions = pages.select(normalize.normalize_label(F.col("title")).alias("phrase"))
    return textfilter.term_flags(
        found.select("page_id", "phrase").join(pages.select("page_id", "title"), "page_id"), conditions
    )


def new_decisions(spark, sf):
    candidates = page_candidates(spark, sf)
    nested = textfilter.nested_phrases(candidates, ["page_id"])
    return textfilter.classify(candidates, flagged(spark, sf), nested, ["page_id"])


def decisions(spark, sf):
    return tb._memo(spark, sf, "decisions", lambda: new_decisions(spark, sf))


# Pages are flat: a block's text runs from its tag to the next tag of a block, list or section.
# As an HTML parser reads them, these references need no semicolon (titles end within one).
def _plain(text):
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("amp", "&")):
        text = f"regexp_replace({text}, '&{name};?', '{char}', 'g')"
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


oracle.VIEWS["fx_block"] = rf"""
  SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS ordinal, tag,
    CASE WHEN heading_at < i THEN heading ELSE '' END AS section,
    coalesce(last_value(CASE WHEN tag = 'p' THEN block END IGNORE NULLS) OVER (
      PARTITION BY page_id, heading_at < i ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lead_in, block
  FROM (SELECT page_id, i, tag, {_plain("regexp_replace(body, '<[^>]*>', '', 'g')")} AS block FROM fx_segment WHERE tag IN ('p', 'li'))
    JOIN (SELECT page_id, max(i) AS heading_at, max({_plain("body")}) AS heading FROM fx_segment WHERE tag = 'h1' GROUP BY 1) USING (page_id)"""
oracle.VIEWS["fx_segment"] = r"""
  SELECT page_id, i, split_part(piece, chr(2), 1) AS tag, substring(piece, strpos(piece, chr(2)) + 1) AS body
  FROM (SELECT page_id, i, pieces[i] AS piece FROM (SELECT *, unnest(range(2, len(pieces) + 1)) AS i FROM (
    SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
        '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'),
      '<(/?(?:p|li|ul|div|article|footer|nav|h1|body|html))(?:\s[^>]*)?>', chr(1)||'\1'||chr(2), 'g'), chr(1)) AS pieces FROM pages)))"""


@query("x1_visible_blocks", "SELECT page_id, ordinal, tag, section, lead_in, block FROM fx_block")
def x1(spark, sf):
    return blocks(spark, sf)


@query("x3_context_flags")
def x3(spark, sf):
    """Context cues of every phrase occurrence, counted per cue."""
    return flagged(spark, sf).select(F.explode("flags").alias("flag")).groupBy("flag").agg(
        F.count("*").alias("occurrences")
    )


@query(
    "x3_document_cues",
    """WITH s AS (SELECT doc_id, array_to_string(words, ' ') AS t FROM fx_doc_words)
    SELECT doc_id, regexp_matches(t, '\\b(?:no|nor|not|never|without|doesn t|don t|can t|cannot|absence of)\\b') AS negation,
      regexp_matches(t, '\\b(?:risk|more likely to|chance of)\\b') AS risk,
      regexp_matches(t, '\\b(?:treat\\w*|therap\\w*|surgery|medicine|medication)\\b') AS treatment FROM s""",
)
def x3_documents(spark, sf):
    """Cue patterns over whole document texts."""
    rows = tb.table(spark, sf, "documents").select(
        "doc_id", normalize.normalize_label(F.col("text")).alias("t")
    )
    return rows.select(
        "doc_id",
        F.col("t").rlike(textfilter.CUES["negation"]).alias("negation"),
        F.col("t").rlike(textfilter.CUES["risk"]).alias("risk"),
        F.col("t").rlike(textfilter.CUES["treatment"]).alias("treatment"),
    )


@query("x4_near_negation")
def x4(spark, sf):
    """Occurrences with a negation cue just before them, per phrase."""
    return flagged(spark, sf).groupBy("phrase").agg(
        F.count("*").alias("occurrences"),
        F.count_if(F.array_contains("flags", "negation_context")).alias("negated"),
    )


oracle.VIEWS["fx_page_words"] = """
  SELECT page_id, string_split(trim(regexp_replace(strip_accents(lower(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g')), ' ') AS words,
    trim(regexp_replace(strip_accents(lower(replace(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), 'ß', 'ss'))), '[^a-z0-9]+', ' ', 'g')) AS title FROM pages"""
oracle.VIEWS["fx_page_phrase"] = """
  SELECT DISTINCT unnest(words) AS phrase FROM fx_bench_words
  UNION SELECT array_to_string(words[i:i+1], ' ') FROM fx_bench_words, unnest(range(1, len(words))) AS t(i)"""
oracle.VIEWS["fx_page_candidate"] = """
  SELECT DISTINCT page_id, title, phrase FROM (
    SELECT page_id, title, unnest(words) AS phrase FROM fx_page_words
    UNION ALL SELECT page_id, title, array_to_string(words[i:i+1], ' ') FROM fx_page_words, unnest(range(1, len(words))) AS t(i))
  WHERE phrase IN (SELECT phrase FROM fx_page_phrase)"""


# Words of the flags.
@query(
    "x5_term_flags",
    """WITH c AS (SELECT *, string_split(title, ' ') AS tw, string_split(phrase, ' ') AS pw,
        phrase IN ('cancer', 'infection', 'disease', 'disorder', 'syndrome', 'tumor', 'tumour') AS noun FROM fx_page_candidate),
      s AS (SELECT *, phrase = title OR (list_contains(tw, phrase) AND (noun OR length(phrase) > 5)) OR (list_contains(pw, title) AND length(title) > 5) AS own FROM c),
      f AS (
        SELECT CASE WHEN phrase IN ('acute', 'chronic', 'recurrent', 'episodic', 'intermittent', 'persistent', 'progressive') THEN 'temporal_modifier' END AS flag FROM s
        UNION ALL SELECT CASE WHEN phrase IN ('right', 'left', 'bilateral', 'unilateral') THEN 'laterality_modifier' END FROM s
        UNION ALL SELECT CASE WHEN phrase IN ('severe', 'mild', 'healthy', 'normal', 'abnormal', 'frequent') THEN 'generic_descriptor' END FROM s
        UNION ALL SELECT CASE WHEN own THEN 'disease_self_reference' END FROM s
        UNION ALL SELECT CASE WHEN noun AND NOT own THEN 'other_disease_mention' END FROM s
        UNION ALL SELECT CASE WHEN phrase IN (SELECT title FROM fx_page_words) THEN 'condition_term_as_finding' END FROM s)
    SELECT flag, count(*) AS candidates FROM f WHERE flag IS NOT NULL GROUP BY 1""",
)
def x5(spark, sf):
    return page_candidates(spark, sf).select(F.explode("term_flags").alias("flag")).groupBy("flag").agg(
        F.count("*").alias("candidates")
    )


@query(
    "x6_nested_phrases",
    """WITH one AS (SELECT DISTINCT item_id, unnest(words) AS phrase FROM fx_bench_words),
      two AS (SELECT DISTINCT item_id, array_to_string(words[i:i+1], ' ') AS phrase
        FROM fx_bench_words, unnest(range(1, len(words))) AS t(i))
    SELECT DISTINCT o.item_id, o.phrase FROM one o JOIN two t ON t.item_id = o.item_id
      AND contains(' '||t.phrase||' ', ' '||o.phrase||' ')""",
)
def x6(spark, sf):
    """Words of a benchmark item nested in one of its two-word runs."""
    words = normalize.tokens(normalize.normalize_label(F.col("text")))
    rows = tb.table(spark, sf, "benchmark").select(
        "item_id", F.explode(F.array_distinct(F.concat(words, normalize.word_ngrams(words, 2)))).alias("phrase")
    )
    return textfilter.nested_phrases(rows, ["item_id"])


@query("x7_decisions")
def x7(spark, sf):
    return new_decisions(spark, sf).withColumn("signals", F.array_join("signals", ","))


@query("x8_coverage_change")
def x8(spark, sf):
    return textfilter.coverage_change(decisions(spark, sf), ["page_id"])


@query("x8_rule_histogram")
def x8_rules(spark, sf):
    return decisions(spark, sf).groupBy("status", "rule").agg(
        F.count("*").alias("candidates"), F.count_distinct("page_id").alias("pages")
    )


@query("x9_signal_report")
def x9(spark, sf):
    rows = decisions(spark, sf).withColumn("key", F.concat_ws("|", F.col("page_id").cast("string"), "phrase"))
    return textfilter.signal_report(rows, "key").withColumn("examples", F.array_join("examples", ";"))

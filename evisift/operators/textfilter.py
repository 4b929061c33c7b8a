"""Context filter for phrases found in topic HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evisift.functions import normalize
from evisift.operators.resolve import word_run_matches

# Term lists of the filter.
TEMPORAL = ["acute", "chronic", "recurrent", "episodic", "intermittent", "persistent", "progressive"]
LATERALITY = ["right", "left", "bilateral", "unilateral"]
GENERIC = ["severe", "mild", "healthy", "normal", "abnormal", "frequent"]
DISEASE_NOUNS = ["cancer", "infection", "disease", "disorder", "syndrome", "tumor", "tumour"]

# Cue patterns over normalised text.
CUES = {
    "negation": r"\b(?:no|nor|not|never|without|doesn t|don t|can t|cannot|absence of)\b",
    "family_history": r"\b(?:family history|familial history|hereditary risk)\b",
    "differential": (
        r"\b(?:confused with|mistaken for|different from|other conditions?|other diseases?|"
        r"differential diagnosis)\b"
    ),
    "procedure": r"\b(?:screen\w*|test\w*|diagnos\w*|scan\w*|imaging)\b",
    "treatment": r"\b(?:treat\w*|therap\w*|surgery|medicine|medication)\b",
    "risk": r"\b(?:risk|more likely to|chance of)\b",
    "example_or_subtype": r"\b(?:such as|for example|examples? include|type of|form of)\b",
    "manifestation": (
        r"\b(?:symptoms?|signs?|lead to|leads to|can cause|may cause|causes|characterized by|"
        r"experience|experiences|develop|develops|may have|can have|often have|often has|"
        r"results? in|sets? in)\b"
    ),
    "manifestation_heading": r"\b(?:symptoms?|signs?|manifestations?)\b",
    "classification": r"\b(?:types?|forms?|kinds?|subtypes?|categories)\b",
}
# Section words, first match wins.
SECTION_WORDS = (
    ("procedure_section", ("diagnos", "screen", "test")),
    ("treatment_section", ("treat", "manag", "medicin", "therap")),
    ("prevention_section", ("prevent",)),
    ("risk_or_cause_section", ("risk", "caus")),
)
# Order in which rules decide.
REJECT_RULES = ("temporal_modifier", "laterality_modifier", "generic_descriptor", "disease_self_reference")
BLOCKED_CONTEXT = (
    "negation_context", "family_history_context", "differential_context", "procedure_section",
    "treatment_section", "prevention_section", "risk_or_cause_section", "classification_section",
    "procedure_sentence", "treatment_sentence", "risk_sentence",
)
LEAD_IN_CUES = ("notice", "affect many organs", "may have")
LIST_STOP_SECTIONS = ("risk", "treat", "prevent", "caus")

_BLOCK_SCHEMA = "ordinal int, tag string, section string, lead_in string, block string"


class _Blocks(HTMLParser):
    """Visible paragraph and list-item texts of one page, outermost elements only."""

    HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
    # elements whose start ends an open paragraph
    CLOSE_P = HEADINGS | {"p", "ul", "ol", "div", "table", "article", "section", "footer", "nav", "li"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, str, str]] = []
        self.section, self.lead_in = "", ""
        self.open: str | None = None
        self.depth = 0
        self.text: list[str] = []
        self.heading: list[str] | None = None

    def _finish(self) -> None:
        block = " ".join("".join(self.text).split())
        self.blocks.append((self.open, self.section, self.lead_in, block))
        if self.open == "p":
            self.lead_in = block
        self.open, self.depth, self.text = None, 0, []

    def handle_starttag(self, tag, attrs):
        if self.open == "p" and tag in self.CLOSE_P:
            self._finish()
        if self.open == tag == "li" and self.depth == 1:
            self._finish()
        if self.open == "li" and tag in ("ul", "ol"):
            self.depth += 1
        if tag in self.HEADINGS:
            self.heading = []
        elif tag in ("p", "li") and self.open is None:
            self.open, self.depth, self.text = tag, 1, []

    def handle_endtag(self, tag):
        if tag in self.HEADINGS and self.heading is not None:
            self.section = " ".join("".join(self.heading).split())
            self.lead_in, self.heading = "", None
        elif self.open == "li" and tag in ("ul", "ol"):
            self.depth -= 1
            if self.depth <= 0:
                self._finish()
        elif tag == self.open and (tag == "p" or self.depth == 1):
            self._finish()
        elif self.open == "p" and tag in ("div", "article", "section", "body"):
            self._finish()

    def handle_data(self, data):
        if self.heading is not None:
            self.heading.append(data)
        if self.open is not None:
            self.text.append(data)

    def close(self):
        super().close()
        if self.open is not None:
            self._finish()


def parse_blocks(html: str) -> list[tuple[str, str, str, str]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    return parser.blocks


def visible_blocks(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Blocks of every page with their section heading and the paragraph before them."""
    fields = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + ", " + _BLOCK_SCHEMA

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (*[getattr(r, k) for k in keys], i, *block)
                for r in batch.itertuples(index=False)
                for i, block in enumerate(parse_blocks(getattr(r, html)))
            ]
            yield pd.DataFrame(rows, columns=[*keys, "ordinal", "tag", "section", "lead_in", "block"])

    return pages.select(*keys, html).mapInPandas(run, schema)


def _has_any(text: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def sentences(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Sentences with the section that counts for them.

    A list item after a paragraph announcing symptoms belongs to a symptom list, unless its
    section speaks of risk, treatment, prevention or causes, or the lead-in lists types.
    """
    lead = normalize.normalize_label(F.col("lead_in"))
    section = normalize.normalize_label(F.col("section"))
    announces = lead.rlike(CUES["manifestation_heading"]) | (
        F.rtrim("lead_in").endswith(":") & _has_any(lead, LEAD_IN_CUES)
    )
    symptom_list = (
        (F.col("tag") == "li") & announces & ~_has_any(section, LIST_STOP_SECTIONS)
        & ~lead.rlike(CUES["classification"])
    )
    effective = F.when(
        symptom_list, F.concat(F.lit("Symptoms list: "), F.col("lead_in"))
    ).otherwise(F.col("section"))
    split = F.split("block", r"(?<=[.!?;])\s+")
    context = F.when(F.col("tag") == "li", F.col("block")).otherwise(F.btrim("sentence"))
    rows = blocks.select(
        *keys, "ordinal", "tag", "block", effective.alias("section"),
        F.posexplode(split).alias("sentence_no", "sentence"),
    ).select(
        *keys, "ordinal", "sentence_no", "section", context.alias("context"),
        normalize.normalize_label(F.col("sentence")).alias("sentence_text"),
        normalize.normalize_label(context).alias("context_text"),
        normalize.normalize_label(F.col("section")).alias("section_text"),
    )
    return _sentence_cues(rows)


def _sentence_cues(rows: DataFrame) -> DataFrame:
    """Cues that depend on the sentence alone, found once per sentence rather than per phrase."""
    text, section = F.col("context_text"), F.col("section_text")
    in_section = F.when(section.rlike(CUES["classification"]), "classification_section")
    for name, words in SECTION_WORDS:
        in_section = in_section.when(_has_any(section, words), name)
    in_section = in_section.when(section.rlike(CUES["manifestation_heading"]), "manifestation_section")
    cues = F.array_compact(
        F.array(
            F.when(
                text.rlike(CUES["family_history"]) | F.contains(section, F.lit("family history")),
                "family_history_context",
            ),
            F.when(
                text.rlike(CUES["differential"]) | F.contains(section, F.lit("differential")),
                "differential_context",
            ),
            in_section,
            F.when(text.rlike(CUES["procedure"]), "procedure_sentence"),
            F.when(text.rlike(CUES["treatment"]), "treatment_sentence"),
            F.when(text.rlike(CUES["risk"]), "risk_sentence"),
            F.when(text.rlike(CUES["manifestation"]), "manifestation_sentence"),
        )
    )
    return rows.withColumn("cues", cues).withColumn(
        "example", text.rlike(CUES["example_or_subtype"])
    ).withColumn("has_negation", text.rlike(CUES["negation"])).drop("section_text")


def occurrences(sentence_rows: DataFrame, keys: list[str], index: DataFrame) -> DataFrame:
    """Whole-term occurrences of dictionary phrases, keyed by sentence."""
    rows = sentence_rows.withColumn("_k", F.struct(*keys, "ordinal", "sentence_no"))
    hits = word_run_matches(
        rows.select("_k", normalize.tokens(F.col("sentence_text")).alias("words")), index, "_k"
    ).select("_k", "phrase")
    return hits.join(rows, "_k").select(
        *keys, "phrase", "ordinal", "sentence_no", "section", "context", "context_text", "cues", "example",
        "has_negation",
    )


def near_negation(text: Column, phrase: Column) -> Column:
    """A negation cue within the four words before some occurrence of the phrase.

    Words up to and including the first "or" of that window do not count.
    """
    words, needle = F.split(text, " "), F.split(phrase, " ")

    def before(i: Column) -> Column:
        window = F.slice(words, F.greatest(F.lit(1), i - 4), i - F.greatest(F.lit(1), i - 4))
        at = F.array_position(window, "or")
        kept = F.when(at > 0, F.slice(window, at + 1, F.size(window))).otherwise(window)
        return F.array_join(kept, " ").rlike(CUES["negation"])

    last = F.size(words) - F.size(needle) + 1
    return F.when(
        last >= 1,
        F.exists(
            F.sequence(F.lit(1), last),
            lambda i: (F.slice(words, i, F.size(needle)) == needle) & before(i),
        ),
    ).otherwise(F.lit(False))


def context_flags(rows: DataFrame) -> DataFrame:
    """Add ``flags``: all context cues of each occurrence; only negation depends on the phrase."""
    negated = F.when(F.col("has_negation"), near_negation(F.col("context_text"), F.col("phrase")))
    flags = F.concat(F.array_compact(F.array(F.when(negated, "negation_context"))), "cues")
    return rows.withColumn("flags", flags).drop("cues", "context_text", "has_negation")


def term_flags(candidates: DataFrame, condition_terms: DataFrame) -> DataFrame:
    """Add ``term_flags`` from phrase and title (columns ``phrase, title``).

    ``condition_terms(phrase)`` are normalised labels of active conditions.
    """
    phrase, title = F.col("phrase"), F.col("_title")
    known = condition_terms.select("phrase").distinct().withColumn("_condition", F.lit(True))
    rows = candidates.withColumn("_title", normalize.normalize_label(F.col("title"))).join(
        known, "phrase", "left"
    )
    title_words, phrase_words = F.split(title, " "), F.split(phrase, " ")
    noun = phrase.isin(*DISEASE_NOUNS)
    self_reference = (
        (phrase == title)
        | (noun & F.array_contains(title_words, phrase))
        | (F.array_contains(title_words, phrase) & (F.length(phrase) >= 6))
        | (F.array_contains(phrase_words, title) & (F.length(title) >= 6))
    )
    flags = F.array_compact(
        F.array(
            F.when(phrase.isin(*TEMPORAL), "temporal_modifier"),
            F.when(phrase.isin(*LATERALITY), "laterality_modifier"),
            F.when(phrase.isin(*GENERIC), "generic_descriptor"),
            F.when(self_reference, "disease_self_reference"),
            F.when(noun & ~self_reference, "other_disease_mention"),
            F.when(F.col("_condition"), "condition_term_as_finding"),
        )
    )
    return rows.withColumn("term_flags", flags).drop("_title", "_condition")


def nested_phrases(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Phrases contained in another matched phrase of the same summary.

    Longer phrases emit their own word runs as join keys, so phrases of a summary are never
    paired with each other.
    """
    rows = matches.select(*keys, "phrase").distinct()
    words = F.split("phrase", " ")
    shorter = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - 1))
    runs = F.filter(F.flatten(F.transform(shorter, lambda n: normalize.word_ngrams(words, n))), lambda run: run != F.col("phrase"))
    inner = (
        rows.filter(F.size(words) > 1)
        .select(*keys, F.col("phrase").alias("outer"), F.explode(F.array_distinct(runs)).alias("phrase"))
        .filter(F.col("phrase") != F.col("outer"))
    )
    return rows.join(inner, [*keys, "phrase"], "left_semi")


def parse_locator(locator: Column, object_text: Column) -> Column:
    """Struct (topic_id, summary_index, phrase, consistent) of a candidate locator."""
    pattern = r"^health-topic\[@id='([^']+)'\]/full-summary\[(\d+)\]/(.+)$"
    phrase = F.regexp_extract(locator, pattern, 3)
    same = normalize.normalize_label(phrase) == normalize.normalize_label(object_text)
    return F.struct(
        F.regexp_extract(locator, pattern, 1).alias("topic_id"),
        (F.regexp_extract(locator, pattern, 2).try_cast("int") - 1).alias("summary_index"),
        phrase.alias("phrase"),
        (locator.rlike(pattern) & same).alias("consistent"),
    )


def classify(candidates: DataFrame, flagged: DataFrame, nested: DataFrame, keys: list[str]) -> DataFrame:
    """Keep, review or reject each candidate.

    ``candidates(keys, phrase, term_flags)``, ``flagged`` occurrences with ``flags, example``,
    ``nested(keys, phrase)``. The context reported is that of the occurrence that decided.
    """
    key = [*keys, "phrase"]
    order = F.struct("ordinal", "sentence_no")
    where = F.struct("section", "context")
    terms = candidates.select(*key, "term_flags")
    rows = flagged.join(terms.select(*key, F.array_contains("term_flags", "condition_term_as_finding").alias("_cond")), key)
    example = F.col("_cond") & F.col("example")
    blocked = F.arrays_overlap("flags", F.array(*[F.lit(b) for b in BLOCKED_CONTEXT]))
    shows = F.array_contains("flags", "manifestation_section") | F.array_contains("flags", "manifestation_sentence")
    rules = ("condition_example_or_subtype", "other_disease_mention", *BLOCKED_CONTEXT)

    def trigger(rule: str) -> Column:
        if rule == "condition_example_or_subtype":
            # its own rule holds for every occurrence that gives an example
            return F.col("example")
        return F.array_contains("flags", rule)

    per = rows.groupBy(*key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("flags")))).alias("context_flags"),
        F.max(example.cast("int")).alias("has_example"),
        F.min_by(where, order).alias("first"),
        F.min(F.when(~blocked & shows, F.struct(order.alias("o"), where.alias("w")))).alias("keep_at"),
        *[
            F.min(F.when(trigger(rule), F.struct(order.alias("o"), where.alias("w")))).alias(f"at_{rule}")
            for rule in rules
        ],
    )
    inner = nested.select(*key).distinct().withColumn("nested", F.lit(True))
    joined = terms.join(per, key, "left").join(inner, key, "left")
    visible = F.col("first").isNotNull()
    all_flags = F.array_sort(
        F.array_distinct(
            F.array_compact(
                F.concat(
                    "term_flags",
                    F.coalesce("context_flags", F.array().cast("array<string>")),
                    F.array(
                        F.when(F.col("has_example") == 1, "condition_example_or_subtype"),
                        F.when(~visible, "not_in_visible_text"),
                        F.when(F.col("nested"), "overlapping_term"),
                    ),
                )
            )
        )
    )
    joined = joined.withColumn("signals", all_flags)

    def has(rule: str) -> Column:
        return F.array_contains("signals", rule)

    rule = F.when(F.lit(False), "")
    for name in REJECT_RULES:
        rule = rule.when(has(name), name)
    rule = rule.when(~visible, "not_in_visible_text")
    rule = rule.when(
        ~has("other_disease_mention") & ~has("condition_example_or_subtype") & F.col("keep_at").isNotNull(),
        "explicit_manifestation_context",
    )
    for name in rules:
        rule = rule.when(has(name), name)
    rule = rule.otherwise("descriptive_without_manifestation")
    at = F.when(F.col("rule") == "explicit_manifestation_context", F.col("keep_at.w"))
    for name in rules:
        at = at.when(F.col("rule") == name, F.coalesce(F.col(f"at_{name}.w"), F.col("first")))
    at = at.otherwise(F.col("first"))
    return (
        joined.withColumn("rule", rule)
        .withColumn("_at", at)
        .select(
            *key,
            F.when(F.col("rule").isin(*REJECT_RULES), "reject_from_auto_extraction")
            .when(F.col("rule") == "explicit_manifestation_context", "auto_keep")
            .otherwise("needs_human_review")
            .alias("status"),
            "rule",
            F.coalesce("_at.section", F.lit("")).alias("section"),
            F.coalesce("_at.context", F.lit("")).alias("context"),
            "signals",
        )
    )


def signal_report(decisions: DataFrame, key: str, examples: int = 5) -> DataFrame:
    """Candidates per signal with the first few as examples."""
    rows = decisions.select(key, F.explode("signals").alias("signal"))
    order = W.partitionBy("signal").orderBy(key)
    sample = (
        rows.withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= examples)
        .groupBy("signal")
        .agg(F.array_sort(F.collect_list(key)).alias("examples"))
    )
    return rows.groupBy("signal").agg(F.count("*").alias("candidates")).join(sample, "signal")


def coverage_change(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Per source topic how many candidates each status leaves."""
    return decisions.groupBy(*keys).agg(
        F.count("*").alias("before"),
        F.count_if(F.col("status") == "auto_keep").alias("kept"),
        F.count_if(F.col("status") == "needs_human_review").alias("review"),
        F.count_if(F.col("status") == "reject_from_auto_extraction").alias("rejected"),
    )



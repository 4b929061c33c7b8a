"""Concept search: term corpus, BM25 index and tiered retrieval for many queries at once.

  terms(concept_id, language, scope, text, normalized)
  queries(query_id, language, text)
  catalogue(concept_id, label, code)
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evisift.functions import normalize
from evisift.session import materialize

K1 = 1.2
B = 0.75
RESULT_LIMIT = 20
PREFERRED_SCOPES = ("preferred", "ui_preferred")
ALIAS_SCOPES = ("ui_alias", "ui_preferred")
FUZZY_MIN_LENGTH = 5
# Documents of a posting block.
BLOCK_DOCS = 1 << 16
# Longest run of characters that words are keyed by.
KEY_RUN = 16


def search_terms(designations: DataFrame, aliases: DataFrame | None, codes: DataFrame) -> DataFrame:
    """Designations, lexicon aliases and codes (as English text), normalised."""
    cols = ["concept_id", "language", "scope", "text"]
    rows = designations.select(*cols)
    if aliases is not None:
        rows = rows.unionByName(aliases.select(*cols))
    coded = codes.select(
        "concept_id", F.lit("en").alias("language"), F.lit("identifier").alias("scope"),
        F.col("code").alias("text"),
    )
    return rows.unionByName(coded).withColumn("normalized", normalize.normalize_search(F.col("text")))


def bm25_documents(terms: DataFrame) -> DataFrame:
    """One document per term; its length counts every token, its postings only two characters up."""
    return terms.filter(F.col("normalized") != "").select(
        "concept_id", "language", "scope", "normalized",
        F.greatest(F.lit(1), F.size(F.split("normalized", " "))).alias("doc_length"),
        F.filter(F.split("normalized", " "), lambda t: F.length(t) >= 2).alias("tokens"),
    )


def token_stats(documents: DataFrame) -> DataFrame:
    return (
        documents.select("language", F.explode(F.array_distinct("tokens")).alias("token"))
        .groupBy("language", "token")
        .agg(F.count("*").alias("df"))
    )


def language_stats(documents: DataFrame) -> DataFrame:
    return documents.groupBy("language").agg(
        F.count("*").alias("n"), F.avg("doc_length").alias("avgdl")
    )


class TermIndex(NamedTuple):
    """Written tables of a term corpus.

    documents(doc, concept_id, language, scope, normalized), postings(language, token, block, doc, concept_id, impact),
    blocks(language, token, block, n) and languages(language, n, avgdl). ``impact`` is what a token adds to a score
    before its rarity is multiplied in. A block is a fixed share of the documents, about ``block_docs`` of them, so the list
    of a frequent token is many join keys.
    """

    documents: DataFrame
    postings: DataFrame
    blocks: DataFrame
    languages: DataFrame


def term_index(terms: DataFrame, block_docs: int = BLOCK_DOCS) -> TermIndex:
    numbered = bm25_documents(terms).withColumn("doc", F.monotonically_increasing_id())
    numbered = materialize(numbered, "term-documents")  # numbers must not change when a task runs again
    languages = materialize(language_stats(numbered), "term-languages")
    shares = languages.agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / block_docs)).alias("shares")).scalar()
    norm = (K1 + 1) / (1 + K1 * ((1 - B) + B * F.col("doc_length") / F.col("avgdl")))
    postings = (
        numbered.join(languages.select("language", "avgdl"), "language")
        .select(
            "language", "doc", "concept_id", "tokens", norm.alias("norm"),
            F.coalesce(F.pmod(F.xxhash64("doc"), shares), F.lit(0)).alias("block"), F.explode(F.array_distinct("tokens")).alias("token"),
        )
        .select(
            "language", "token", "block", "doc", "concept_id",
            ((F.size("tokens") - F.size(F.array_remove("tokens", F.col("token")))) * F.col("norm")).alias("impact"),
        )
    )
    postings = materialize(postings, "term-postings")
    blocks = materialize(postings.groupBy("language", "token", "block").agg(F.count("*").alias("n")), "term-blocks")
    return TermIndex(numbered.drop("tokens", "doc_length"), postings, blocks, languages)


def prepare_queries(queries: DataFrame) -> DataFrame:
    """Normalised text and distinct meaningful tokens; empty and negated queries drop out."""
    return (
        queries.withColumn("q", normalize.normalize_search(F.col("text")))
        .withColumn("q_tokens", F.array_distinct(normalize.query_tokens(F.col("q"))))
        .filter((F.length("q") >= 2) & (F.size("q_tokens") > 0))
    )


def _weighted(prepared: DataFrame, index: TermIndex) -> DataFrame:
    """Queries whose tokens all occur in their language, with ``asked``: (df, token, idf), rarest first."""
    stats = index.blocks.groupBy("language", "token").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return (
        prepared.select("query_id", "language", "q", F.size("q_tokens").alias("wanted"), F.explode("q_tokens").alias("token"))
        .join(stats, ["language", "token"])
        .join(index.languages.select("language", "n"), "language")
        .groupBy("query_id", "language", "q", "wanted")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token", idf.alias("idf")))).alias("asked"))
        .filter(F.size("asked") == F.col("wanted"))
        .drop("wanted")
    )


def _scores(weighted: DataFrame, index: TermIndex) -> DataFrame:
    """(query_id, q, doc, concept_id, bm25) of the documents that hold every token of a query.

    The rarest token of a query is joined block by block; each further one is looked up by token and document, so
    no posting list but the shortest is read for a query, and none is one join key.
    """
    rarest = F.col("asked")[0]
    first = weighted.select(
        "query_id", "q", "language", rarest["token"].alias("token"), rarest["idf"].alias("idf"),
        F.slice("asked", 2, F.size("asked")).alias("others"),
    ).join(index.blocks.drop("n"), ["language", "token"])
    found = first.join(index.postings, ["language", "token", "block"]).select(
        "query_id", "q", "language", "block", "doc", "concept_id", "others", (F.col("idf") * F.col("impact")).alias("weight")
    )
    alone = found.filter(F.size("others") == 0).select("query_id", "q", "doc", "concept_id", F.col("weight").alias("bm25"))
    more = found.filter(F.size("others") > 0).select(
        "query_id", "q", "language", "block", "doc", "concept_id", "weight", F.size("others").alias("wanted"), F.explode("others").alias("o")
    ).select("*", F.col("o.token").alias("token"), F.col("o.idf").alias("idf")).drop("o")
    all_held = (
        more.join(index.postings.drop("concept_id"), ["language", "token", "block", "doc"])
        .groupBy("query_id", "q", "doc", "concept_id", "weight", "wanted")
        .agg(F.count("*").alias("held"), F.sum(F.col("idf") * F.col("impact")).alias("rest"))
        .filter(F.col("held") == F.col("wanted"))
        .select("query_id", "q", "doc", "concept_id", (F.col("weight") + F.col("rest")).alias("bm25"))
    )
    return alone.unionByName(all_held)


def lexical(prepared: DataFrame, index: TermIndex) -> DataFrame:
    """Documents holding every query token, with their BM25 score; texts join the matches only."""
    return _scores(_weighted(prepared, index), index).drop("concept_id").join(
        index.documents.select("doc", "concept_id", "scope", "normalized"), "doc"
    ).drop("doc")


def token_heads(index: TermIndex, catalogue: DataFrame, limit: int = RESULT_LIMIT) -> DataFrame:
    """The first ``limit`` concepts of every token: by best impact, then in catalogue order.

    A window with a literal bound keeps ``limit`` rows a token in each task before rows move.
    """
    order = W.partitionBy("language", "token").orderBy(F.round("impact", 11).desc(), F.lower("label"), "code", "concept_id")
    return (
        _concept_impacts(index).join(catalogue.select("concept_id", "label", "code"), "concept_id")
        .withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= limit)
        .select("language", "token", "concept_id", "impact")
    )


def _concept_impacts(index: TermIndex) -> DataFrame:
    return index.postings.groupBy("language", "token", "concept_id").agg(F.max("impact").alias("impact"))


def _ranked_lexical(prepared: DataFrame, better: DataFrame, index: TermIndex, catalogue: DataFrame, limit: int) -> DataFrame:
    """(query_id, concept_id, bm25) of every lexical match that can be among a query's first ``limit``, and of ``better``.

    ``better(query_id, concept_id)`` match in an earlier tier. A query of one token reads the head of that token: the
    concepts before a head's end fill the result, whatever follows it, even where some of them are in ``better``. The scores
    of ``better`` are looked up by token and concept. Several tokens are intersected.
    """
    weighted = _weighted(prepared, index)
    several = _scores(weighted.filter(F.size("asked") > 1), index).select("query_id", "concept_id", "bm25")
    only = F.col("asked")[0]
    single = weighted.filter(F.size("asked") == 1).select(
        "query_id", "language", only["token"].alias("token"), only["idf"].alias("idf")
    )
    score = (F.col("idf") * F.col("impact")).alias("bm25")
    heads = single.join(token_heads(index, catalogue, limit), ["language", "token"]).select("query_id", "concept_id", score)
    known = single.join(better.select("query_id", "concept_id").distinct(), "query_id").join(
        _concept_impacts(index), ["language", "token", "concept_id"]
    ).select("query_id", "concept_id", score)
    return several.unionByName(heads).unionByName(known)


def _same_text(prepared: DataFrame, terms: DataFrame) -> DataFrame:
    """Concepts with a term equal to the query: tier 0 where the term is a preferred one, else 1."""
    preferred = F.col("scope").isin(*PREFERRED_SCOPES)
    rows = terms.select("concept_id", "language", F.col("normalized").alias("q"), F.when(preferred, 0).otherwise(1).alias("tier"))
    return prepared.select("query_id", "language", "q").join(rows, ["language", "q"]).select("query_id", "concept_id", "tier")


def _prefix_matches(prepared: DataFrame, terms: DataFrame, language: Column | None) -> DataFrame:
    """Concepts with a term that starts with the query: terms emit prefixes of the queries' lengths as join keys."""
    rows = terms if language is None else terms.filter(F.col("language") == language)
    lengths = prepared.agg(F.collect_set(F.length("q")).alias("lengths")).scalar()
    sized = rows.select("concept_id", "language", "normalized", F.explode(lengths).alias("size"))
    prefixes = sized.filter(F.col("size") <= F.length("normalized")).select(
        "concept_id", "language", F.left("normalized", F.col("size")).alias("q")
    ).distinct()
    if language is None:
        return prepared.select("query_id", "language", "q").join(_shuffled(prefixes), ["language", "q"]).select(
            "query_id", "concept_id"
        )
    return prepared.select("query_id", "q").join(_shuffled(prefixes.drop("language")), "q").select(
        "query_id", "concept_id"
    )


def deletion_variants(text: Column) -> Column:
    """The text itself and the text with each single character removed."""
    return F.array_distinct(
        F.concat(
            F.array(text),
            F.transform(
                F.sequence(F.lit(1), F.length(text)),
                lambda i: F.concat(F.left(text, i - 1), F.substring(text, i + 1, F.length(text))),
            ),
        )
    )


def fuzzy_unique(prepared: DataFrame, terms: DataFrame) -> DataFrame:
    """Aliases exactly one edit away, kept only when a single concept matches.

    Two strings one edit apart share a one-deletion variant, which gives an exact equality key.
    """
    alias = terms.filter(F.col("scope").isin(*ALIAS_SCOPES)).select(
        "concept_id", "language", "normalized"
    ).distinct()
    left = prepared.filter(F.length("q") >= FUZZY_MIN_LENGTH).select(
        "query_id", "language", "q", F.explode(deletion_variants(F.col("q"))).alias("variant")
    )
    right = alias.select("*", F.explode(deletion_variants(F.col("normalized"))).alias("variant"))
    pairs = (
        left.join(_shuffled(right), ["language", "variant"])
        .filter(F.levenshtein("q", "normalized", 1) == 1)
        .select("query_id", "concept_id")
    )
    return (
        pairs.groupBy("query_id")
        .agg(F.min("concept_id").alias("concept_id"), F.max("concept_id").alias("_last"))
        .filter(F.col("concept_id") == F.col("_last"))
        .drop("_last")
    )


def tiered(
    queries: DataFrame, terms: DataFrame, catalogue: DataFrame, *,
    limit: int = RESULT_LIMIT, fuzzy: bool = True,
) -> DataFrame:
    """Ranked concepts per query.

    Tiers: 0 exact preferred, 1 exact alias, 2 prefix, 3 lexical, 4 safe fuzzy, 5 English.
    """
    prepared = prepare_queries(queries)
    index = term_index(terms)

    def fixed(df: DataFrame, value: int) -> DataFrame:
        return df.select("query_id", "concept_id", F.lit(value).alias("tier"), F.lit(0.0).alias("bm25"))

    better = _same_text(prepared, terms).unionByName(
        _prefix_matches(prepared, terms, None).withColumn("tier", F.lit(2))
    )
    matched = _ranked_lexical(prepared, better, index, catalogue, limit)
    rows = better.withColumn("bm25", F.lit(0.0)).unionByName(
        matched.select("query_id", "concept_id", F.lit(3).alias("tier"), "bm25")
    )
    rows = rows.unionByName(fixed(_prefix_matches(prepared, terms, F.lit("en")), 5))
    if fuzzy:
        rows = rows.unionByName(fixed(fuzzy_unique(prepared, terms), 4))
    best = rows.groupBy("query_id", "concept_id").agg(
        F.min("tier").alias("tier"), F.round(F.max("bm25"), 9).alias("bm25")
    )
    order = W.partitionBy("query_id").orderBy(
        "tier", F.col("bm25").desc(), F.lower("label"), "code", "concept_id"
    )
    return (
        best.join(catalogue.select("concept_id", "label", "code"), "concept_id")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("query_id", "rank", "concept_id", "tier", "bm25")
    )


def _shuffled(rows: DataFrame) -> DataFrame:
    """Rows that no join broadcasts: Spark guesses the size of exploded words and variants from that of compressed files."""
    return rows.hint("merge")


def _runs(word: Column, size: Column) -> Column:
    """Every run of ``size`` characters of a word that has so many."""
    starts = F.sequence(F.lit(1), F.length(word) - size + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substring(word, i, size)))


def _asked_runs(token: Column) -> Column:
    """Runs a word must have to contain the token: the token itself, or the longest runs of a very long one."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(token) - KEY_RUN + 1))
    return F.transform(starts, lambda i: F.substring(token, i, F.lit(KEY_RUN)))


def _words_to_read(side: DataFrame, words: DataFrame) -> DataFrame:
    """``side(query_id, target, q, q_tokens)`` with each word that has the query's rarest run.

    ``words(language, word, uses)``. A run is as long as the token asked for, so short runs of long tokens, which a
    share of all words have, pair no query with them.
    """
    asked = side.select("*", F.explode(F.array_distinct(F.flatten(F.transform("q_tokens", _asked_runs)))).alias("key"))
    sizes = asked.agg(F.collect_set(F.length("key")).alias("sizes")).scalar()
    sized = words.select(F.col("language").alias("target"), "word", "uses", F.explode(sizes).alias("size")).filter(F.col("size") <= F.length("word"))
    keyed = sized.select("target", "word", "uses", F.explode(_runs(F.col("word"), F.col("size"))).alias("key"))
    uses = keyed.groupBy("target", "key").agg(F.sum("uses").alias("uses"))
    rarest = (
        asked.join(_shuffled(uses), ["target", "key"], "left")
        .groupBy("query_id", "target", "q", "q_tokens")
        .agg(F.min(F.struct(F.coalesce("uses", F.lit(0)).alias("uses"), "key")).alias("m"))
        .select("query_id", "target", "q", "q_tokens", F.col("m.key").alias("key"))
    )
    return rarest.join(_shuffled(keyed.drop("uses")), ["target", "key"]).drop("key")


def token_contains(
    queries: DataFrame, terms: DataFrame, catalogue: DataFrame, *, limit: int = RESULT_LIMIT
) -> DataFrame:
    """The older tiers, where a query token may be any part of a word.

    A token has no space, so it lies inside one word: words are keyed by their runs of the tokens' lengths and the
    query joins on the rarest of its own; whole tokens are checked inside the row.
    """
    prepared = (
        queries.withColumn("q", normalize.normalize_search(F.col("text")))
        .withColumn("q_tokens", F.array_distinct(normalize.tokens(F.col("q"))))
        .filter(F.length("q") >= 2)
    )
    words = terms.filter("normalized <> ''").select(
        "concept_id", "language", "scope", "normalized",
        F.explode(F.array_distinct(F.split("normalized", " "))).alias("word"),
    )
    counts = words.groupBy("language", "word").agg(F.count("*").alias("uses"))

    def contained(side: DataFrame) -> DataFrame:
        """``side(query_id, target, q, q_tokens)``: terms of ``target`` containing every token."""
        return (
            _words_to_read(side, counts)
            .join(_shuffled(words.withColumnRenamed("language", "target")), ["target", "word"])
            .filter(F.forall("q_tokens", lambda t: F.contains(F.col("normalized"), t)))
            .select("query_id", "q", "concept_id", "scope", "normalized")
        )

    local = contained(prepared.select("query_id", F.col("language").alias("target"), "q", "q_tokens"))
    english = contained(prepared.select("query_id", F.lit("en").alias("target"), "q", "q_tokens"))
    tier = (
        F.when((F.col("normalized") == F.col("q")) & F.col("scope").isin(*PREFERRED_SCOPES), 0)
        .when(F.col("normalized") == F.col("q"), 1)
        .when(F.col("normalized").startswith(F.col("q")), 2)
        .otherwise(3)
    )
    exact_tiers = local.select("query_id", "concept_id", tier.alias("tier")).unionByName(
        english.select("query_id", "concept_id", F.lit(5).alias("tier"))
    )
    near = _near_aliases(prepared, terms)
    best = exact_tiers.unionByName(near.select("query_id", "concept_id", F.lit(4).alias("tier"))).groupBy(
        "query_id", "concept_id"
    ).agg(F.min("tier").alias("tier"))
    lonely = W.partitionBy("query_id")
    safe = best.withColumn("fuzzy", F.count_if(F.col("tier") == 4).over(lonely)).filter(
        (F.col("tier") != 4) | (F.col("fuzzy") == 1)
    )
    order = W.partitionBy("query_id").orderBy("tier", F.lower("label"), "code", "concept_id")
    return (
        safe.join(_shuffled(catalogue.select("concept_id", "label", "code")), "concept_id")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("query_id", "rank", "concept_id", "tier")
    )


def _near_aliases(prepared: DataFrame, terms: DataFrame) -> DataFrame:
    alias = terms.filter(F.col("scope").isin(*ALIAS_SCOPES))
    left = prepared.filter(F.length("q") >= FUZZY_MIN_LENGTH).select(
        "query_id", "language", "q", F.explode(deletion_variants(F.col("q"))).alias("variant")
    )
    right = alias.select(
        "concept_id", "language", "normalized",
        F.explode(deletion_variants(F.col("normalized"))).alias("variant"),
    )
    return (
        left.join(_shuffled(right), ["language", "variant"])
        .filter(F.levenshtein("q", "normalized", 1) == 1)
        .select("query_id", "concept_id")
        .distinct()
    )


def substring(catalogue: DataFrame, text: str) -> DataFrame:
    """Catalogue rows whose label or code contains the text, without pattern characters."""
    needle = F.lit(text.lower())
    return catalogue.filter(
        F.contains(F.lower("label"), needle) | F.contains(F.lower("code"), needle)
    )


# --- display labels ------------------------------------------------------------------------

# Question text per language.
QUESTION_TEMPLATES = {
    "fr": "Avez-vous ce symptôme : {} ?",
    "de": "Haben Sie dieses Symptom: {}?",
    "en": "Do you have this symptom: {}?",
}


def display_labels(
    designations: DataFrame, concepts: DataFrame, language: str, lexicon: DataFrame | None = None
) -> DataFrame:
    """Best label of each active concept in a language, falling back to English."""
    rows = designations.select(
        "concept_id", "language", "scope", "text",
        F.lit("").alias("question"), F.lit("source_designation").alias("origin"),
    )
    if lexicon is not None:
        rows = rows.unionByName(
            lexicon.filter(F.col("scope") == "ui_preferred").select(
                "concept_id", "language", "scope", "text",
                F.coalesce("question", F.lit("")).alias("question"),
                F.lit("display_lexicon").alias("origin"),
            )
        )
    scope = (
        F.when((F.col("language") == "en") & (F.col("scope") == "ui_preferred"), 0)
        .when(F.col("scope") == "preferred", 1)
        .when(F.col("scope") == "ui_preferred", 2)
        .otherwise(3)
    )
    key = F.struct(
        (F.col("language") != language).alias("a"), scope.alias("b"),
        (F.col("language") != "en").alias("c"), F.col("text"), F.col("language"),
        F.col("origin"), F.col("question"),
    )
    active = concepts.filter(F.col("status") == "active").select("concept_id")
    best = (
        rows.filter(F.col("language").isin(language, "en"))
        .groupBy("concept_id")
        .agg(F.min(key).alias("m"))
        .join(active, "concept_id", "left_semi")
    )
    template = F.lit(None).cast("string")
    for code, text in QUESTION_TEMPLATES.items():
        before, after = text.split("{}")
        template = F.when(
            F.col("m.language") == code, F.concat(F.lit(before), F.col("m.text"), F.lit(after))
        ).otherwise(template)
    return best.select(
        "concept_id",
        F.col("m.text").alias("display_label"),
        F.col("m.language").alias("display_language"),
        F.col("m.origin").alias("origin"),
        (F.col("m.language") != language).alias("fallback_english"),
        F.when(F.col("m.question") != "", F.col("m.question")).otherwise(template).alias("question_text"),
    )


# --- mention grounding ---------------------------------------------------------------------


def ground_mentions(mentions: DataFrame) -> DataFrame:
    """Exact span of each mention in its narrative.

    ``mentions(narrative_id, position, narrative, phrase, status)``. The k-th valid mention of
    a phrase takes its k-th occurrence, overlapping ones included. Other mentions keep a NULL span and
    say why in ``problem``: length, status or no_occurrence. A narrative is searched once per phrase.
    """
    problem = F.when(~F.col("status").isin("present", "absent", "unknown") | F.col("status").isNull(), "status").when(
        ~F.coalesce(F.length("phrase").between(2, 160), F.lit(False)), "length"
    )
    marked = mentions.withColumn("problem", problem)
    valid = marked.filter(F.col("problem").isNull())
    asked = valid.groupBy("narrative_id", "phrase").agg(
        F.first("narrative").alias("narrative"), F.array_sort(F.collect_list(F.struct("position", "status"))).alias("asked")
    )
    next_at = "locate(phrase, narrative, a.at + 1)"
    starts = F.expr(
        "aggregate(asked, named_struct('at', 0, 'found', cast(array() AS array<int>)), (a, m) -> CASE WHEN a.at < 0 THEN a "
        f"WHEN {next_at} = 0 THEN named_struct('at', -1, 'found', a.found) "
        f"ELSE named_struct('at', {next_at}, 'found', concat(a.found, array({next_at}))) END).found"
    )
    placed = asked.select(
        "narrative_id", "phrase", starts.alias("found"), F.posexplode("asked").alias("i", "m")
    ).withColumn("at", F.get("found", F.col("i")) - 1)
    spans = placed.select(
        "narrative_id", "m.position", "phrase", "m.status", F.col("at").alias("start"), (F.col("at") + F.length("phrase")).alias("end"),
        F.when(F.col("at").isNull(), "no_occurrence").alias("problem"),
    )
    none = F.lit(None).cast("int")
    rest = marked.filter(F.col("problem").isNotNull()).select(
        "narrative_id", "position", "phrase", "status", none.alias("start"), none.alias("end"), "problem"
    )
    return spans.unionByName(rest)


def suggest(options: DataFrame) -> DataFrame:
    """Suggested concept per query: an exact or alias match with no competitor of equal tier."""
    by_rank = F.array_sort(F.collect_list(F.struct("rank", "tier", "concept_id")))
    top = options.filter(F.col("rank") <= 3).groupBy("query_id").agg(by_rank.alias("o"))
    first, second = F.col("o")[0], F.try_element_at("o", F.lit(2))
    alone = second.isNull() | (second["tier"] != first["tier"])
    return top.select(
        "query_id", F.size("o").alias("options"),
        F.when((first["tier"] <= 1) & alone, first["concept_id"]).alias("suggested"),
    )


def retrieval_quality(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Hits at rank 1, 3 and 5, empty answers and unwanted suggestions.

    ``expected(query_id, mode, concept_id)`` with NULL where nothing should be suggested.
    """
    hit = results.select("query_id", F.col("concept_id").alias("found"), "rank")
    rows = expected.join(
        hit, (expected.query_id == hit.query_id) & (expected.concept_id == hit.found), "left"
    ).select(expected.query_id, "mode", expected.concept_id, "rank")
    answered = results.select(F.col("query_id").alias("answered")).distinct()
    joined = rows.join(answered, rows.query_id == answered.answered, "left")
    wanted = F.col("concept_id").isNotNull()
    return joined.groupBy("mode").agg(
        F.count("*").alias("queries"),
        F.count_if(wanted & (F.col("rank") <= 1)).alias("top1"),
        F.count_if(wanted & (F.col("rank") <= 3)).alias("top3"),
        F.count_if(wanted & (F.col("rank") <= 5)).alias("top5"),
        F.count_if(wanted & F.col("answered").isNull()).alias("no_result"),
        F.count_if(~wanted & F.col("answered").isNotNull()).alias("unexpected"),
    )


def language_coverage(terms: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Concepts each language names itself, names by alias, or leaves to English."""
    rows = terms.join(catalogue.select("concept_id"), "concept_id", "left_semi")
    total = catalogue.agg(F.count_distinct("concept_id").alias("n"))
    per = rows.groupBy("language").agg(
        F.count_distinct(F.when(F.col("scope").isin(*PREFERRED_SCOPES), F.col("concept_id"))).alias("native"),
        F.count_distinct("concept_id").alias("covered"),
        F.count_if(F.col("scope").isin(*ALIAS_SCOPES)).alias("aliases"),
    )
    return per.withColumn("fallback", total.scalar() - F.col("covered"))


def translation_review(catalogue: DataFrame, terms: DataFrame, language: str) -> DataFrame:
    """Catalogue rows beside their label in a language, for a reviewer."""
    chosen = terms.filter(
        (F.col("language") == language) & F.col("scope").isin(*PREFERRED_SCOPES)
    ).groupBy("concept_id").agg(F.min("text").alias("translation"))
    return catalogue.join(chosen, "concept_id", "left").select(
        "concept_id", "code", "label", "translation"
    )

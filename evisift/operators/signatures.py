"""Family scores per pattern of observations.

Cases that assess the same findings alike are one pattern and are scored once. The findings of a pattern that very many
statements speak about form its common part; patterns share few of these, so the votes on a part are summed once per
part and subject. A pattern's own rows are the subjects that its other findings vote on; a subject that only the part
votes on has the part's score in every pattern, so the part's leaders stand in for all of them.

Patterns without a common part are scored where their lists of votes meet: lists are arrays of subjects, one row a pattern
and finding, and only leaders, or the subjects that several votes name, come out of it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evisift.operators import family, leading
from evisift.operators.family import RESULT_LIMIT
from evisift.operators.numbering import dense_ids
from evisift.session import materialize

# Findings with more scorable statements belong to the common part.
LONG_LIST = 4096


@dataclass(frozen=True)
class Signatures:
    cases: DataFrame  # case_id, pattern
    patterns: DataFrame  # pattern, part (null without common findings), cases
    short: DataFrame  # pattern, finding, relation, status
    long: DataFrame  # part, finding, relation, status
    shared: bool  # whether there is any part


@dataclass(frozen=True)
class Lists:
    subjects: DataFrame  # subject, s, in the order of the names
    rows: DataFrame  # s, finding, relation, code: twice the family's number, and one if present
    weights: dict[int, float]  # by the family's number
    unlisted: float  # weight of other families, NaN if they have none


@dataclass(frozen=True)
class Scores:
    signatures: Signatures
    lists: Lists  # votes on the patterns without a part
    own: DataFrame | None  # pattern, subject, score, evaluated: patterns with a part
    parts: DataFrame | None  # part, subject, score, evaluated


def signatures(observations: DataFrame, rows: DataFrame, *, long_list: int = LONG_LIST) -> Signatures:
    """Patterns of the assessed findings that ``rows`` (scorable statements) speak about; cases without any are left out."""
    told = family.assessed(observations).select("case_id", "finding", "relation", "status").distinct()
    sizes = rows.groupBy("finding", "relation").agg(F.count(F.lit(1)).alias("size"))
    item = F.struct("finding", "relation", "status")
    known = told.join(sizes, ["finding", "relation"])

    def listed(of: Column) -> Column:
        return F.to_json(F.array_sort(F.collect_list(of)))

    long = F.col("size") > long_list
    keys = known.groupBy("case_id").agg(listed(F.when(~long, item)).alias("short"), listed(F.when(long, item)).alias("long"))
    keys = materialize(keys.withColumn("key", F.concat_ws("|", "short", "long")), "signature_keys")
    numbered = materialize(dense_ids(keys.groupBy("key", "short", "long").agg(F.count(F.lit(1)).alias("cases")), "key", "pattern"), "signatures")
    cases = materialize(keys.select("case_id", "key").join(numbered.select("key", "pattern"), "key").select("case_id", "pattern"), "case_signatures")
    commons = numbered.filter("long <> '[]'").select("long").distinct()
    shared = not commons.isEmpty()
    unpack = "array<struct<finding: string, relation: string, status: string>>"
    short = numbered.select("pattern", F.inline(F.from_json("short", unpack)))
    if not shared:
        patterns = numbered.select("pattern", F.lit(None).cast("long").alias("part"), "cases")
        return Signatures(cases, patterns, short, short.limit(0).withColumnRenamed("pattern", "part"), False)
    parts = materialize(dense_ids(commons, "long", "part"), "parts")
    patterns = materialize(numbered.join(parts, "long", "left").select("pattern", "part", "cases"), "pattern_parts")
    return Signatures(cases, patterns, short, parts.select("part", F.inline(F.from_json("long", unpack))), True)


def _votes(rows: DataFrame, members: DataFrame, by: str) -> DataFrame:
    vote = F.when((F.col("polarity") == "present") == (F.col("status") == "present"), 1.0).otherwise(-1.0)
    return rows.join(members, ["finding", "relation"]).groupBy(by, "subject", "family").agg(F.sum(vote).alias("total"), F.count(vote).alias("votes"))


def _means(votes: DataFrame, by: str) -> DataFrame:
    return votes.select(F.col(by).alias("case_id"), "subject", "family", (F.col("total") / F.col("votes")).alias("mean"), "votes")


def _with_parts(rows: DataFrame, signs: Signatures) -> tuple[DataFrame, DataFrame | None]:
    """Votes per (pattern, subject, family) of the subjects that a pattern's own findings vote on, and votes per part."""
    short = _votes(rows, signs.short, "pattern")
    if not signs.shared:
        return short, None
    short = materialize(short, "short_votes")
    parts = materialize(_votes(rows, signs.long, "part"), "part_votes")
    mine = short.select("pattern", "subject").distinct().join(signs.patterns.filter("part IS NOT NULL"), "pattern")
    added = short.unionByName(mine.join(parts, ["part", "subject"]).select("pattern", "subject", "family", "total", "votes"))
    return added.groupBy("pattern", "subject", "family").agg(F.sum("total").alias("total"), F.sum("votes").alias("votes")), parts


def score(observations: DataFrame, rows: DataFrame, weights: dict[str, float], *, long_list: int = LONG_LIST, **options) -> Scores:
    """Scores as ``family.score_candidates`` gives them, per pattern and per common part."""
    signs = signatures(observations, rows, long_list=long_list)
    lists = _lists(rows, weights, **options)
    if not signs.shared:
        return Scores(signs, lists, None, None)
    mixed = replace(signs, short=signs.short.join(signs.patterns.filter("part IS NOT NULL"), "pattern", "left_semi"))
    own, parts = _with_parts(rows, mixed)
    scored = family.score_candidates(_means(own, "pattern"), weights, **options).withColumnRenamed("case_id", "pattern")
    part_scores = family.score_candidates(_means(parts, "part"), weights, **options).withColumnRenamed("case_id", "part")
    return Scores(signs, lists, materialize(scored, "pattern_scores"), materialize(part_scores, "part_scores"))


def _lists(rows: DataFrame, weights: dict[str, float], *, allow_unlisted: bool = False) -> Lists:
    if any(w <= 0 for w in weights.values()):
        raise ValueError("family weights must be positive")
    subjects = materialize(dense_ids(rows.select("subject").distinct(), "subject", "s"), "voted_subjects")
    families = materialize(dense_ids(rows.select("family").distinct(), "family", "number"), "voted_families")
    listed = {r["number"]: weights[r["family"]] for r in families.filter(F.col("family").isin(*weights)).collect()}  # at most as many as weights
    code = F.col("number") * 2 + (F.col("polarity") == "present").cast("int")
    coded = rows.join(subjects, "subject").join(families, "family").select("s", "finding", "relation", code.cast("int").alias("code"))
    return Lists(subjects, materialize(coded, "coded_votes"), listed, 1.0 if allow_unlisted else float("nan"))


def _plain(signs: Signatures) -> DataFrame:
    """Findings of the patterns without a common part: pattern, cases, finding, relation, seen."""
    alone = signs.patterns.filter("part IS NULL").select("pattern", "cases")
    return signs.short.join(alone, "pattern").select("pattern", "cases", "finding", "relation", (F.col("status") == "present").alias("seen"))


def _told(scores: Scores) -> DataFrame:
    """Lists of votes beside the patterns without a part, pattern by pattern."""
    plain = _plain(scores.signatures)
    used = scores.lists.rows.join(plain.select("finding", "relation").distinct(), ["finding", "relation"], "left_semi")
    entry = F.struct(F.col("s").cast("int").alias("s"), "code")
    lists = used.groupBy("finding", "relation").agg(F.collect_list(entry).alias("list"))
    told = plain.join(lists, ["finding", "relation"]).select("pattern", "cases", "seen", F.col("list.s").alias("s"), F.col("list.code").alias("code"))
    return told.repartition("pattern").sortWithinPartitions("pattern")


def _leaders(scores: Scores, limit: int) -> DataFrame:
    return _told(scores).mapInArrow(leading.leaders_of_votes(scores.lists.weights, scores.lists.unlisted, limit), leading.VOTES)


def _rounded(value: Column) -> Column:
    return F.round(value, family.DIGITS) + F.lit(0.0)


def _doubled(scores: Scores) -> DataFrame:
    """``(pattern, part, subject)``: own rows whose subject the pattern's part votes on too."""
    mine = scores.own.select("pattern", "subject").join(scores.signatures.patterns.filter("part IS NOT NULL"), "pattern")
    return mine.join(scores.parts.select("part", "subject"), ["part", "subject"]).select("pattern", "part", "subject", "cases")


def ranked(scores: Scores, limit: int = RESULT_LIMIT) -> DataFrame:
    """The best ``limit`` subjects per case: case_id, subject, score, evaluated, rank.

    Of a part no more leaders are read than the limit and the pattern's own subjects that may be among them.
    """
    own = _leaders(scores, limit).join(scores.lists.subjects, "s").select("pattern", "subject", _rounded(F.col("value")).alias("score"), "evaluated")
    if scores.parts is not None:
        doubled = _doubled(scores).groupBy("pattern").agg(F.count(F.lit(1)).alias("doubled"))
        order = W.partitionBy("part").orderBy(F.col("score").desc(), F.col("evaluated").desc(), F.col("subject"))
        leaders = scores.parts.withColumn("place", F.row_number().over(order))
        wanted = scores.signatures.patterns.filter("part IS NOT NULL").join(doubled, "pattern", "left").select(
            "pattern", "part", F.explode(F.sequence(F.lit(1), (F.coalesce("doubled", F.lit(0)) + limit).cast("int"))).alias("place")
        )
        standing = wanted.join(leaders, ["part", "place"]).select("pattern", "subject", "score", "evaluated")
        own = own.unionByName(scores.own).unionByName(standing.join(scores.own, ["pattern", "subject"], "left_anti"))
    best = family.rank(own.withColumnRenamed("pattern", "case_id"), limit).withColumnRenamed("case_id", "pattern")
    return scores.signatures.cases.join(best, "pattern").select("case_id", "subject", "score", "evaluated", "rank")


def candidate_counts(scores: Scores) -> DataFrame:
    """``(case_id, candidates)`` of the cases with any scored candidate."""
    counted = _leaders(scores, 1).groupBy("pattern").agg(F.max("candidate_count").alias("candidates"))
    if scores.parts is not None:
        mixed = scores.own.groupBy("pattern").agg(F.count(F.lit(1)).alias("candidates"))
        in_part = scores.parts.groupBy("part").agg(F.count(F.lit(1)).alias("candidates"))
        twice = _doubled(scores).groupBy("pattern").agg((-F.count(F.lit(1))).alias("candidates"))
        more = scores.signatures.patterns.join(in_part, "part").select("pattern", "candidates")
        counted = counted.unionByName(mixed).unionByName(more).unionByName(twice).groupBy("pattern").agg(F.sum("candidates").alias("candidates"))
    return scores.signatures.cases.join(counted, "pattern").select("case_id", "candidates")


def subject_totals(scores: Scores) -> DataFrame:
    """Per subject the number of cases it is scored in, the sum, least and largest score, and the votes evaluated."""

    def weighed(rows: DataFrame) -> DataFrame:
        n = F.col("cases")
        return rows.select(
            "subject", "cases", (F.col("score") * n).alias("total"), (F.col("evaluated") * n).alias("evaluated"), F.when(n > 0, F.col("score")).alias("score")
        )

    rows = weighed(_plain_totals(scores))
    if scores.parts is not None:
        rows = rows.unionByName(weighed(scores.own.join(scores.signatures.patterns.select("pattern", "cases"), "pattern")))
        # cases of a part without those whose own rows have the subject
        cases = scores.signatures.patterns.filter("part IS NOT NULL").groupBy("part").agg(F.sum("cases").alias("all"))
        twice = _doubled(scores).groupBy("part", "subject").agg(F.sum("cases").alias("taken"))
        left = scores.parts.join(cases, "part").join(twice, ["part", "subject"], "left")
        rows = rows.unionByName(weighed(left.withColumn("cases", F.col("all") - F.coalesce("taken", F.lit(0)))))
    return rows.filter("cases > 0").groupBy("subject").agg(
        F.sum("cases").alias("cases"), (F.round(F.sum("total"), 6) + F.lit(0.0)).alias("total"), F.min("score").alias("low"), F.max("score").alias("high"),
        F.sum("evaluated").cast("bigint").alias("evaluated"),
    )


def _plain_totals(scores: Scores) -> DataFrame:
    """Rows (subject, score, evaluated, cases) of the patterns without a part, cases with equal values added up.

    A single vote scores 1 or -1, so votes are counted per statement and case; subjects that several votes of a pattern name are
    taken out of these counts and scored on their own.
    """
    lists = scores.lists
    asked = _plain(scores.signatures).groupBy("finding", "relation", "seen").agg(F.sum("cases").alias("cases"))
    number = F.shiftright(F.col("code"), 1)
    listed = lists.rows if lists.unlisted == lists.unlisted else lists.rows.filter(number.isin(*lists.weights))
    agrees = (F.col("code").bitwiseAND(1) == 1) == F.col("seen")
    single = listed.join(asked, ["finding", "relation"]).select("s", F.when(agrees, 1.0).otherwise(-1.0).alias("value"), F.lit(1).cast("long").alias("evaluated"), "cases")
    single = single.groupBy("s", "value", "evaluated").agg(F.sum("cases").alias("cases"))
    several = _told(scores).mapInArrow(leading.repeated_votes(lists.weights, lists.unlisted), leading.REPEATED)
    n = F.col("cases")
    replaced = F.array(
        F.struct(F.col("value"), F.col("evaluated"), F.when(F.col("scored"), n).otherwise(0).alias("cases")),
        F.struct(F.lit(1.0).alias("value"), F.lit(1).cast("long").alias("evaluated"), (-n * F.col("plus")).alias("cases")),
        F.struct(F.lit(-1.0).alias("value"), F.lit(1).cast("long").alias("evaluated"), (-n * F.col("minus")).alias("cases")),
    )
    rows = single.unionByName(several.select("s", F.inline(replaced)).filter("cases <> 0"))
    score = _rounded(F.col("value")).alias("score")
    summed = rows.select("s", score, "evaluated", "cases").groupBy("s", "score", "evaluated").agg(F.sum("cases").alias("cases"))
    return summed.filter("cases <> 0").join(lists.subjects, "s").select("subject", "score", "evaluated", "cases")


def match_summary(observations: DataFrame, rows: DataFrame, *, long_list: int = LONG_LIST) -> DataFrame:
    """Per case the number of subjects that share an assessed finding and relation with it, and the first of them."""
    signs = signatures(observations, rows, long_list=long_list)
    keys = rows.select("subject", "finding", "relation").distinct()
    facts = [F.count("subject").alias("candidates"), F.min("subject").alias("first")]
    own = keys.join(signs.short, ["finding", "relation"]).select("pattern", "subject").distinct()
    if not signs.shared:
        counted = own.groupBy("pattern").agg(*facts)
    else:
        members = materialize(keys.join(signs.long, ["finding", "relation"]).select("part", "subject").distinct(), "part_members")
        outside = own.join(signs.patterns, "pattern").join(members, ["part", "subject"], "left_anti")
        inside = signs.patterns.join(members.groupBy("part").agg(*facts), "part").select("pattern", "candidates", "first")
        both = outside.groupBy("pattern").agg(*facts).unionByName(inside)
        counted = both.groupBy("pattern").agg(F.sum("candidates").alias("candidates"), F.min("first").alias("first"))
    return signs.cases.join(counted, "pattern").select("case_id", "candidates", "first")


def contribution_counts(observations: DataFrame, rows: DataFrame) -> DataFrame:
    """Per finding and reason the number of (case, statement, family) contributions and of their subjects.

    Observations and statements are counted by kind first, so no contribution is made.
    """
    evaluated = F.col("evaluated") if "evaluated" in observations.columns else F.lit("assessed")
    kinds = observations.select("finding", F.col("relation").alias("observed"), "status", evaluated.alias("evaluated")).groupBy(
        "finding", "observed", "status", "evaluated"
    ).agg(F.count(F.lit(1)).alias("observations"))
    per_subject = rows.groupBy("finding", "relation", "polarity", "subject").agg(F.count(F.lit(1)).alias("statements"))
    reason = family.contribution_reason(F.col("observed"), F.col("relation"), F.col("evaluated"), F.col("status"), F.col("polarity"))
    joined = per_subject.join(kinds, "finding").withColumn("reason", reason)
    each = joined.groupBy("finding", "reason", "subject").agg(F.sum(F.col("statements") * F.col("observations")).alias("rows"))
    return each.groupBy("finding", "reason").agg(F.sum("rows").cast("bigint").alias("rows"), F.count(F.lit(1)).alias("subjects"))

"""Scores and question counts per pattern of observations against the plain forms over all pairs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evisift.operators import family, leading, matched, questions, signatures

WEIGHTS = {"f0": 2.0, "f1": 1.0}


@pytest.fixture(scope="module")
def corpus(spark):
    """Finding g00 is common: a third of the statements and half of the cases have it."""
    rng = random.Random(4)
    pick = lambda: "g00" if rng.random() < 0.33 else f"g{rng.randrange(25):02}"
    rows = {
        (f"k{rng.randrange(60)}", rng.choice(["has_sign", "has_sign", "has_symptom"]), pick(), rng.choice(["present", "present", "excluded"]), f"f{rng.randrange(3)}")
        for _ in range(600)
    }
    statements = spark.createDataFrame(sorted(rows), "subject string, relation string, finding string, polarity string, family string").withColumn(
        "canonical_id", F.concat_ws("|", "subject", "relation", "finding", "polarity")
    )
    told = {}
    for c in range(40):
        for f in {pick() for _ in range(rng.choice([1, 2, 4]))}:
            told[f"c{c:02}", f] = rng.choice(["has_sign", "has_symptom"]), rng.choice(["present", "present", "absent", "unknown"])
    told |= {("twin", f): x for (c, f), x in told.items() if c == "c00"}
    obs = spark.createDataFrame([(c, f, *x) for (c, f), x in told.items()], "case_id string, finding string, relation string, status string")
    return obs.persist(), statements.persist()


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


@pytest.mark.parametrize("long_list", [20, 4096])
def test_family_ranking_equals_scores_of_all_pairs(spark, corpus, long_list):
    obs, statements = corpus
    plain = family.score_candidates(family.family_means(obs, statements), WEIGHTS)
    scored = signatures.score(obs, statements, WEIGHTS, long_list=long_list)
    assert scored.signatures.shared == (long_list == 20)
    columns = ["case_id", "subject", "score", "evaluated", "rank"]
    for limit in (2, 1000):
        assert rows(signatures.ranked(scored, limit), *columns) == rows(family.rank(plain, limit), *columns)
    assert rows(signatures.candidate_counts(scored)) == rows(plain.groupBy("case_id").agg(F.count("*")))
    totals = plain.groupBy("subject").agg(
        F.count("*"), F.round(F.sum("score"), 6) + F.lit(0.0), F.min("score"), F.max("score"), F.sum("evaluated")
    )
    assert rows(signatures.subject_totals(scored)) == rows(totals)


def test_rows_follow_patterns_and_short_lists(spark, corpus):
    obs, statements = corpus
    plain = family.family_means(obs, statements).select("case_id", "subject").distinct().count()
    scored = signatures.score(obs, statements, WEIGHTS, long_list=20)
    assert scored.own.count() + scored.parts.count() < plain / 2
    assert scored.signatures.patterns.count() < obs.select("case_id").distinct().count()


@pytest.mark.parametrize("long_list", [10, 4096])
def test_matches_and_contributions_are_counted_without_pairs(spark, corpus, long_list):
    obs, statements = corpus
    pairs = family.matching_candidates(obs, statements).groupBy("case_id").agg(F.count("subject"), F.min("subject"))
    assert rows(signatures.match_summary(obs, statements, long_list=long_list)) == rows(pairs)
    each = family.contributions(obs, statements).groupBy("finding", "reason").agg(F.count("*"), F.count_distinct("subject"))
    assert rows(signatures.contribution_counts(obs, statements)) == rows(each)


@pytest.mark.parametrize("long_list", [10, 4096])
def test_questions_over_matched_candidates_equal_counts_of_pairs(spark, corpus, long_list):
    obs, statements = corpus
    pairs = family.matching_candidates(obs, statements)
    options = questions.documentation_variation(pairs, statements, obs)
    for limit in (1, 5):
        got = matched.questions_by_variation(obs, statements, statements, obs, limit, long_list=long_list)
        columns = ["case_id", "step", "finding", "documented", "matched", "variation"]
        assert rows(got, *columns) == rows(questions.ordered_by_variation(options, limit), *columns)
    got = matched.question_by_opposition(obs, statements, statements, obs, long_list=long_list)
    assert rows(got) == rows(questions.opposing_inside_matched(pairs, statements, obs))


def test_no_assessed_observation(spark, corpus):
    obs, statements = corpus
    none = obs.withColumn("status", F.lit("unknown"))
    scored = signatures.score(none, statements, WEIGHTS)
    assert signatures.ranked(scored).isEmpty() and signatures.candidate_counts(scored).isEmpty()
    assert matched.questions_by_variation(none, statements, statements, obs).isEmpty()


def test_no_table_of_patterns_and_subjects_without_common_findings(spark, corpus, monkeypatch):
    """Lists of votes stay arrays: of 40 cases only the leaders, or the subjects that several votes name, become rows."""
    obs, statements = corpus
    pairs = family.family_means(obs, statements).select("case_id", "subject").distinct().count()
    written = {}
    kept = signatures.materialize

    def counting(df, label, **options):
        out = kept(df, label, **options)
        written[label] = out.count()
        return out

    monkeypatch.setattr(signatures, "materialize", counting)
    scored = signatures.score(obs, statements.limit(500), WEIGHTS)
    assert max(written.values()) <= 500 < pairs and "pattern_scores" not in written and scored.own is None
    leaders = signatures._leaders(scored, 2).count()
    assert leaders < pairs / 2


def test_equal_values_go_by_votes_and_number_before_they_are_cut():
    rows = [
        {"pattern": 1, "cases": 3, "seen": True, "s": [5, 3, 8], "code": [1, 1, 3]}, {"pattern": 1, "cases": 3, "seen": False, "s": [8, 2, 9], "code": [2, 1, 5]},
    ]
    types = [("pattern", pa.int64()), ("cases", pa.int64()), ("seen", pa.bool_()), ("s", pa.list_(pa.int32())), ("code", pa.list_(pa.int32()))]
    for size in (1, 2):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + size], schema=pa.schema(types)) for i in range(0, 2, size)]
        weights = {0: 2.0, 1: 1.0}
        got = [tuple(r.values()) for b in leading.leaders_of_votes(weights, float("nan"), 2)(batches) for r in b.to_pylist()]
        # 8 agrees twice, 3 and 5 once, 2 is refuted; the family of 9 has no weight
        assert got == [(1, 8, 1.0, 2, 4), (1, 3, 1.0, 1, 4)]
        again = [tuple(r.values()) for b in leading.repeated_votes(weights, float("nan"))(batches) for r in b.to_pylist()]
        assert again == [(8, 3, 1.0, 2, True, 2, 0)]


def test_options_of_patterns_end_at_the_deepest_case(spark, corpus):
    """Only leading options become rows; what subjects several lists hold is taken off where lists meet, batches or not."""
    pack = leading._pack
    rows = [
        {"pattern": 1, "factor": 1, "size": 3, "of": pack(np.array([2, 1, 400])), "documented": pack(np.array([3, 1, 1])), "deepest": 2},
        {"pattern": 1, "factor": 1, "size": 2, "of": pack(np.array([3, 4])), "documented": pack(np.array([2, 1])), "deepest": 2},
        {"pattern": 1, "factor": -1, "size": -1, "of": pack(np.array([3])), "documented": pack(np.array([1])), "deepest": 2},
        {"pattern": 2, "factor": 1, "size": 1, "of": None, "documented": None, "deepest": 1},
    ]
    types = [("pattern", pa.int64()), ("factor", pa.int64()), ("size", pa.int64()), ("of", pa.binary()), ("documented", pa.binary()), ("deepest", pa.int64())]
    for size in (1, 3, 4):
        batches = [pa.RecordBatch.from_pylist(rows[i : i + size], schema=pa.schema(types)) for i in range(0, 4, size)]
        got = [tuple(r.values()) for b in leading.options_of_lists(["documented"], leading.by_variation)(batches) for r in b.to_pylist()]
        # of four matched subjects 2 is documented by three, 3 by two: 1 + 2 less the one counted twice
        assert got == [(1, 3, 4, 2), (1, 2, 4, 3)]
    obs, statements = corpus
    present = statements.filter("polarity = 'present'").select("subject", "finding").distinct().withColumn("documented", F.lit(1))
    depth, options = matched.counts(obs, statements, present, obs, leading.by_variation, 1)
    assert options.count() <= depth.groupBy("pattern").agg(F.max("depth").alias("d")).agg(F.sum("d")).collect()[0][0]

"""Queries over distinct statements, without ids of statements where none are asked for."""

import hashlib
import json
from collections import Counter

import pytest

from evisift.operators import audit, family, resolve
from evisift.plans import catalog, q_family
from evisift.plans import testbed as tb
from evisift.sources import snapshot

SF = "/root/testdata/sf0.001"


def refused(*_):
    raise AssertionError("table of statement ids built")


@pytest.mark.parametrize("name", ["a5_subjects_with_discriminant", "a19_dependency_rows", "d21_observable_catalogue", "h6_table_hashes", "h9_rebuild_differences", "m15_matching_candidates", "m17_polarity_contributions", "m22_abstention"])
def test_no_statement_ids_are_written(spark, monkeypatch, name):
    monkeypatch.setattr(tb, "canonical_bridge", refused)
    monkeypatch.setattr(tb, "canonical", refused)
    monkeypatch.setattr(tb, "assertions", refused)
    monkeypatch.setattr(q_family, "scorable", refused)
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_distinct_statements_are_not_sorted(spark):
    raw = spark.createDataFrame([("a", "r", "f", "present", str(i)) for i in range(3)], "subject string, relation string, finding string, polarity string, source_id string")
    rows = resolve.canonical_assertions(resolve.with_canonical_id(raw))
    assert rows.count() == 1 and rows.columns == ["canonical_id", "subject", "relation", "finding", "polarity"]
    assert "SortAggregate" not in rows._jdf.queryExecution().executedPlan().toString()


def test_opposed_findings_are_those_with_both_counts(spark):
    rows = [("a", "f1", "r", "present"), ("b", "f1", "r", "excluded"), ("a", "f2", "r", "present"), ("a", "f2", "q", "excluded"), ("c", "f3", "r", "excluded")]
    df = spark.createDataFrame(rows, "subject string, finding string, relation string, polarity string")
    found = audit.opposed(df)
    assert [tuple(r) for r in found.collect()] == [("f1", "r")] == [(r["finding"], r["relation"]) for r in audit.opposing_findings(df).collect()]
    assert audit.subjects_with_discriminant(df, found).first()[0] == 2


def test_differences_count_repeated_and_null_rows(spark):
    a = [("x", 1), ("x", 1), ("x", 1), (None, 2), ("same", 3)]
    b = [("x", 1), (None, 2), (None, 2), ("same", 3), ("only", None)]
    left, right = (spark.createDataFrame(r, "t string, n int") for r in (a, b))
    rows = snapshot.rebuild_differences(left, right)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert Counter(map(tuple, rows.collect())) == Counter({("x", 1, "rebuilt"): 2, (None, 2, "pinned"): 1, ("only", None, "pinned"): 1})


def test_digests_of_rows_move_as_bytes(spark):
    df = spark.range(300).selectExpr("cast(id as string) as t")
    hashes = sorted(hashlib.sha256(json.dumps({"t": str(i)}, separators=(",", ":")).encode()).hexdigest() for i in range(300))
    got = snapshot.table_hash(df, (1, 0))
    ends = [hashlib.sha256("".join(h for h in hashes if h[0] == d).encode()).hexdigest() for d in "0123456789abcdef"]
    assert got.first()["logical_sha256"] == hashlib.sha256("".join(ends).encode()).hexdigest() and got.first()["rows"] == 300
    assert "collect_list(h" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "unhex(" in plan


def test_scope_metrics_need_no_statement_ids(spark):
    rows = spark.createDataFrame(
        [("s1", "a", "sign", "x", "present", "r1"), ("s2", "a", "sign", "x", "present", "r1"), ("s3", "b", "sign", "x", "present", "r1"), ("s4", "b", "sign", "y", "excluded", "r2")],
        "source_id string, subject string, relation string, finding string, polarity string, release string",
    )
    known = spark.createDataFrame([("b",)], "subject string")
    got = family.scope_metrics(rows.filter("release = 'r1'"), rows, known, "r1").collect()
    assert [r.asDict() for r in got] == [{"statements": 2, "sources": 3, "findings": 1, "subjects": 1, "only_here": 1}]

"""Headline timings: prints one JSON line.

Each query runs to completion over its whole tables. Index tables (closure, statements, term and phrase
indexes) are built once per application, as in production, before the queries; ``index`` has their time. Queries that
start from the case ranking read it from a table that ``index`` has built too; the ranking query computes it anew.
"""

from __future__ import annotations

import json
import os
import time

from evisift.plans import catalog, q_audit, q_family, q_search, q_semantic, q_text, testbed
from evisift.session import build_session

HEADLINE = (
    "g1_ancestor_closure",
    "g2_information_content",
    "m12_semantic_rank",
    "q1_information_gain",
    "m19_family_rank",
    "q3_next_per_case",
    "q5_documentation_variation",
    "d17_observation_resolution",
    "t4_tiered_search",
    "d9_phrase_match",
    "x7_decisions",
    "a10_subject_profiles",
    "a13_quota_sample",
    "r2_agreement",
    "h3_canonical_assertion_id",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", master=f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": os.environ.get("BENCH_PARTITIONS", "32"), "spark.driver.memory": "20g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.time()
    for build in (testbed.closure, testbed.assertions, testbed.observations, testbed.canonical, q_semantic.index, q_semantic.ranked,
                  q_family.scorable, q_search.terms, q_text.dictionary, q_text.flagged, q_audit.events):
        build(spark, sf)
    index = round(time.time() - start, 3)
    timings: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 3)
    cases = testbed.table(spark, sf, "orders").count()
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
             "queries": timings, "index": index, "cases_per_sec": round(cases / timings["m12_semantic_rank"], 1), "sf": sf}
        )
    )


if __name__ == "__main__":
    main()

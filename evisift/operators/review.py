"""Review log: latest decisions, agreement, queues and admissibility.

  events(item, reviewer, stage, decision, category, mapping, sequence, event_hash, basis)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evisift.functions.normalize import fold
from evisift.session import materialize

# Decisions that leave an item open.
OPEN_DECISIONS = ("defer", "needs_second_review")


def latest_reviews(events: DataFrame) -> DataFrame:
    """Last review of each reviewer per item."""
    cols = ["decision", "category", "mapping", "event_hash", "sequence"]
    return (
        events.filter(F.col("stage") == "review")
        .groupBy("item", "reviewer")
        .agg(F.max_by(F.struct(*cols), "sequence").alias("e"))
        .select("item", "reviewer", "e.*")
    )


def current_adjudications(events: DataFrame, latest: DataFrame) -> DataFrame:
    """Last adjudication per item whose basis is exactly the current set of review hashes.

    The basis is compared by joining its hashes with the current reviews and counting, so no
    item's reviews are gathered into one value.
    """
    adjudications = events.filter(F.col("stage") == "adjudication").select(
        "item", "sequence", "decision", F.array_distinct("basis").alias("basis")
    )
    sizes = latest.groupBy("item").agg(F.count("*").alias("reviews"))
    hits = (
        adjudications.select("item", "sequence", F.explode("basis").alias("event_hash"))
        .join(latest.select("item", "event_hash"), ["item", "event_hash"])
        .groupBy("item", "sequence")
        .agg(F.count("*").alias("hits"))
    )
    current = (
        adjudications.join(sizes, "item", "left")
        .join(hits, ["item", "sequence"], "left")
        .filter(
            (F.size("basis") == F.coalesce("reviews", F.lit(0)))
            & (F.coalesce("hits", F.lit(0)) == F.size("basis"))
        )
    )
    return current.groupBy("item").agg(
        F.max_by("decision", "sequence").alias("final_decision"), F.max("sequence").alias("final_sequence")
    )


def agreement(events: DataFrame) -> DataFrame:
    """State of every item in the log."""
    latest = latest_reviews(events)
    none = F.lit("\u0000")
    per = latest.groupBy("item").agg(
        F.count("*").alias("reviewers"),
        F.count_distinct("decision").alias("_d"),
        F.count_distinct("category").alias("_c"),
        F.count_distinct(F.coalesce("mapping", none)).alias("_m"),
        F.max(F.col("decision").isin(*OPEN_DECISIONS).cast("int")).alias("_open"),
    )
    items = events.select("item").distinct()
    rows = items.join(per, "item", "left").join(current_adjudications(events, latest), "item", "left")
    reviewers = F.coalesce("reviewers", F.lit(0))
    deferred = F.coalesce("_open", F.lit(0)) == 1
    agreed = F.coalesce(
        (reviewers >= 2) & (F.col("_d") == 1) & (F.col("_c") == 1) & (F.col("_m") == 1) & ~deferred,
        F.lit(False),
    )
    final = F.col("final_decision")
    final_open = F.coalesce(final.isin(*OPEN_DECISIONS), F.lit(False))
    return rows.select(
        "item",
        reviewers.alias("reviewers"),
        (reviewers > 0).alias("reviewed"),
        agreed.alias("agreement"),
        ((reviewers >= 2) & ~agreed & ~deferred).alias("disagreement"),
        (deferred | final_open).alias("deferred"),
        final.isNotNull().alias("adjudicated"),
        (~agreed & (final.isNull() | final_open)).alias("unresolved"),
    )


def queue(rows: DataFrame, state: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Items matching accent-insensitive substring filters with their state."""
    kept = rows
    for column, text in filters.items():
        if text:
            kept = kept.filter(F.contains(fold(F.col(column)), fold(F.lit(text))))
    flags = ("reviewed", "agreement", "disagreement", "deferred", "unresolved", "adjudicated")
    joined = kept.join(state, "item", "left")
    return joined.select(
        *rows.columns,
        *[F.coalesce(f, F.lit(f == "unresolved")).alias(f) for f in flags],
    )


def progress(queued: DataFrame) -> DataFrame:
    flags = ("reviewed", "agreement", "disagreement", "deferred", "unresolved", "adjudicated")
    return queued.agg(F.count("*").alias("total"), *[F.count_if(F.col(f)).alias(f) for f in flags])


def export(events: DataFrame, state: DataFrame, kind: str, samples: DataFrame | None = None) -> DataFrame:
    """Slices of the log: individual_decisions, adjudications, summary, disagreements or a control sample."""
    if kind == "individual_decisions":
        return events.filter(F.col("stage") != "adjudication")
    if kind == "adjudications":
        return events.filter(F.col("stage") == "adjudication")
    if kind == "summary":
        return progress(state)
    if kind == "disagreements":
        return events.join(state.filter("disagreement").select("item"), "item", "left_semi")
    if kind == "control" and samples is not None:
        return (
            latest_reviews(events).join(samples.select("item"), "item", "left_semi")
            .groupBy("decision").agg(F.count("*").alias("reviews"))
        )
    raise ValueError(f"unknown export: {kind}")


def current_decisions(events: DataFrame, keys: list[str]) -> DataFrame:
    """Last event per key."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), "sequence").alias("e")).select(*keys, "e.*")


def admissibility(proposals: DataFrame, rows: DataFrame, events: DataFrame) -> DataFrame:
    """Why each proposed decision must be refused; NULL where it may be recorded.

    ``proposals(proposal_id, item, row_id, dataset, reviewer, stage, decision, mapping, comment, basis)``,
    ``rows(item, row_id, code)``.
    """
    latest = latest_reviews(events)
    state = agreement(events).select("item", "reviewers", "agreement")
    current = rows.select("item", F.col("row_id").alias("current_row"), "code")
    own = latest.select("item", "reviewer", F.lit(True).alias("is_reviewer"))
    hits = (
        proposals.select("proposal_id", "item", F.explode(F.array_distinct("basis")).alias("event_hash"))
        .join(latest.select("item", "event_hash"), ["item", "event_hash"])
        .groupBy("proposal_id").agg(F.count("*").alias("hits"))
    )
    joined = (
        proposals.join(current, "item", "left").join(state, "item", "left")
        .join(own, ["item", "reviewer"], "left").join(hits, "proposal_id", "left")
    )
    reviewers = F.coalesce("reviewers", F.lit(0))
    size = F.size(F.array_distinct("basis"))
    fresh = (size == reviewers) & (F.coalesce("hits", F.lit(0)) == size)
    mapped = F.col("dataset") == "mapping"
    adjudicating = F.col("stage") == "adjudication"
    empty = F.coalesce(F.col("comment"), F.lit("")) == ""
    reason = (
        F.when(~F.col("row_id").eqNullSafe(F.col("current_row")), "stale_row")
        .when(
            mapped & (F.col("decision") == "approve")
            & ((F.coalesce("code", F.lit("")) == "") | F.col("mapping").isNull()),
            "approval_needs_code_and_relation",
        )
        .when(~mapped & F.col("mapping").isNotNull(), "relation_not_allowed")
        .when(adjudicating & ((reviewers < 2) | F.coalesce("agreement", F.lit(False))), "needs_two_unresolved_reviews")
        .when(adjudicating & F.coalesce("is_reviewer", F.lit(False)), "adjudicator_not_distinct")
        .when(adjudicating & (~fresh | empty), "needs_current_hashes_and_justification")
        .when(~adjudicating & (F.size("basis") > 0), "review_must_be_independent")
    )
    return joined.select("proposal_id", reason.alias("reason"))


def chain_violations(events: DataFrame, rows: DataFrame, recompute: Column, genesis: str) -> DataFrame:
    """Broken links of an append-only hash chain.

    ``events(sequence, previous_hash, event_hash, row_id, ...)``. Each event is joined with the
    one before it by sequence number, so the log needs no global sort. Hashes are recomputed and rows
    looked up before, so the join carries a sequence number, a hash and two flags; the log is written
    once for both of its sides.
    """
    known = rows.select("row_id").distinct().withColumn("_known", F.lit(True))
    checked = events.select("sequence", "previous_hash", "event_hash", "row_id", (F.col("event_hash") != recompute).alias("_altered"))
    checked = materialize(checked.join(known, "row_id", "left").drop("row_id"), "chain_events")
    before = checked.select((F.col("sequence") + 1).alias("sequence"), F.col("event_hash").alias("expected_previous"))
    joined = checked.drop("event_hash").join(before, "sequence", "left")
    expected = F.when(F.col("sequence") == 1, F.lit(genesis)).otherwise(F.col("expected_previous"))
    problem = (
        F.when(expected.isNull(), "sequence_gap")
        .when(F.col("previous_hash") != expected, "previous_hash")
        .when(F.col("_altered"), "event_hash")
        .when(F.col("_known").isNull(), "unknown_row")
    )
    repeated = checked.groupBy("sequence").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(
        "sequence", F.lit("sequence_repeated").alias("problem")
    )
    return (
        joined.select("sequence", problem.alias("problem")).filter(F.col("problem").isNotNull())
        .unionByName(repeated)
    )

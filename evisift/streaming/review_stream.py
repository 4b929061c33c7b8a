"""Review agreement kept incrementally over an append-only event stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evisift.operators.review import OPEN_DECISIONS

OUTPUT = (
    "item string, reviewers int, reviewed boolean, agreement boolean, disagreement boolean, "
    "deferred boolean, adjudicated boolean, unresolved boolean, sequence bigint"
)
STATE = "payload string"


def _summary(item: str, reviews: dict, adjudications: list, last: int) -> dict:
    values = list(reviews.values())
    open_reviews = any(v["decision"] in OPEN_DECISIONS for v in values)
    same = len({(v["decision"], v["category"], v["mapping"]) for v in values}) == 1
    agreed = len(values) >= 2 and same and not open_reviews
    basis = sorted(v["hash"] for v in values)
    current = [a for a in adjudications if a["basis"] == basis]
    final = max(current, key=lambda a: a["sequence"]) if current else None
    final_open = final is not None and final["decision"] in OPEN_DECISIONS
    return {
        "item": item,
        "reviewers": len(values),
        "reviewed": bool(values),
        "agreement": agreed,
        "disagreement": len(values) >= 2 and not agreed and not open_reviews,
        "deferred": open_reviews or final_open,
        "adjudicated": final is not None,
        "unresolved": not agreed and (final is None or final_open),
        "sequence": last,
    }


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    kept = json.loads(state.get[0]) if state.exists else {"reviews": {}, "adjudications": {}, "last": 0}
    reviews, adjudications, last = kept["reviews"], kept["adjudications"], kept["last"]
    for batch in batches:
        for e in batch.itertuples(index=False):
            last = max(last, int(e.sequence))
            mapping = None if pd.isna(e.mapping) else e.mapping
            if e.stage == "review":
                old = reviews.get(e.reviewer)
                if old is None or old["sequence"] < e.sequence:
                    reviews[e.reviewer] = {
                        "decision": e.decision, "category": e.category, "mapping": mapping,
                        "hash": e.event_hash, "sequence": int(e.sequence),
                    }
            else:
                basis = sorted(set(e.basis)) if e.basis is not None else []
                # only the newest adjudication per basis can ever count
                slot = "|".join(basis)
                old = adjudications.get(slot)
                if old is None or old["sequence"] < e.sequence:
                    adjudications[slot] = {
                        "basis": basis, "decision": e.decision, "sequence": int(e.sequence)
                    }
    state.update((json.dumps({"reviews": reviews, "adjudications": adjudications, "last": last}),))
    yield pd.DataFrame([_summary(key[0], reviews, list(adjudications.values()), last)])


def agreement_stream(events: DataFrame) -> DataFrame:
    """One updated row per item touched by a trigger; ``events`` as in the batch operators."""
    return events.groupBy("item").applyInPandasWithState(
        _update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout
    )

"""Content-hash identities as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(kind: str, *parts: Column | str) -> Column:
    """``kind:`` followed by the SHA-256 of the compact JSON array of the string parts."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.concat(F.lit(f"{kind}:"), F.sha2(F.to_json(F.array(*cols)), 256))


def sorted_hashes_json(hashes: Column) -> Column:
    return F.to_json(F.array_sort(hashes))


def source_assertion_id(
    source: Column, release: Column, hashes: Column, locator: Column, ordinal: Column
) -> Column:
    return stable_id(
        "source_assertion", source, release, sorted_hashes_json(hashes), locator,
        ordinal.cast("string"),
    )


def candidate_assertion_id(
    release: Column, record_id: Column, locator: Column, ordinal: Column
) -> Column:
    return stable_id("candidate_assertion", release, record_id, locator, ordinal.cast("string"))


def signature_json(*pairs: tuple[str, Column]) -> Column:
    """JSON object with keys in sorted order and explicit nulls."""
    ordered = sorted(pairs, key=lambda pair: pair[0])
    return F.to_json(
        F.struct(*[col.alias(name) for name, col in ordered]), {"ignoreNullFields": "false"}
    )


def canonical_assertion_id(
    subject: Column, relation: Column, obj: Column, qualifiers: Column
) -> Column:
    """Semantic signature: equal statements from any source share one id.

    ``obj`` and ``qualifiers`` are structs whose fields are in alphabetical order.
    """
    payload = signature_json(
        ("schema_version", F.lit(2)),
        ("subject_concept_id", subject),
        ("relation", relation),
        ("object", obj),
        ("qualifiers", qualifiers),
    )
    return stable_id("canonical_assertion", payload)


def row_sha(*cols: Column | str) -> Column:
    """Per-row digest used for logical table hashes and duplicate checks."""
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)

"""All registered queries."""

from evisift.plans import q_audit, q_curation, q_family, q_resolve, q_scans, q_search, q_semantic, q_sources, q_text  # noqa: F401
from evisift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

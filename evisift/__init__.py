"""Evidence matching at scale: corpus building, case matching, search and review as Spark jobs."""

__version__ = "0.1.0"

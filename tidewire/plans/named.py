"""All named queries of the news operators, and their SQL."""

from . import intake_queries, monitor_queries, more_queries, story_queries  # noqa: F401  add their queries to the registry
from .queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

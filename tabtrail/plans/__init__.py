"""Named query plans: importing this package registers every query and its oracle."""

from tabtrail.plans import queries_retrieval, queries_sessions, queries_stats  # noqa: F401
from tabtrail.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]

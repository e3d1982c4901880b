"""Registered queries over the given tables, and the SQL each is compared with."""

from driftlake.plans import basics, changes, composites, drifts, models, quality, samples  # noqa: F401
from driftlake.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

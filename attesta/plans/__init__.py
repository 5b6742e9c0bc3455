"""Registered queries with their SQL."""

from attesta.plans import campaigns, composite, studies  # noqa: F401  register their queries
from attesta.plans.catalogue import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

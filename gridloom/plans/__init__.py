"""Queries over tables, by name."""

from gridloom.plans import metadata, planning, raster, rules, streams  # noqa: F401
from gridloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

"""Registered queries, one or more for each operator, and their DuckDB statements."""

from gridframe.plans.registry import ORACLES, QUERIES, flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]

"""Registered queries and their DuckDB equivalents, by name."""

from __future__ import annotations

from strataquery.plans import changes, dependencies, graphs, packets, reads, structure, symbols, text  # noqa: F401  they register their queries
from strataquery.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

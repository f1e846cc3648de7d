"""Queries over the test tables, with the SQL they are held against.

Each module registers its queries; a query without SQL is one that SQL cannot express, or not over whole tables in bearable time: its operator has a
test against plain Python instead.
"""

from __future__ import annotations

from sedimenta.plans import analytics, evidence, further, graphs, ledgers, links, policies, ranking, retrieval, signals, streams, texts  # noqa: F401  (importing registers)
from sedimenta.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

"""Registered queries and the SQL that gives the same rows."""

from __future__ import annotations

from cadenza.plans import interval_queries, report_queries, text_queries, timeline_queries

_PARTS = (interval_queries, timeline_queries, text_queries, report_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}

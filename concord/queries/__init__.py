"""Registered queries over the driver's tables, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from . import concepts, details, documents, event_log, fact_checks, graphs, grids, matches, places, reports, reviews, search, timelines

GROUPS = (search, documents, grids, fact_checks, graphs, event_log, matches, reviews, details, concepts, timelines, places, reports)
QUERIES = {name: query for group in GROUPS for name, query in group.QUERIES.items()}
ORACLES = {name: sql for group in GROUPS for name, sql in group.ORACLES.items()}

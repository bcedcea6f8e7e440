"""Queries over the driver's tables, by inventory id, and their DuckDB twins."""

from __future__ import annotations

from attestor.plans import extended_queries, insight_queries, inventory_queries, relational_queries, scoring_queries, text_queries

FLAGSHIP = "m32_leaderboard"
MODULES = (scoring_queries, insight_queries, relational_queries, text_queries, inventory_queries, extended_queries)
QUERIES = {name: fn for module in MODULES for name, fn in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}

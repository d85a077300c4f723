"""Every registered query of the cube library and the SQL it is held against."""

from __future__ import annotations

from stratacube.jobs import event_queries, series_queries, space_queries, stat_queries, table_queries

_MODULES = (series_queries, event_queries, space_queries, stat_queries, table_queries)
QUERIES: dict = {name: run for m in _MODULES for name, run in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}

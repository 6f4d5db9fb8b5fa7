"""All queries over the given tables, with the SQL that each must agree with."""

from __future__ import annotations

from lapwing.plans import alignment_queries, centerline_queries, corner_queries, curve_queries, ingest_queries, lap_queries, point_queries, score_queries, series_queries, trajectory_queries

_MODULES = (series_queries, lap_queries, point_queries, alignment_queries, trajectory_queries, corner_queries, centerline_queries, score_queries, curve_queries, ingest_queries)

QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}

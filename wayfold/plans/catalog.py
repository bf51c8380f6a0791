"""All queries of the timetable network, and their SQL."""

from __future__ import annotations

from wayfold.plans import compile_queries, filing_queries, geometry_queries, routing_queries, timetable_queries

QUERIES = {**routing_queries.QUERIES, **timetable_queries.QUERIES, **geometry_queries.QUERIES, **compile_queries.QUERIES, **filing_queries.QUERIES}
ORACLE_SQL = {**routing_queries.ORACLE_SQL, **timetable_queries.ORACLE_SQL, **geometry_queries.ORACLE_SQL, **compile_queries.ORACLE_SQL, **filing_queries.ORACLE_SQL}

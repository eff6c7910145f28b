"""Queries bound to tables, with their SQL."""

from . import design_queries, measure_queries, model_queries, source_queries, text_queries

_PARTS = (text_queries, measure_queries, design_queries, source_queries, model_queries)
QUERIES = {k: f for part in _PARTS for k, f in part.QUERIES.items()}
ORACLE_SQL = {k: x for part in _PARTS for k, x in part.SQL.items()}

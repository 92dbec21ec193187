"""Queries of the document-collection operators, by name, and their SQL."""

from . import board_queries, catalog_queries, content_queries, export_queries, extract_queries, hierarchy_queries, output_queries, plane_queries, stream_queries, view_queries

_MODULES = (catalog_queries, content_queries, stream_queries, board_queries, export_queries, hierarchy_queries, plane_queries, output_queries, view_queries, extract_queries)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}

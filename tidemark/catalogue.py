"""Registered queries and their SQL."""

from tidemark.plans import dialect_queries, extract_queries, inventory_queries, inventory_sql, package_queries, profile_queries, request_queries, run_queries, selection_queries, text_queries

PARTS = (inventory_queries, text_queries, extract_queries, dialect_queries, selection_queries, profile_queries, package_queries, run_queries, request_queries)
QUERIES: dict = {name: query for part in PARTS for name, query in part.QUERIES.items()}
SQL: dict = {name: sql for part in (inventory_sql, *PARTS[1:]) for name, sql in part.SQL.items()}

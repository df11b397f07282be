"""Registered queries over the shared tables, and the SQL that gives the same rows."""

from __future__ import annotations

from residua.plans import catalog_features, catalog_models, catalog_structures, catalog_tables

QUERIES: dict = {}
SQL: dict[str, str] = {}
for part in (catalog_features, catalog_models, catalog_structures, catalog_tables):
    QUERIES |= part.QUERIES
    SQL |= part.SQL

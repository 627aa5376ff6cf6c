"""All queries of the library and their SQL."""

from __future__ import annotations

from ranklake.plans import dense, records, stores, text

QUERIES = dense.QUERIES | text.QUERIES | records.QUERIES | stores.QUERIES
SQL = dense.SQL | text.SQL | records.SQL | stores.SQL

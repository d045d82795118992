"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from . import queries, queries_feeds  # noqa: F401  (which adds its own)

QUERIES, SQL = queries.QUERIES, queries.SQL

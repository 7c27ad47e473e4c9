"""Queries over the test tables, by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from tidewater.plans import archive_queries, message_queries, stream_queries, text_queries, window_queries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _part in (text_queries, message_queries, archive_queries, stream_queries, window_queries):
    QUERIES |= _part.QUERIES
    ORACLE |= _part.ORACLE

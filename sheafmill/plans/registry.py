"""All queries of the library by name, with the SQL that an independent engine checks them by."""

from __future__ import annotations

from sheafmill.plans import assist, curation, dashboard, ledger, lists, retrieval, segments, streams, texts

PARTS = (retrieval, ledger, dashboard, curation, texts, streams, assist, lists, segments)
QUERIES: dict = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in PARTS for name, sql in part.ORACLE.items()}

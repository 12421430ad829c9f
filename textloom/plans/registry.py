"""All queries of the engine and their SQL."""

from __future__ import annotations

from textloom.plans import file_queries, page_queries, relational_queries, text_queries

QUERIES: dict = {**page_queries.QUERIES, **text_queries.QUERIES, **relational_queries.QUERIES, **file_queries.QUERIES}
ORACLE_SQL: dict = {**page_queries.ORACLE_SQL, **text_queries.ORACLE_SQL, **relational_queries.ORACLE_SQL, **file_queries.ORACLE_SQL}

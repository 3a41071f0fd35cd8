"""All registered queries of the library and the SQL that states the same results."""

from __future__ import annotations

from .plans import more, retrieval, studies, tables

QUERIES: dict = {**retrieval.QUERIES, **tables.QUERIES, **more.QUERIES, **studies.QUERIES}
ORACLE_SQL: dict = {**retrieval.ORACLE_SQL, **tables.ORACLE_SQL, **more.ORACLE_SQL, **studies.ORACLE_SQL}

"""All queries over the driver tables, with the SQL that DuckDB runs for each."""

from __future__ import annotations

from . import calendar, records, search, texts

QUERIES: dict = {**search.QUERIES, **records.QUERIES, **calendar.QUERIES, **texts.QUERIES}
ORACLE_SQL: dict = {**search.ORACLE_SQL, **records.ORACLE_SQL, **calendar.ORACLE_SQL, **texts.ORACLE_SQL}

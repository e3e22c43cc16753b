"""Corpus queries that SQL can express give the rows that DuckDB gives."""

import duckdb
import pytest

from marlstone.llm import oracles, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    expected = duck.sql(queries.ORACLE_SQL[name])
    assert columns == sorted(expected.columns)
    plain = lambda v: round(v, 5) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    at = [expected.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in expected.fetchall()), key=repr)


def test_letters_are_spelled_out():
    assert oracles._portable("(?i)(ab|api_?key)\\x20*[A-Za-z]+") == "([Aa][Bb]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])\\x20*[A-Za-z]+"
    assert oracles._portable("AKIA") == "AKIA"

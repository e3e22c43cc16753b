"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from marlstone.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    assert len(set(df.columns)) == len(df.columns)
    if name in catalogue.ORACLE_SQL:
        expected = duck.sql(catalogue.ORACLE_SQL[name])
        assert sorted(df.columns) == sorted(expected.columns)
        assert got == rows(expected.columns, expected.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 30
    assert set(entry.oracle_sql()) <= set(entry.queries())

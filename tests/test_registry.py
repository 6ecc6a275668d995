"""The entry module: every registered query runs, and equals its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as registry
from lakelens import catalog
from tests.conftest import TINY

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    df = catalog.QUERIES[name](spark, TINY)
    got = df.collect()
    assert got, name
    if name in catalog.ORACLES:
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
        found = con.execute(catalog.ORACLES[name])
        columns = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows_of(df.columns, got) == rows_of(columns, found.fetchall())


def test_entry(spark):
    assert registry.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries())

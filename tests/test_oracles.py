"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from polycurate.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(small):
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return connection


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, str):
        return v
    return round(float(v), 5)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, small, db, name):
    frame = catalog.QUERIES[name](spark, small)
    columns = sorted(frame.columns)
    relation = db.sql(catalog.ORACLES[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    key = lambda row: tuple(map(str, row))
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=key)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=key)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["reason", "subset", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

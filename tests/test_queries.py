"""Every query of the library proper against its SQL twin."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from aircensus.plans import queries

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def rows(frame):
    plain = lambda v: "NULL" if pd.isna(v) else str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(tuple(map(plain, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


def test_every_query_has_a_twin():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), oracle.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0

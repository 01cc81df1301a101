"""Every registered query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from sparklogs.plans import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(frame, columns):
    show = lambda v: v if isinstance(v, str) else "" if pd.isna(v) else str(int(v))
    return sorted(tuple(show(v) for v in r) for r in frame[columns].itertuples(index=False))


def test_all_have_sql():
    assert queries.queries().keys() == oracles.oracle_sql().keys()


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), duck.execute(oracles.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(oracles.oracle_sql()) <= set(__spark_entry__.queries())

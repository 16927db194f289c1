"""Every registered query with SQL gives DuckDB's rows at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from quire.plans.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


def rows(frame: pd.DataFrame) -> list:
    def plain(v):
        if v is None or v is pd.NaT or v != v:
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(v, 6) if isinstance(v, float) else v

    columns = sorted(frame.columns)
    return sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, want = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    assert len(got)

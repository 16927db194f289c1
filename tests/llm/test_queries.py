"""The registered queries over the smallest tables, against their SQL where there is one."""

import os

import duckdb
import pytest

from quire.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.mark.parametrize("name", sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])))
def test_query(spark, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert len(got)
    if name in SQL:
        con = duckdb.connect()
        for t in ("documents", "conversations"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        want, columns = con.sql(SQL[name]).df(), sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = lambda f: sorted(f[columns].itertuples(index=False, name=None))
        assert rows(got) == rows(want)


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))

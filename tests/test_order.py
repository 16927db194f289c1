"""Reading order where rounding could decide."""

import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from quire.operators import assembly as A
from quire.plans.queries import QUERIES, SQL


def test_runs_of_one_slanted_line_have_one_place(spark):
    runs = [(x * 60 + y, float(x), float(y)) for x in range(60) for y in range(60)]
    frame = spark.createDataFrame(runs, "emit_idx long, x double, y double").selectExpr("1 AS doc_id", "0 AS page_index", "*", "1.0D AS dx", "1.0D AS dy", "false AS vertical")
    for r in A.oriented(frame).collect():
        assert (r.along, r.across) == ((r.x + r.y) / math.sqrt(2), (r.y - r.x) / math.sqrt(2))


def test_an_end_just_at_the_margin_is_no_overrun(spark, tmp_path):
    """Orders of one customer whose slanted segments end exactly an anchor's width before the margin."""
    keys = [14409195, 14423938, 14429477, 14438205, 14481619, 14484360, 14491602, 14492620, 14498182, 14500008, 14503394, 14507479, 14508576, 14539125, 14547430]
    pq.write_table(pa.table({"o_orderkey": keys, "o_custkey": [143903] * len(keys)}), tmp_path / "orders.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got = QUERIES["band_columns"](spark, str(tmp_path)).toPandas()
    want = con.sql(SQL["band_columns"]).df()[list(got.columns)]
    rows = lambda f: sorted(tuple(r) for r in f.astype(int).itertuples(index=False, name=None))
    assert rows(got) == rows(want)

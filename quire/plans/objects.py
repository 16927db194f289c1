"""Object tables, trees, metadata, fonts and codecs."""

from __future__ import annotations

import base64
import zlib
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import structure as D
from ..shared import pieces, spread
from ..sources import codecs as C
from .registry import query


@query(
    """WITH e AS (SELECT user_id % 400 AS obj, CAST(epoch(date_trunc('day', ts)) AS BIGINT) AS section, event_id * 7919 % 10000 AS off FROM events),
            r AS (SELECT *, row_number() OVER (PARTITION BY obj ORDER BY section DESC, off DESC) AS r FROM e)
       SELECT obj AS obj_num, section, off + 15 AS "offset" FROM r WHERE r = 1 AND off + 15 < 9000"""
)
def xref_merge(t):
    day = F.unix_seconds(F.date_trunc("day", "ts"))
    entries = t.events.select((F.col("user_id") % 400).alias("obj_num"), day.alias("section"), (-day).alias("rank"), (F.col("event_id") * 7919 % 10000).alias("offset"))
    return D.valid_entries(D.first_wins(entries, ["obj_num"], "rank", "offset"), F.lit(15), F.lit(9000)).drop("rank")


@query("SELECT user_id AS obj_num, max(event_id) AS \"offset\", arg_max(event_type, event_id) AS kind FROM events GROUP BY user_id")
def recovery_latest(t):
    return D.latest_wins(t.events.select(F.col("user_id").alias("obj_num"), F.col("event_id").alias("offset"), F.col("event_type").alias("kind")), ["obj_num"], "offset", ["kind"])


@query(
    """WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 <> 0 THEN p_partkey - p_partkey % 3 - 1 END AS nx FROM part),
            m AS (SELECT id, CASE WHEN nx IN (SELECT id FROM n) THEN nx END AS nx FROM n),
            w AS (SELECT id, id AS pos, 0 AS hops FROM m UNION ALL SELECT w.id, m.nx, w.hops + 1 FROM w JOIN m ON m.id = w.pos WHERE m.nx IS NOT NULL AND w.hops < 40)
       SELECT id, CASE WHEN hops <= 32 THEN pos END AS target, CASE WHEN hops <= 32 THEN CAST(hops AS INTEGER) END AS hops
       FROM (SELECT id, arg_max(pos, hops) AS pos, max(hops) AS hops FROM w GROUP BY id)"""
)
def ref_chain(t):
    k = F.col("p_partkey")
    nodes = t.part.select(k.alias("id"), F.when(k % 10 != 0, k - k % 3 - 1).alias("next"))
    known = nodes.select(F.col("id").alias("next"), F.lit(True).alias("ok"))
    nodes = nodes.join(known, "next", "left").select("id", F.when(F.col("ok"), F.col("next")).alias("next"))
    return D.follow(nodes)


@query(
    """WITH c AS (SELECT r_regionkey, n_nationkey, c_custkey, n_nationkey % 4 * 90 AS nr, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 360 END AS cr, CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS BIGINT) END AS nm, CASE WHEN c_custkey % 5 = 0 THEN c_custkey END AS cm
                  FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey)
       SELECT CAST(r_regionkey AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey, c_custkey) - 1 AS INTEGER) AS page_index, c_custkey AS child, coalesce(cm, nm, 7) AS media, CAST(coalesce(cr, nr) AS BIGINT) AS rotate FROM c"""
)
def page_tree(t):
    doc = F.col("r_regionkey").cast("bigint")
    big = lambda c: c.cast("bigint")
    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    n, c = big(F.col("n_nationkey")), F.col("c_custkey")
    inner = nation.select(doc.alias("doc_id"), F.lit(-1).cast("bigint").alias("parent"), n.alias("ordinal"), (-n - 2).alias("child"), F.lit(False).alias("leaf"), F.when(n % 2 == 0, n).alias("media"), (n % 4 * 90).alias("rotate"))
    leaves = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    leaves = leaves.select(doc.alias("doc_id"), (-n - 2).alias("parent"), c.alias("ordinal"), c.alias("child"), F.lit(True).alias("leaf"), F.when(c % 5 == 0, c).alias("media"), F.when(c % 3 == 0, c % 360).alias("rotate"))
    roots = t.region.select(doc.alias("doc_id"), F.lit(-1).cast("bigint").alias("child"), F.lit(7).cast("bigint").alias("media"), F.lit(None).cast("bigint").alias("rotate"))
    return D.flatten_tree(t.spark, inner.unionByName(leaves), roots)


@query("SELECT CAST(r_regionkey AS BIGINT) AS doc_id, count(*) AS page_count FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def page_count(t):
    return page_tree(t).groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))


@query(
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(CASE WHEN d.doc_id % 3 <> 0 THEN d.lang END, CAST(l.quality AS VARCHAR)) AS title, coalesce(CASE WHEN d.doc_id % 4 <> 0 THEN d.source END, CAST(l.toxic AS VARCHAR)) AS author
       FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id"""
)
def metadata_merge(t):
    info = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("title"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("author"))
    xmp = t.labels.select("doc_id", F.col("quality").cast("string").alias("title"), F.col("toxic").cast("string").alias("author"))
    return D.merged_metadata(info, xmp)


@query(
    """WITH d AS (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 6 AS k FROM orders)
       SELECT o_orderkey, CASE k WHEN 0 THEN date_trunc('day', d) + INTERVAL 5 HOUR WHEN 1 THEN date_trunc('month', d) WHEN 2 THEN date_trunc('year', d) WHEN 3 THEN date_trunc('day', d) + INTERVAL 12 HOUR - INTERVAL 90 MINUTE WHEN 4 THEN date_trunc('year', d) ELSE CAST(NULL AS TIMESTAMP) END AS parsed FROM d"""
)
def pdf_dates(t):
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    at = lambda f: F.date_format(d, f)
    text = (
        F.when(k == 0, F.concat(F.lit("D:"), at("yyyyMMdd"), F.lit("050000Z")))
        .when(k == 1, F.concat(F.lit("D:"), at("yyyyMM")))
        .when(k == 2, at("yyyy"))
        .when(k == 3, F.concat(F.lit("D:"), at("yyyyMMdd"), F.lit("120000+01'30'")))
        .when(k == 4, F.concat(F.lit("D:"), at("yyyy"), F.lit("1305")))
        .otherwise(F.lit("D:19"))
    )
    return t.orders.select("o_orderkey", D.parsed_date(text).cast("timestamp_ntz").alias("parsed"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '1.' || p_size % 10 WHEN p_size % 10 >= p_partkey % 12 THEN '1.' || p_size % 10 ELSE '1.' || p_partkey % 12 END AS version FROM part")
def version_max(t):
    a = F.concat(F.lit("1."), (F.col("p_size") % 10).cast("string"))
    b = F.when(F.col("p_partkey") % 7 == 0, "1.x").otherwise(F.concat(F.lit("1."), (F.col("p_partkey") % 12).cast("string")))
    return t.part.select("p_partkey", D.greatest_version(a, b).alias("version"))


@query(
    """SELECT o_orderkey AS key, arg_max(p_partkey, p_partkey) AS value FROM orders LEFT JOIN part ON o_orderkey % 13 = p_partkey % 13 AND o_orderkey BETWEEN p_partkey * 20 AND p_partkey * 20 + p_size * 15 GROUP BY ALL HAVING arg_max(p_partkey, p_partkey) IS NOT NULL"""
)
def named_dest(t):
    keys = t.orders.select((F.col("o_orderkey") % 13).alias("font"), F.col("o_orderkey").alias("key"))
    k = F.col("p_partkey")
    ranges = t.part.select((k % 13).alias("font"), (k * 20).alias("lo"), (k * 20 + F.col("p_size") * 15).alias("hi"), k.alias("value"))
    return D.in_ranges(keys, ranges, ["font"], "key", "value", True).select("key", "value").where("value is not null")


@query(
    """SELECT o_orderkey AS cid, coalesce(arg_max(p_size, p_partkey), 1000) AS width FROM orders LEFT JOIN part ON o_orderkey BETWEEN p_partkey * 9 AND p_partkey * 9 + p_size GROUP BY o_orderkey"""
)
def cid_width(t):
    keys = t.orders.select(F.col("o_orderkey").alias("cid"))
    k = F.col("p_partkey")
    ranges = t.part.select((k * 9).alias("lo"), (k * 9 + F.col("p_size")).alias("hi"), F.col("p_size").alias("value"), k.alias("seq"))
    out = D.in_ranges(keys, ranges, [], "cid", "seq", True)
    return out.select("cid", F.coalesce("value", F.lit(1000)).alias("width"))


@query(
    """SELECT DISTINCT p_partkey, CASE p_partkey % 4 WHEN 0 THEN chr(CAST(65 + p_partkey % 26 AS INTEGER)) WHEN 1 THEN chr(CAST(256 + p_partkey % 700 AS INTEGER))
              WHEN 2 THEN CASE p_partkey % 5 WHEN 0 THEN 'é' WHEN 1 THEN 'Ö' WHEN 2 THEN 'ß' WHEN 3 THEN '“' ELSE 'š' END ELSE NULL END AS text FROM part"""
)
def glyph_lookup(t):
    from ..sources.content import GLYPHS

    k = F.col("p_partkey")
    known = F.array(*map(F.lit, ("eacute", "Odieresis", "germandbls", "quotedblleft", "scaron")))
    name = (
        F.when(k % 4 == 0, F.char((k % 26 + 65).cast("int")))
        .when(k % 4 == 1, F.concat(F.lit("uni"), F.lpad(F.hex(k % 700 + 256), 4, "0")))
        .when(k % 4 == 2, F.element_at(known, (k % 5 + 1).cast("int")))
        .otherwise(F.lit("nothing"))
    )
    return t.part.select("p_partkey", D.glyph_unicode(name, GLYPHS).alias("text"))


@query(
    """WITH i AS (SELECT p_partkey % 10 AS font, row_number() OVER (PARTITION BY p_partkey % 10 ORDER BY p_partkey) AS seq, CASE WHEN p_size % 6 = 0 THEN p_partkey % 250 END AS num, CASE WHEN p_size % 6 <> 0 THEN 'g' || p_partkey END AS glyph FROM part),
            g AS (SELECT *, count(num) OVER (PARTITION BY font ORDER BY seq) AS grp FROM i),
            s AS (SELECT *, first_value(num) OVER (PARTITION BY font, grp ORDER BY seq) AS start, row_number() OVER (PARTITION BY font, grp ORDER BY seq) AS n FROM g WHERE grp > 0),
            c AS (SELECT font, CAST(start + n - 2 AS INTEGER) AS code, glyph, seq FROM s WHERE glyph IS NOT NULL),
            o AS (SELECT font, code, arg_max(glyph, seq) AS glyph FROM c WHERE code BETWEEN 0 AND 255 GROUP BY ALL),
            b AS (SELECT font, CAST(code AS INTEGER) AS code, chr(CAST(code AS INTEGER)) AS glyph FROM (SELECT DISTINCT font FROM i), (SELECT unnest(range(65, 91)) AS code))
       SELECT font, code, coalesce(o.glyph, b.glyph) AS glyph FROM o FULL JOIN b USING (font, code)"""
)
def encoding_differences(t):
    from pyspark.sql.window import Window as W

    k = F.col("p_partkey")
    number = F.when(F.col("p_size") % 6 == 0, k % 250)
    items = t.part.select((k % 10).alias("font"), F.row_number().over(W.partitionBy(k % 10).orderBy(k)).alias("seq"), number.alias("number"), F.when(number.isNull(), F.concat(F.lit("g"), k.cast("string"))).alias("glyph"))
    base = t.spark.range(65, 91).select(F.col("id").cast("int").alias("code"), F.char(F.col("id").cast("int")).alias("glyph"))
    return D.overlaid_encoding(items, base)


@query("SELECT doc_id, md5(text) AS digest FROM documents")
def hex_roundtrip(t):
    def loose(x):
        digits = x.hex().upper().encode()
        return b"\n ".join(digits[k : k + 40] for k in range(0, len(digits), 40)) + b">junk"

    return _round_trip(t, loose, lambda x, n: C.ascii_hex(x))


@query("WITH d AS (SELECT l_orderkey, l_partkey, l_suppkey, sum(l_suppkey % 256) OVER (PARTITION BY l_orderkey % 100 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) % 256 AS v FROM lineitem) SELECT l_orderkey, sum(v)::BIGINT AS total FROM d GROUP BY l_orderkey")
def tiff_predictor(t):
    """One row of samples for each hundredth of the orders, stored as differences and summed up again."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

    def run(table):
        table = table.sort_by([(c, "ascending") for c in order])
        stored = (table["l_suppkey"].to_numpy() % 256).astype(np.uint8)
        samples = np.frombuffer(C.predictor(stored.tobytes(), {"Predictor": 2, "Columns": len(stored)}), np.uint8)
        return pa.table({"l_orderkey": table["l_orderkey"].cast(pa.int64()), "v": samples.astype(np.int64)})

    parts = t.lineitem.select(*order, (F.col("l_orderkey") % 100).alias("part"))
    return parts.groupBy("part").applyInArrow(run, "l_orderkey bigint, v bigint").groupBy("l_orderkey").agg(F.sum("v").alias("total"))


def _round_trip(t, encode, decode):
    def run(batches):
        for batch in pieces(batches):
            digests = [md5(decode(encode(x), len(x))).hexdigest() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], ["doc_id", "digest"])

    return spread(t.documents.select("doc_id", F.encode("text", "UTF-8").alias("b"))).mapInArrow(run, "doc_id bigint, digest string")


_DIGEST = "SELECT doc_id, md5(text) AS digest FROM documents"


@query(_DIGEST)
def flate_roundtrip(t):
    return _round_trip(t, lambda x: b"\r\n" + zlib.compress(x), lambda x, n: C.flate(x))


@query(_DIGEST)
def lzw_roundtrip(t):
    return _round_trip(t, C.lzw_encode, lambda x, n: C.lzw(x))


@query(_DIGEST)
def a85_roundtrip(t):
    return _round_trip(t, lambda x: base64.a85encode(x, wrapcol=70, adobe=True), lambda x, n: C.ascii85(x))


@query(_DIGEST)
def rle_roundtrip(t):
    return _round_trip(t, C.run_length_encode, lambda x, n: C.run_length(x))


@query(_DIGEST)
def png_roundtrip(t):
    return _round_trip(t, lambda x: C.png_encode(x, 31), lambda x, n: C.predictor(x, {"Predictor": 15, "Columns": 31})[:n])


@query(
    r"""SELECT doc_id, CAST(doc_id % 9 AS INTEGER) AS header_offset, CASE WHEN doc_id % 5 = 0 THEN '1.4' ELSE '1.' || (doc_id % 8) END AS version, doc_id % 3 <> 0 AS has_end, doc_id * 3 AS startxref FROM documents"""
)
def header_scan(t):
    k = F.col("doc_id")
    version = F.when(k % 5 == 0, "x.y").otherwise(F.concat(F.lit("1."), (k % 8).cast("string")))
    end = F.when(k % 3 != 0, "%%EOF\n").otherwise("")
    body = F.concat(F.repeat(F.lit(" "), (k % 9).cast("int")), F.lit("%PDF-"), version, F.lit("\n"), F.col("text"), F.lit("\nstartxref\n1\nstartxref\n"), (k * 3).cast("string"), F.lit("\n"), end)
    return D.header_facts(t.documents.select("doc_id", F.encode(body, "UTF-8").alias("content")))

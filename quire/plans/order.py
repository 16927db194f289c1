"""Reading order of positioned runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assembly as A
from .registry import query


def runs(t):
    """Order lines as runs: a page of each customer, places from keys."""
    k = F.col("o_orderkey")
    return t.orders.select(
        F.col("o_custkey").alias("doc_id"), F.lit(0).alias("page_index"), k.alias("emit_idx"), F.concat(F.lit("r"), k.cast("string")).alias("text"),
        (k * 37 % 400).cast("double").alias("x"), (k * 53 % 60).cast("double").alias("y"), F.lit(1.0).alias("dx"), F.when(k % 10 == 0, 1.0).otherwise(0.0).alias("dy"),
        (F.lit(8) + k % 3 * 2).cast("double").alias("size"), (F.lit(20) + k % 60).cast("double").alias("width"), (k % 23 == 0).alias("vertical"),
    )


_RUNS = """
        o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, CAST(o_orderkey * 37 % 400 AS DOUBLE) AS x, CAST(o_orderkey * 53 % 60 AS DOUBLE) AS y, CAST(8 + o_orderkey % 3 * 2 AS DOUBLE) AS size, CAST(20 + o_orderkey % 60 AS DOUBLE) AS width,
                     CASE WHEN o_orderkey % 23 = 0 THEN 0 WHEN o_orderkey % 10 = 0 THEN 45 ELSE 0 END AS angle, o_orderkey % 23 = 0 AS vertical, o_orderkey % 10 = 0 AS skew FROM orders),
        u AS (SELECT *, CASE WHEN skew THEN (x + y) / sqrt(2) ELSE x END AS along, CASE WHEN skew THEN (y - x) / sqrt(2) ELSE y END AS across FROM o),
        c AS (SELECT *, row_number() OVER w AS cp, coalesce(across - lag(across) OVER w <= 0.5 * least(size, lag(size) OVER w), false) AS near FROM u WINDOW w AS (PARTITION BY doc_id, angle, vertical ORDER BY across, k)),
        v AS (SELECT *, sum(CASE WHEN near THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, angle, vertical ORDER BY across, k ROWS UNBOUNDED PRECEDING) AS up, min(k) OVER (PARTITION BY doc_id, angle, vertical) AS cf FROM c),
        l AS (SELECT *, CAST(max(up) OVER (PARTITION BY doc_id, angle, vertical) - up AS INTEGER) AS line_no FROM v),
        n AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, angle, vertical, line_no ORDER BY along, cp) - 1 AS INTEGER) AS line_pos FROM l),
        g AS (SELECT *, along - (lag(along) OVER w + lag(width) OVER w) AS gap, least(size, lag(size) OVER w) AS sm FROM n WINDOW w AS (PARTITION BY doc_id, angle, vertical, line_no ORDER BY line_pos)),
        s AS (SELECT *, coalesce(gap > 0.15 * sm, false) AS space, CAST(sum(CASE WHEN coalesce(gap > 1.0 * sm, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, angle, vertical, line_no ORDER BY line_pos ROWS UNBOUNDED PRECEDING) AS INTEGER) AS segment_no FROM g),
        seg AS (SELECT doc_id, angle, vertical, line_no, segment_no, min(along) AS a, max(along + width) AS b, max(size) AS size, min(k) AS k FROM s GROUP BY ALL)"""
_KEY = "doc_id, CAST(angle AS INTEGER) AS angle, vertical"


@query(f"WITH {_RUNS} SELECT {_KEY}, k AS emit_idx, line_no, line_pos FROM n")
def line_cluster(t):
    return A.lines(runs(t)).select("doc_id", "angle", "vertical", "emit_idx", "line_no", "line_pos")


@query(f'WITH {_RUNS} SELECT {_KEY}, line_no, segment_no, round(a, 6) AS start, round(b, 6) AS "end" FROM seg')
def segments(t):
    out = A.segments(A.spaced(A.lines(runs(t))))
    return out.select("doc_id", "angle", "vertical", "line_no", "segment_no", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query(
    f"""WITH {_RUNS}, w AS (SELECT *, CASE WHEN coalesce(lag(cf) OVER o <> cf OR lag(line_no) OVER o <> line_no, false) THEN chr(10) WHEN space THEN ' ' ELSE '' END AS sep FROM s WINDOW o AS (PARTITION BY doc_id ORDER BY cf, line_no, line_pos))
        SELECT doc_id, string_agg(sep || 'r' || k, '' ORDER BY cf, line_no, line_pos) AS text, count(*) AS n_runs FROM w GROUP BY doc_id"""
)
def space_join(t):
    return A.page_texts(runs(t)).select("doc_id", "text", F.size("runs").cast("bigint").alias("n_runs"))


@query(
    f"""WITH {_RUNS}, q AS (SELECT doc_id, angle, vertical, list_sort(list(a)) AS s, list_sort(list(b)) AS e, median(size) * 3 AS anchor, count(DISTINCT line_no) AS n FROM seg GROUP BY ALL),
        r AS (SELECT *, s[CAST(round(0.05 * (len(s) - 1)) AS INTEGER) + 1] AS lft, e[CAST(round(0.95 * (len(e) - 1)) AS INTEGER) + 1] AS rgt FROM q)
        SELECT {_KEY}, round(lft, 6) AS "left", round(rgt, 6) AS "right", anchor FROM r WHERE n > 1 AND rgt > lft"""
)
def column_bounds(t):
    out = A.class_bounds(A.segments(A.spaced(A.lines(runs(t)))))
    return out.select("doc_id", "angle", "vertical", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), "anchor")


@query(
    f"""WITH {_RUNS}, h AS (SELECT doc_id, angle, vertical, line_no, sum(width) / (max(along + width) - min(along)) AS share FROM s GROUP BY ALL),
        q AS (SELECT doc_id, angle, vertical, list_sort(list(share)) AS v FROM h GROUP BY ALL)
        SELECT {_KEY}, v[CAST(round(0.25 * (len(v) - 1)) AS INTEGER) + 1] >= 0.5 AS reliable FROM q"""
)
def advance_gate(t):
    return A.reliable_advances(A.lines(runs(t))).drop("page_index")


@query(
    """SELECT o_custkey, v[CAST(round(0.3 * (len(v) - 1)) AS INTEGER) + 1] AS p30, median(o_totalprice) AS mid
       FROM (SELECT o_custkey, list_sort(list(o_totalprice) OVER (PARTITION BY o_custkey)) AS v, o_totalprice FROM orders) GROUP BY o_custkey, v"""
)
def percentile_ref(t):
    return t.orders.groupBy("o_custkey").agg(A.reference_percentile(F.collect_list("o_totalprice"), 0.3).alias("p30"), F.median("o_totalprice").alias("mid"))


def intervals(t):
    k = F.col("o_orderkey")
    return t.orders.select((F.col("o_custkey") % 97).alias("page"), (k * 37 % 1000).cast("double").alias("start"), (k * 37 % 1000 + 5 + k % 40).cast("double").alias("end"))


_SWEEP = """
        i AS (SELECT o_custkey % 97 AS page, CAST(o_orderkey * 37 % 1000 AS DOUBLE) AS a, CAST(o_orderkey * 37 % 1000 + 5 + o_orderkey % 40 AS DOUBLE) AS b FROM orders),
        ev AS (SELECT page, x, kind, sum(d) AS d FROM (SELECT page, a AS x, 1 AS kind, 1 AS d FROM i UNION ALL SELECT page, b, 0, -1 FROM i) GROUP BY ALL),
        cv AS (SELECT *, sum(d) OVER (PARTITION BY page ORDER BY x, kind ROWS UNBOUNDED PRECEDING) AS cover FROM ev)"""


@query(
    f"""WITH {_SWEEP}, tr AS (SELECT * FROM cv WHERE (cover <= 0) <> (cover - d <= 0)), sp AS (SELECT page, x, cover, lead(x) OVER (PARTITION BY page ORDER BY x, kind) AS nx FROM tr)
        SELECT page, x AS "from", nx AS "to" FROM sp WHERE cover <= 0 AND nx IS NOT NULL AND nx - x >= 2"""
)
def gutter_sweep(t):
    return A.gutters(intervals(t), ["page"], 0, F.lit(2.0))


@query(f"WITH {_SWEEP} SELECT page, CAST(max(cover) AS BIGINT) AS peak FROM cv GROUP BY page")
def peak_coverage(t):
    return A.peak_coverage(intervals(t), ["page"])


@query(
    f"""WITH {_SWEEP}, pk AS (SELECT page, greatest(1, floor(max(cover) / 2)) AS most FROM cv GROUP BY page),
        tl AS (SELECT page, t FROM pk, (SELECT unnest([0, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512]) AS t) WHERE t < most UNION SELECT page, most FROM pk),
        tr AS (SELECT cv.*, t FROM cv JOIN tl USING (page) WHERE (cover <= t) <> (cover - d <= t)), sp AS (SELECT page, t, x, cover, lead(x) OVER (PARTITION BY page, t ORDER BY x, kind) AS nx FROM tr),
        ok AS (SELECT * FROM sp WHERE cover <= t AND nx IS NOT NULL AND nx - x >= 8)
        SELECT page, CAST(t AS INTEGER) AS tolerance, x AS "from", nx AS "to" FROM ok WHERE t = (SELECT min(t) FROM ok o WHERE o.page = ok.page)"""
)
def tolerance_escalation(t):
    return A.tolerant_gutters(intervals(t), ["page"], F.lit(8.0))


@query(
    f"""WITH {_RUNS}, q AS (SELECT doc_id, angle, vertical, list_sort(list(a)) AS sa, list_sort(list(b)) AS sb, median(size) * 3 AS anchor, count(DISTINCT line_no) AS n FROM seg GROUP BY ALL),
        bd AS (SELECT *, sb[CAST(round(0.95 * (len(sb) - 1)) AS INTEGER) + 1] AS rgt, sa[CAST(round(0.05 * (len(sa) - 1)) AS INTEGER) + 1] AS lft FROM q),
        m AS (SELECT seg.*, CASE WHEN bd.n > 1 AND rgt > lft THEN anchor END AS anchor, CASE WHEN bd.n > 1 AND rgt > lft THEN rgt END AS rgt, a < 130.5 AND b > 130.5 OR a < 260.5 AND b > 260.5 AS crosses, (CASE WHEN a > 130.5 THEN 1 ELSE 0 END) + (CASE WHEN a > 260.5 THEN 1 ELSE 0 END) AS sc
              FROM seg JOIN bd USING (doc_id, angle, vertical)),
        e AS (SELECT *, min(CASE WHEN NOT crosses THEN a END) OVER (PARTITION BY doc_id, angle, vertical, sc) AS edge FROM m),
        r AS (SELECT *, crosses AND coalesce(abs(a - edge) <= anchor AND NOT abs(b - rgt) <= anchor, false) AS overrun FROM e),
        p AS (SELECT *, bool_or(crosses AND NOT overrun) OVER (PARTITION BY doc_id, angle, vertical, line_no) AS parts FROM r),
        ln AS (SELECT DISTINCT doc_id, angle, vertical, line_no, parts FROM p),
        fl AS (SELECT *, coalesce(lag(parts) OVER (PARTITION BY doc_id, angle, vertical ORDER BY line_no) <> parts, false) AS f FROM ln),
        bn AS (SELECT *, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, angle, vertical ORDER BY line_no) AS band FROM fl)
        SELECT p.doc_id, CAST(p.angle AS INTEGER) AS angle, p.vertical, p.line_no, p.segment_no, CAST(band AS INTEGER) AS band,
               CAST(CASE WHEN p.parts THEN 0 WHEN overrun THEN sc ELSE (CASE WHEN (a + b) / 2 > 130.5 THEN 1 ELSE 0 END) + (CASE WHEN (a + b) / 2 > 260.5 THEN 1 ELSE 0 END) END AS INTEGER) AS col, crosses, overrun
        FROM p JOIN bn ON p.doc_id = bn.doc_id AND p.angle = bn.angle AND p.vertical = bn.vertical AND p.line_no = bn.line_no"""
)
def band_columns(t):
    segs = A.segments(A.spaced(A.lines(runs(t))))
    cuts = segs.select(*A.CLASS).distinct().withColumn("centres", F.array(F.lit(130.5), F.lit(260.5)))
    out = A.reading_positions(segs, A.class_bounds(segs), cuts)
    return out.select("doc_id", "angle", "vertical", "line_no", "segment_no", F.col("read_pos.band").alias("band"), F.col("read_pos.col").alias("col"), "crosses", "overrun")


@query()
def page_text_columns(t):
    """Page texts with detected columns; the merging of narrow columns is a fixpoint, so rows only."""
    return A.page_texts(runs(t), columns=True).select("doc_id", "text", F.size("runs").alias("n_runs"))

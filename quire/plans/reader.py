"""Pointers and selections on real runs, prefetching, caches, kept state, and documents of other shapes."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import caches, exchange
from ..operators import layout as Y
from ..operators import marks as M
from ..operators import pointer as P
from ..operators import selection as L
from ..operators import structure as D
from ..shared import pieces, spread
from ..sources import frames as R
from ..sources.content import CidMap
from ..sources.cos import Reader
from .files import _LINES as _SPLIT
from .objects import _DIGEST, _round_trip
from .pages import _EDITS, _FRAMES, edits, sized_pages
from .registry import query
from .texts import _LINES, turns

# Each line of a text as two runs of letters four wide, six apart, lines 20 apart.


def _page_runs(t):
    """Display runs of the turns of conversations."""
    n = F.col("hi") - F.col("lo")
    half = F.floor(n / 2)
    sides = F.array(
        F.struct(F.col("lo").alias("run_lo"), (F.col("lo") + half).alias("run_hi"), F.lit(10.0).alias("x")),
        F.struct((F.col("lo") + half).alias("run_lo"), F.col("hi").alias("run_hi"), (half * 4.0 + 16.0).alias("x")),
    )
    runs = L.text_lines(turns(t)).select(*L.PAGE, "line_no", F.explode(F.transform(F.filter(sides.alias("s"), lambda r: r["run_hi"] > r["run_lo"]), lambda r: r)).alias("r")).select(*L.PAGE, "line_no", "r.*")
    x0, x1, y = F.col("x"), F.col("x") + (F.col("run_hi") - F.col("run_lo")) * 4.0, F.col("line_no") * 20.0
    quad = F.array(G.point(x0, y + 12), G.point(x1, y + 12), G.point(x1, y), G.point(x0, y))
    return runs.select(*L.PAGE, "run_lo", "run_hi", quad.alias("quad"), F.array_repeat(F.lit(4.0), (F.col("run_hi") - F.col("run_lo")).cast("int")).alias("advances"))


_RUNS = f"""{_LINES},
        g AS (SELECT conv_id, turn, lo, n, n // 2 AS n1, line_no * 20.0 AS y0, row_number() OVER (PARTITION BY conv_id, turn ORDER BY line_no) - 1 AS line_no FROM lines WHERE n > 0),
        r AS (SELECT *, CASE WHEN n1 > 0 THEN 10.0 ELSE 16.0 END AS p0, 16.0 + n * 4 AS p1 FROM g)"""


@query(
    f"""WITH {_RUNS}, p AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn, CAST((conv_id * 13 + turn * 7) % 300 AS DOUBLE) + 0.5 AS x, CAST((conv_id * 29 + turn * 3) % 90 AS DOUBLE) AS y FROM conversations),
        m AS (SELECT p.*, r.* EXCLUDE (conv_id, turn), sum(CASE WHEN y0 + 6 < y THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn) AS low FROM p JOIN r USING (conv_id, turn)),
        k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY greatest(0, y0 - y, y - y0 - 12) + greatest(0, p0 - x, x - p1), line_no) AS k FROM m WHERE line_no BETWEEN low - 4 AND low + 3),
        o AS (SELECT *, 10.0 + n1 * 4 AS e1, 16.0 + n1 * 4 AS s2 FROM k WHERE k = 1)
        SELECT conv_id AS doc_id, turn AS page_index, CAST(line_no AS INTEGER) AS line_no,
               CAST(lo + CASE WHEN x <= p0 THEN 0 WHEN x >= p1 THEN n WHEN x >= s2 THEN n1 + floor((x - s2) / 4 + 0.5) WHEN x <= e1 THEN floor((x - 10) / 4 + 0.5) ELSE n1 END AS BIGINT) AS "offset" FROM o"""
)
def pointer_offsets(t):
    """No point is as near to one character's end as to the next one's, which rounding would decide."""
    lines = P.selection_lines(P.numbered_runs(_page_runs(t), turns(t)))
    k, n = F.col("doc_id"), F.col("page_index")
    points = turns(t).select(*L.PAGE, F.lit(0).alias("id"), ((k * 13 + n * 7) % 300 + 0.5).cast("double").alias("x"), ((k * 29 + n * 3) % 90).cast("double").alias("y"))
    return P.text_offsets(points, lines).drop("id")


@query(
    rf"""WITH {_RUNS}, o AS (SELECT conv_id, CAST(turn AS INTEGER) AS turn, CAST((conv_id * 37 + turn * 11) % 400 AS BIGINT) AS pos, text FROM conversations),
        m AS (SELECT o.*, r.line_no, r.lo, r.n, row_number() OVER (PARTITION BY conv_id, turn ORDER BY CASE WHEN lo <= pos THEN -lo ELSE lo + 1000000 END) AS k FROM o JOIN r USING (conv_id, turn)),
        f AS (SELECT *, pos - lo AS q, substring(text, lo + 1, n) AS t FROM m WHERE k = 1),
        c AS (SELECT *, unnest(range(1, n + 1)) AS i FROM f),
        e AS (SELECT *, regexp_matches(substring(t, i, 1), '[\p{{L}}\p{{N}}]') AS is_w, i > 1 AND regexp_matches(substring(t, i - 1, 1), '[\p{{L}}\p{{N}}]') AS was FROM c),
        w AS (SELECT *, sum(CASE WHEN is_w AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY i) AS w FROM e),
        b AS (SELECT conv_id, turn, q, w, min(i) - 1 AS a, max(i) AS z FROM w WHERE is_w GROUP BY ALL),
        d AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY CASE WHEN q >= a AND q < z THEN -1 ELSE greatest(0, a - q, q - z) END, a DESC) AS k FROM b)
        SELECT f.conv_id AS doc_id, f.turn AS page_index, pos AS "offset", CAST(line_no AS INTEGER) AS line_no, lo AS line_lo, CAST(lo + n AS BIGINT) AS line_hi, CAST(lo + a AS BIGINT) AS word_lo, CAST(lo + z AS BIGINT) AS word_hi
        FROM f LEFT JOIN (SELECT * FROM d WHERE k = 1) d USING (conv_id, turn)"""
)
def words_under(t):
    pages = turns(t)
    lines = P.selection_lines(P.numbered_runs(_page_runs(t), pages))
    offsets = pages.select(*L.PAGE, F.lit(0).alias("id"), ((F.col("doc_id") * 37 + F.col("page_index") * 11) % 400).cast("bigint").alias("offset"))
    return P.words_at(offsets, lines, pages).drop("id")


@query(
    f"""WITH {_RUNS}, o AS (SELECT *, CAST((conv_id * 7 + turn) % 40 AS BIGINT) AS a, CAST((conv_id * 7 + turn) % 40 + 90 AS BIGINT) AS z FROM r),
        c AS (SELECT *, greatest(a, lo) - lo AS i, least(z, lo + n) - lo AS j FROM o WHERE lo < z AND a < lo + n)
        SELECT conv_id AS doc_id, turn AS page_index, count(*) AS n_quads, CAST(sum(CASE WHEN i < n1 THEN 10 + i * 4 ELSE 16 + i * 4 END) AS DOUBLE) AS left_sum,
               CAST(sum(CASE WHEN j > n1 THEN 16 + j * 4 ELSE 10 + j * 4 END) AS DOUBLE) AS right_sum, CAST(min(792 - y0 - 12) AS DOUBLE) AS bottom, CAST(max(792 - y0) AS DOUBLE) AS top FROM c GROUP BY ALL"""
)
def selection_marks(t):
    pages = turns(t)
    start = (F.col("doc_id") * 7 + F.col("page_index")) % 40
    ranges = pages.select(*L.PAGE, F.lit(0).alias("id"), start.alias("lo"), (start + 90).alias("hi"))
    maps = pages.select(*L.PAGE, G.affine(1, 0, 0, -1, 0, 792).alias("display"))
    marks = P.selection_highlights(ranges, P.numbered_runs(_page_runs(t), pages), maps)
    boxes = F.transform("quads", lambda q: G.bounds(q))
    total = lambda f: F.round(F.aggregate("b", F.lit(0.0), lambda s, b: s + f(b)), 4)
    return marks.withColumn("b", boxes).select(
        *L.PAGE, F.size("b").cast("bigint").alias("n_quads"), total(lambda b: b["x"]).alias("left_sum"), total(lambda b: b["x"] + b["w"]).alias("right_sum"),
        F.round(F.array_min(F.transform("b", lambda b: b["y"])), 4).alias("bottom"), F.round(F.array_max(F.transform("b", lambda b: b["y"] + b["h"])), 4).alias("top"),
    )


@query(
    """WITH e AS (SELECT o_orderkey AS id, o_custkey % 9 AS a, o_orderkey % 9 AS f, o_orderkey % 50 AS off, o_orderkey % 4 <> 0 AS known, o_orderkey % 3 = 0 AS word FROM orders),
            x AS (SELECT id, CAST(a AS INTEGER) AS ap, 20 AS ao, CAST(CASE WHEN known OR f >= a THEN f ELSE f + 1 END AS INTEGER) AS fp, CASE WHEN NOT known THEN 0 WHEN word THEN off - 2 ELSE off END AS f0, CASE WHEN NOT known THEN 0 WHEN word THEN off + 3 ELSE off END AS f1, known FROM e)
       SELECT id, NOT known AS provisional, CASE WHEN (ap, ao) <= (fp, f0) THEN ap ELSE fp END AS start_page, CAST(CASE WHEN (ap, ao) <= (fp, f0) THEN ao ELSE f0 END AS BIGINT) AS start_offset,
              CASE WHEN (ap, ao) >= (fp, f1) THEN ap ELSE fp END AS end_page, CAST(CASE WHEN (ap, ao) >= (fp, f1) THEN ao ELSE f1 END AS BIGINT) AS end_offset FROM x"""
)
def selection_ends(t):
    k = F.col("o_orderkey")
    ends = t.orders.select(F.lit(0).alias("doc_id"), (k % 9).cast("int").alias("page_index"), k.alias("id"), (F.col("o_custkey") % 9).cast("int").alias("anchor_page"))
    off = (k % 50).cast("bigint")
    known = t.orders.where(k % 4 != 0).select(F.lit(0).alias("doc_id"), (k % 9).cast("int").alias("page_index"), k.alias("id"), off.alias("offset"), F.when(k % 3 == 0, F.struct((off - 2).alias("lo"), (off + 3).alias("hi"))).alias("unit"))
    found = P.resolved_ends(ends, known).join(ends.select("id", "anchor_page"), "id")
    anchor = F.struct(F.struct(F.col("anchor_page").alias("page"), F.lit(20).cast("bigint").alias("offset")).alias("position"), F.lit(None).cast("struct<lo:bigint,hi:bigint>").alias("unit"))
    both = P.combined(anchor, F.struct("position", "unit"))
    return found.select("id", "provisional", *(both[s][c].alias(f"{s}_{c}") for s in ("start", "end") for c in ("page", "offset")))


@query(
    """WITH r AS (SELECT p_partkey, p_partkey % 40 AS pg, p_partkey // 40 % 5 AS batch FROM part), l AS (SELECT pg, max(batch) AS batch FROM (SELECT pg, batch FROM r UNION ALL SELECT DISTINCT pg, 9 FROM r WHERE pg % 7 = 3) GROUP BY pg)
       SELECT CAST(pg AS INTEGER) AS page_index, p_partkey AS region_id, p_partkey % 3 = 0 AS selected FROM r JOIN l USING (pg, batch)"""
)
def region_replace(t):
    """Sets of regions replace each other; pages with remainder 3 end with an empty set."""
    k = F.col("p_partkey")
    regions = t.part.select(F.lit(0).alias("doc_id"), (k % 40).cast("int").alias("page_index"), (F.floor(k / 40) % 5).cast("int").alias("batch"), k.alias("region_id"))
    sets = regions.select(*L.PAGE, "batch")
    left = M.page_regions(sets.unionByName(sets.where("page_index % 7 = 3").withColumn("batch", F.lit(9))), regions)
    chosen = M.still_selected(regions.where("region_id % 3 = 0").select(*L.PAGE, "region_id"), left).withColumn("selected", F.lit(True))
    return left.join(chosen, [*L.PAGE, "region_id"], "left").select("page_index", "region_id", F.coalesce("selected", F.lit(False)).alias("selected"))


@query(f"WITH {_EDITS} SELECT id, pg AS page_index, CAST(place AS INTEGER) AS place FROM reg WHERE id NOT IN (SELECT user_id * 3 FROM events WHERE event_id % 5 = 0)")
def highlight_remove(t):
    gone = t.events.where("event_id % 5 = 0").select((F.col("user_id") * 3).alias("id"))
    return M.everything(M.without(M.upsert(edits(t), cap=1 << 30), gone)).select("id", "page_index", "place")


@query("SELECT user_id AS key, min(event_id) AS seq FROM events GROUP BY user_id HAVING user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def queue_remove(t):
    buffer = Y.enqueue(t.events.select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.lit(1).alias("priority")))
    return Y.without_keys(buffer, t.orders.where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("key"))).select("key", "seq")


def _views(frames):
    k = F.col("doc_id")
    return frames.select("doc_id").distinct().select("doc_id", F.lit(0).alias("id"), F.lit(50.0).alias("vx"), (k * 131 % 3000).cast("double").alias("vy"), F.lit(300.0).alias("vw"), F.lit(700.0).alias("vh"), (k % 5 - 1).cast("int").alias("bucket"))


_VIEW = f"""{_FRAMES},
        v AS (SELECT doc_id, 50.0 AS vx, CAST(doc_id * 131 % 3000 AS DOUBLE) AS vy, 300.0 AS vw, 700.0 AS vh, 512.0 / pow(2, (doc_id % 5 - 1) / 2) AS s FROM (SELECT DISTINCT doc_id FROM f)),
        m AS (SELECT f.*, s, vh, greatest(vx, x) - x AS px, greatest(vy, y) - y AS py, least(vx + vw, x + w) - greatest(vx, x) AS pw, least(vy + vh, y + h) - greatest(vy, y) AS ph FROM v JOIN f USING (doc_id)),
        shown AS (SELECT * FROM m WHERE pw > 0 AND ph > 0)"""


@query(
    f"""WITH {_FRAMES}, v AS (SELECT doc_id, CAST(doc_id * 131 % 3000 AS DOUBLE) + 350 AS mid FROM (SELECT DISTINCT doc_id FROM f))
        SELECT doc_id, coalesce(min(CASE WHEN y + h >= mid THEN page_index END), max(page_index)) AS page_index FROM v JOIN f USING (doc_id) GROUP BY doc_id"""
)
def current_page(t):
    frames = Y.page_frames(sized_pages(t))
    return Y.current_page(_views(frames), frames).drop("id")


@query(
    f"""WITH {_VIEW}, spans AS (SELECT doc_id, min(page_index) - 3 AS a, max(page_index) + 3 AS b FROM shown GROUP BY doc_id)
        SELECT f.doc_id, f.page_index FROM f JOIN spans USING (doc_id) ANTI JOIN shown USING (doc_id, page_index) WHERE f.page_index BETWEEN a AND b"""
)
def prefetch_previews(t):
    frames = Y.page_frames(sized_pages(t))
    return Y.prefetch_previews(_views(frames), frames).drop("id")


@query(
    f"""WITH {_VIEW},
        own AS (SELECT doc_id, page_index, w, h, s, px AS rx, pw AS rw, greatest(py - vh / 2, 0) AS ry, least(py + ph + vh / 2, h) AS rb, 0 AS seen FROM shown),
        up AS (SELECT o.doc_id, n.page_index, n.w, n.h, o.s, o.px, o.pw, n.h - least(o.vh / 2 - o.py, n.h), n.h, 0 FROM shown o JOIN f n ON n.doc_id = o.doc_id AND n.page_index = o.page_index - 1 WHERE o.py < o.vh / 2),
        down AS (SELECT o.doc_id, n.page_index, n.w, n.h, o.s, o.px, o.pw, 0, least(o.py + o.ph + o.vh / 2 - o.h, n.h), 0 FROM shown o JOIN f n ON n.doc_id = o.doc_id AND n.page_index = o.page_index + 1 WHERE o.py + o.ph + o.vh / 2 > o.h),
        near AS (SELECT * FROM (SELECT * FROM up UNION ALL SELECT * FROM down) ANTI JOIN shown USING (doc_id, page_index)),
        rects AS (SELECT * FROM own UNION ALL SELECT * FROM near UNION ALL SELECT doc_id, page_index, w, h, s, px, pw, py, py + ph, 1 FROM shown),
        c AS (SELECT *, unnest(range(0, 60)) AS tile_col FROM rects WHERE rb > ry),
        k AS (SELECT *, unnest(range(0, 60)) AS tile_row FROM c WHERE tile_col >= greatest(floor((rx + 1e-6) / s), 0) AND tile_col <= least(ceil((rx + rw - 1e-6) / s), greatest(1, ceil(w / s))) - 1),
        g AS (SELECT * FROM k WHERE tile_row >= greatest(floor((ry + 1e-6) / s), 0) AND tile_row <= least(ceil((rb - 1e-6) / s), greatest(1, ceil(h / s))) - 1)
        SELECT doc_id, page_index, CAST(tile_col AS INTEGER) AS tile_col, CAST(tile_row AS INTEGER) AS tile_row FROM g GROUP BY ALL HAVING max(seen) = 0"""
)
def prefetch_tiles(t):
    frames = Y.page_frames(sized_pages(t))
    return Y.prefetch_tiles(_views(frames), frames).drop("id")


@query(
    f"""WITH {_FRAMES}, o AS (SELECT *, y + h * (page_index % 7) / 5 - 20 AS p, max(y + h) OVER (PARTITION BY doc_id) + 12 AS tall, max(w) OVER (PARTITION BY doc_id) AS wide FROM f),
        c AS (SELECT *, least(greatest((p - y) / h, 0), 1) AS share FROM o)
        SELECT doc_id, page_index, round(share, 6) AS share, round(y + share * h, 4) AS restored, round(800 / (wide + 24), 6) AS scale, round(least(greatest(p - 350, 0), greatest(tall - 700, 0)), 4) AS scroll FROM c"""
)
def reading_places(t):
    """Where a reader is, found again, the scale that fits, and where to scroll to see it in the middle."""
    from pyspark.sql.window import Window as W

    f, doc = Y.page_frames(sized_pages(t)), W.partitionBy("doc_id")
    f = f.withColumns({"at": F.col("y") + F.col("h") * (F.col("page_index") % 7) / 5 - 20, "tall": F.max(F.col("y") + F.col("h")).over(doc) + 12, "wide": F.max("w").over(doc)})
    f = f.withColumn("share", Y.capture(F.col("at"), F.col("y"), F.col("h")))
    return f.select(
        "doc_id", "page_index", F.round("share", 6).alias("share"), F.round(Y.restore(F.col("share"), F.col("y"), F.col("h")), 4).alias("restored"),
        F.round(Y.fit_width(F.lit(800.0), F.col("wide")), 6).alias("scale"), F.round(Y.centred(F.col("at"), F.col("at"), F.lit(700.0), F.col("tall")), 4).alias("scroll"),
    )


@query(
    """WITH e AS (SELECT user_id AS cache, event_id AS seq, event_type || (event_id % 3) AS key FROM events),
            p AS (SELECT *, lag(seq) OVER (PARTITION BY cache, key ORDER BY seq) AS before FROM e),
            d AS (SELECT p.cache, p.seq, p.key, p.before, count(DISTINCT q.key) AS others FROM p LEFT JOIN e q ON q.cache = p.cache AND q.seq > p.before AND q.seq < p.seq GROUP BY ALL)
       SELECT cache, seq, key, before IS NOT NULL AND others < 4 AS hit FROM d"""
)
def lru_replay(t):
    """All costs are one, so that a look-up hits if fewer than the budget's other keys came since the last one."""
    log = t.events.select(F.col("user_id").alias("cache"), F.col("event_id").alias("seq"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("key"), F.lit(1).alias("cost"))
    return caches.replay(log, 4).select("cache", "seq", "key", "hit")


@query("""SELECT p_partkey, CAST(p_size AS INTEGER) AS page, least(greatest(p_partkey % 13 / 10.0 - 0.1, 0), 1)::DOUBLE AS "offset", (p_partkey % 4 + 0.5)::DOUBLE AS zoom FROM part WHERE p_partkey % 5 <> 0""")
def position_json(t):
    """Written and read back; every fifth text is damaged."""
    k = F.col("p_partkey")
    text = exchange.position_json(F.col("p_size").cast("int"), k % 13 / 10 - 0.1, k % 4 + F.lit(0.5))
    back = exchange.position_from_json(F.when(k % 5 == 0, F.substring(text, 1, 9)).otherwise(text))
    return t.part.select(k, back.alias("p")).where("p is not null").select("p_partkey", "p.*")


@query(
    """SELECT p_partkey, 'h' || p_partkey AS id, CAST(p_size AS INTEGER) AS page, CAST(p_partkey % 3 AS INTEGER) AS n_quads, CASE WHEN p_partkey % 3 > 0 THEN (p_partkey % 700)::DOUBLE END AS x, 0.25::DOUBLE AS red FROM part"""
)
def highlight_json(t):
    """Marks with their quads written and read back, beside a text that is no quad."""
    k = F.col("p_partkey")
    quad = G.quad_of(G.rect(k % 700, F.col("p_size"), F.lit(30), F.lit(12)))
    quads = F.array_append(F.array_repeat(exchange.quad_json(quad), (k % 3).cast("int")), F.lit('{"topLeft":[1]}'))
    color = F.struct(F.lit(0.25).alias("red"), F.lit(0.5).alias("green"), F.lit(0.75).alias("blue"), F.lit(1.0).alias("alpha"))
    text = exchange.highlight_json(F.struct(F.concat(F.lit("h"), k.cast("string")).alias("id"), F.col("p_size").cast("int").alias("page"), quads.alias("quads"), color.alias("color")))
    back = spread(t.part.select("p_partkey", "p_size")).select("p_partkey", exchange.highlight_from_json(text).alias("m"))
    return back.select("p_partkey", "m.id", "m.page", F.size("m.quads").alias("n_quads"), F.try_element_at("m.quads", F.lit(1))[0]["x"].alias("x"), F.col("m.color.red").alias("red"))


@query(
    """WITH s AS (SELECT o_orderkey, CAST(o_custkey % 9 AS INTEGER) AS a, CAST(o_orderkey % 50 AS INTEGER) AS b, CAST(o_orderkey % 9 AS INTEGER) AS c, CAST(o_custkey % 50 AS INTEGER) AS d FROM orders)
       SELECT o_orderkey, CASE WHEN (a, b) <= (c, d) THEN a ELSE c END AS start_page, CASE WHEN (a, b) <= (c, d) THEN b ELSE d END AS start_offset, CASE WHEN (a, b) <= (c, d) THEN c ELSE a END AS end_page, CASE WHEN (a, b) <= (c, d) THEN d ELSE b END AS end_offset FROM s"""
)
def selection_json(t):
    """Selections kept either way round."""
    place = lambda a, b: F.struct((a % 9).cast("int").alias("page"), (b % 50).cast("int").alias("offset"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    back = exchange.selection_from_json(exchange.selection_json(F.struct(place(c, k).alias("start"), place(k, c).alias("end"))))
    return t.orders.select(k, back.alias("s")).select("o_orderkey", *(F.col(f"s.{e}.{f}").alias(f"{e}_{f}") for e in ("start", "end") for f in ("page", "offset")))


# Bytes below 80 are codes of one byte, others of two to four, as their first byte says.
_CMAP = b"""/WMode 1 def 4 begincodespacerange <00> <7F> <C280> <DFBF> <E08080> <EFBFBF> <F0808080> <F4BFBFBF> endcodespacerange
2 begincidrange <00> <7F> 1000 <C280> <DFBF> 5000 endcidrange 1 begincidchar <41> 7 endcidchar"""


@query(
    """WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text <> '')
       SELECT doc_id, count(*) AS n_codes, count(*) FILTER (unicode(c) < 128) AS n_single, CAST(sum(CASE WHEN c = 'A' THEN 7 WHEN unicode(c) < 128 THEN 1000 + unicode(c) WHEN unicode(c) < 2048 THEN 5000 + (192 + unicode(c) // 64) * 256 + 128 + unicode(c) % 64 - 49792 ELSE 0 END) AS BIGINT) AS cid_sum, true AS vertical FROM c GROUP BY doc_id"""
)
def cid_segments(t):
    """Texts cut into codes by an embedded map's codespaces, and the sum of their glyph numbers."""

    def run(batches):
        cmap, known = CidMap.parse(_CMAP), {}
        for batch in pieces(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                n = single = total = 0
                for piece, times in Counter(cmap.pieces(text)).items():
                    if piece not in known:
                        known[piece] = cmap.get(int.from_bytes(piece, "big"), len(piece)) or 0  # codes of characters: a million at most
                    n, single, total = n + times, single + times * (len(piece) == 1), total + times * known[piece]
                rows.append((n, single, total, cmap.vertical))
            columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, kind in columns)], ["doc_id", "n_codes", "n_single", "cid_sum", "vertical"])

    texts = spread(t.documents.where("text <> ''").select("doc_id", F.encode("text", "UTF-8").alias("b")))
    return texts.mapInArrow(run, "doc_id bigint, n_codes bigint, n_single bigint, cid_sum bigint, vertical boolean")


@query(_DIGEST)
def literal_strings(t):
    """Texts as literal strings with escapes, an octal code and a continued line."""

    def shown(x):
        for a, b in ((b"\\", b"\\\\"), (b"(", b"\\("), (b")", b"\\)"), (b"\r", b"\\r"), (b"e", b"\\145"), (b" ", b"\\\n ")):
            x = x.replace(a, b)
        return b" (" + x + b") Tj"

    return _round_trip(t, shown, lambda x, n: Reader(x, 0, refs=False).value())


@query(f"SELECT doc_id, 'ok' AS status, CAST(greatest(1, ceil(len({_SPLIT}) / 50.0)) AS INTEGER) AS page_count, md5(array_to_string({_SPLIT}, chr(10))) AS digest FROM documents")
def stream_documents(t):
    """Documents whose objects are in object streams and whose sections are streams."""
    read = R.read(R.text_files(t.documents, xref="stream"))
    return read.select("doc_id", "status", "page_count", F.md5(F.array_join(F.transform("runs", lambda x: x["text"]), "\n")).alias("digest"))


def _altered(t, change):
    """Documents whose bytes, as Latin-1 text in ``s``, are changed by ``change``."""
    files = R.text_files(t.documents).withColumn("s", F.decode("content", "ISO-8859-1"))
    return files.select("doc_id", F.encode(change(F.col("doc_id"), F.col("s")), "ISO-8859-1").alias("content"))


@query(
    f"""SELECT doc_id, 'ok' AS status, CAST(greatest(1, ceil(len({_SPLIT}) / 50.0)) AS INTEGER) AS page_count,
               CASE doc_id % 4 WHEN 1 THEN 'header' WHEN 2 THEN 'header' WHEN 3 THEN 'header,recovery' ELSE '' END AS kinds FROM documents"""
)
def damaged_documents(t):
    """With bytes before the header, without the end mark, or without the place of the sections: all open, with
    warnings of these kinds."""

    def change(k, s):
        return F.when(k % 4 == 1, F.concat(F.lit("junk\n"), s)).when(k % 4 == 2, F.replace(s, F.lit("%%EOF"), F.lit(""))).when(k % 4 == 3, F.regexp_replace(s, r"startxref\s+\d+\s+%%EOF\s*$", "")).otherwise(s)

    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("warnings", D.warning_kind))), ",")
    return R.opened(_altered(t, change)).select("doc_id", "status", "page_count", kinds.alias("kinds"))


@query(
    f"""SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'encrypted' WHEN 1 THEN 'notAPDF' ELSE 'ok' END AS status, CAST(CASE WHEN doc_id % 3 = 2 THEN greatest(1, ceil(len({_SPLIT}) / 50.0)) ELSE 0 END AS INTEGER) AS page_count FROM documents"""
)
def refused_documents(t):
    """Encrypted files, and files without a header."""

    def change(k, s):
        return F.when(k % 3 == 0, F.replace(s, F.lit("/Root 1 0 R"), F.lit("/Encrypt << /Filter /Standard >> /Root 1 0 R"))).when(k % 3 == 1, F.replace(s, F.lit("%PDF-"), F.lit("%XYZ-"))).otherwise(s)

    return R.opened(_altered(t, change)).select("doc_id", "status", "page_count")

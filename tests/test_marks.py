"""Marks, regions and as-of joins against plain versions."""

import random
import unicodedata

from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions import text as T
from quire.operators import layout, marks, search, structure


def plain_registry(edits, cap):
    """Whole batches applied one after the other to pages of ids, each cut afterwards."""
    pages: dict[int, list[int]] = {}
    for batch in sorted({e[0] for e in edits}):
        clean: dict[int, tuple[int, int]] = {}
        for _, seq, mark, page in sorted(e for e in edits if e[0] == batch and e[3] >= 0):
            first = clean.get(mark, (seq, page))[0]
            clean[mark] = first, page
        for mark, (_, page) in clean.items():
            for p, ids in pages.items():
                if p != page and mark in ids:
                    ids.remove(mark)
        for mark, (_, page) in sorted(clean.items(), key=lambda x: x[1][0]):
            if mark not in pages.setdefault(page, []):
                pages[page].append(mark)
        for ids in pages.values():
            del ids[cap:]
    return sorted((m, p, k) for p, ids in pages.items() for k, m in enumerate(ids))


def test_the_cap_cuts_after_each_batch(spark):
    rng = random.Random(3)
    edits = [(k // 12, k, rng.randint(0, 14), rng.randint(-1, 3)) for k in range(300)]
    frame = spark.createDataFrame([(*e, 1, "c", 1) for e in edits], "batch long, seq long, id long, page_index int, quads_ok int, color string, n_quads int")
    for cap in (2, 5, 100):
        got = sorted((r.id, r.page_index, r.place) for r in marks.upsert(frame, cap).collect())
        assert got == plain_registry(edits, cap)


def test_regions_of_all_sizes(spark):
    rng = random.Random(5)
    regions = []
    for k in range(200):
        x, y, w, h = rng.uniform(-50, 400), rng.uniform(-50, 400), *(rng.choice([0.0, 1e-9, 0.5, 7.0, 64.0, 300.0, 1e6]) for _ in "wh")
        regions.append((1, k % 3, k, k, x, y, w, h))
    frame = spark.createDataFrame(regions, "doc_id int, page_index int, region_id int, seq int, x double, y double, w double, h double")
    frame = frame.withColumn("quad", G.quad_of(G.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")))).drop("x", "y", "w", "h")
    points = [(1, i % 4, i, rng.uniform(-60, 500), rng.uniform(-60, 500)) for i in range(300)]
    points += [(1, r[1], 1000 + r[2], r[4], r[5]) for r in regions] + [(1, r[1], 2000 + r[2], r[4] + r[6], r[5] + r[7]) for r in regions]
    asked = spark.createDataFrame(points, "doc_id int, page_index int, point_id int, x double, y double")
    got = {r.point_id: r.region_id for r in marks.region_hits(asked, frame).collect()}
    pairs = asked.join(frame, ["doc_id", "page_index"]).where(G.inside(F.struct("x", "y"), F.col("quad")))
    want = {r.point_id: r.region_id for r in pairs.groupBy("point_id").agg(F.max("region_id").alias("region_id")).collect()}
    assert len(got) == len(points) and {k: v for k, v in got.items() if v is not None} == want


def test_pages_by_place(spark):
    rng = random.Random(6)
    pages = [(d, p, float(rng.randint(1, 300)), float(rng.randint(1, 300))) for d in range(3) for p in range(rng.randint(1, 9))]
    frames = layout.page_frames(spark.createDataFrame(pages, "doc_id int, page_index int, w double, h double"))
    rows = frames.collect()
    points = [(rng.randint(0, 3), k, rng.choice([rng.uniform(-20, 1500), rng.choice(rows).y, (r := rng.choice(rows)).y + r.h])) for k in range(200)]
    got = {r.id: r.page_index for r in layout.page_at_y(spark.createDataFrame(points, "doc_id int, id int, y double"), frames).collect()}
    want = {}
    for d, k, y in points:
        own = sorted((r.page_index, r.y + r.h) for r in rows if r.doc_id == d)
        if own:
            want[k] = next((p for p, end in own if end >= y), own[-1][0])
    assert got == want
    views = [(d, k, 0.0, y, 400.0, rng.choice([0.0, 10.0, 500.0])) for d, k, y in points]
    shown = layout.visible_parts(spark.createDataFrame(views, "doc_id int, id int, vx double, vy double, vw double, vh double"), frames).collect()
    plain = {(k, r.page_index) for d, k, x, y, w, h in views for r in rows if r.doc_id == d and min(x + w, r.x + r.w) > max(x, r.x) and min(y + h, r.y + r.h) > max(y, r.y)}
    assert {(r.id, r.page_index) for r in shown} == plain and len(shown) == len(plain)


def test_search_in_every_script(spark):
    """The filter in the JVM never drops what Python finds: every code point whose folding is more than one letter,
    as text and as query, and some words."""
    every = [chr(c) for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co", "Cc")]
    chosen = [c for c in every if unicodedata.normalize("NFD", c) != c or c.lower() != c]
    texts = [(0, k, "".join(f" {c} " for c in chosen[k : k + 1])) for k in range(len(chosen))]
    texts += [(1, 0, "한국어 문서"), (1, 1, "がんばる"), (1, 2, "ΟΔΟΣ"), (1, 3, "οδος"), (1, 4, "İstanbul"), (1, 5, "plain ascii")]
    pages = spark.createDataFrame(texts, "doc_id int, page_index int, text string")
    odd = {(r.doc_id, r.page_index): (r.odd, r.folded) for r in pages.select("doc_id", "page_index", T.undecided(F.col("text")).alias("odd"), T.folded(F.col("text")).alias("folded")).collect()}
    for d, p, text in texts:
        passes, folded = odd[d, p]
        assert passes or folded == T.fold_clusters(text, False, False)[0], text
    for query, want in (("문서", [(1, 0, 4, 6)]), ("がん", [(1, 1, 0, 2)]), ("οδοσ", [(1, 2, 0, 4)]), ("istanbul", [(1, 4, 0, 8)]), ("ascii", [(1, 5, 6, 11)])):
        got = [(r.doc_id, r.page_index, r.lo, r.hi) for r in search.search(pages.where("doc_id = 1"), query).collect()]
        assert got == want, query
        counts = [(r.doc_id, r.page_index, r.n) for r in search.count_matches(pages.where("doc_id = 1"), query).collect()]
        assert counts == [(d, p, 1) for d, p, *_ in want]


def test_packet_dates(spark):
    dates = ["2024-03-21T09:45:00Z", "2024-03-21T09:45+02:00", "2024-03", "2024-03-21", "D:20240321", "2024-13-01", "x"]
    frame = spark.createDataFrame([(i, d) for i, d in enumerate(dates)], "i int, d string")
    got = [str(r.x) for r in frame.orderBy("i").select(structure.parsed_iso_date(F.col("d")).cast("string").alias("x")).collect()]
    assert got == ["2024-03-21 09:45:00", "2024-03-21 07:45:00", "2024-03-01 00:00:00", "2024-03-21 00:00:00", "None", "None", "None"]


def test_ranges_of_all_lengths(spark):
    rng = random.Random(8)
    ranges = [(k % 3, lo := rng.randint(-500, 5000), lo + rng.choice((-1, 0, 1, 7, 8, 63, 64, 900, 10**6)), k, rng.randint(0, 50)) for k in range(300)]
    keys = [(k % 4, rng.randint(-700, 7000)) for k in range(500)] * 2
    frame = spark.createDataFrame(ranges, "font int, lo long, hi long, value long, seq int")
    asked = spark.createDataFrame(keys, "font int, key long")
    for by in (["font"], []):
        for largest in (True, False):
            got = structure.in_ranges(asked if by else asked.drop("font"), frame, by, "key", "value", largest).collect()
            pick = max if largest else min
            want = [(k, pick((v for f, lo, hi, v, _ in ranges if lo <= k <= hi and (f == font or not by)), default=None)) for font, k in keys]
            assert sorted(((r.key, r.value) for r in got), key=str) == sorted(want, key=str)


def test_ranges_meet_only_keys_near_them(spark):
    """200,000 ranges and as many keys of one font are 4 * 10^10 pairs, and a fraction of that by cells."""
    import time

    began = time.time()
    k = F.col("id")
    keys = spark.range(200_000).select(F.lit(1).alias("font"), (k * 7).alias("key"))
    ranges = spark.range(200_000).select(F.lit(1).alias("font"), (k * 7 - k % 40).alias("lo"), (k * 7).alias("hi"), k.alias("value"))
    found = structure.in_ranges(keys, ranges, ["font"], "key", "value", True)
    assert found.where("value * 7 >= key").count() == 200_000
    assert time.time() - began < 45


def test_groups_count_all_marks_of_a_page(spark, tmp_path):
    """More marks on each page than a page's cap."""
    import duckdb

    from quire.limits import HIGHLIGHTS_PER_PAGE
    from quire.plans.queries import QUERIES, SQL

    k = F.col("id")
    events = spark.range(60_000).select(k.alias("event_id"), (k * 7919 % 20_011).alias("user_id"), F.concat(F.lit("kind"), (k % 11).cast("string")).alias("event_type"))
    events.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = QUERIES["highlight_groups"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(SQL["highlight_groups"]).df()[list(got.columns)]
    rows = lambda f: sorted(tuple(r) for r in f.itertuples(index=False, name=None))
    assert rows(got) == rows(want)
    assert marks.upsert(spark.createDataFrame([(0, 0, 0, 0, 1, "c", 1)], "batch long, seq long, id long, page_index int, quads_ok int, color string, n_quads int"), None).count() == 1
    from quire.plans.pages import edits
    from quire.plans.registry import Tables

    sizes = marks.upsert(edits(Tables(spark, str(tmp_path))), None).groupBy("page_index").count().collect()
    assert min(r["count"] for r in sizes) > HIGHLIGHTS_PER_PAGE


def test_marks_that_no_cap_cuts_need_no_python(spark):
    rng = random.Random(4)
    edits = [(k // 12, k, rng.randint(0, 14), rng.randint(-1, 3), 1, "c", 1) for k in range(300)]
    frame = spark.createDataFrame(edits, "batch long, seq long, id long, page_index int, quads_ok int, color string, n_quads int")
    for cap in (1000, None):
        out = marks.upsert(frame, cap)
        assert sorted((r.id, r.page_index, r.place) for r in out.collect()) == plain_registry([e[:4] for e in edits], 1000)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "InArrow" not in plan and "InPandas" not in plan


def test_points_meet_plain_numbers(spark):
    """The join that tries regions reads no quads, slanted quads work, and those that are not finite hold nothing."""
    inf, nan = float("inf"), float("nan")
    quads = [(0, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), (1, [(2.0, 0.0), (4.0, 2.0), (2.0, 4.0), (0.0, 2.0)]), (2, [(1.0, 1.0)] * 4), (3, [(0.0, 0.0), (inf, 0.0), (4.0, 4.0), (0.0, 4.0)]), (4, [(nan, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)])]
    regions = spark.createDataFrame([(1, 0, k, k, q) for k, q in quads], "doc_id int, page_index int, region_id int, seq int, quad array<struct<x:double,y:double>>")
    points = [(2.0, 2.0, 1), (3.5, 3.5, 0), (1.0, 1.0, 1), (0.5, 0.5, 0), (5.0, 1.0, None), (nan, 1.0, None), (1.0, inf, None), (4.0, 4.0, 0)]
    asked = spark.createDataFrame([(1, 0, k, x, y) for k, (x, y, _) in enumerate(points)], "doc_id int, page_index int, point_id int, x double, y double")
    out = marks.region_hits(asked, regions)
    assert {r.point_id: r.region_id for r in out.collect()} == {k: want for k, (_, _, want) in enumerate(points)}
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and not any("quad" in x for x in joins)

"""Points, words and selection ends on the real runs of pages.

``runs`` here are sane runs of pages in display space: doc_id, page_index, run_lo, run_hi (UTF-16 units), quad (origin
of the baseline first, then around) and advances. Points meet lines by their place in vertical order, never all lines
of their page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as G
from ..functions import text as T
from .selection import PAGE, line_of_offset, quads_for_ranges, text_lines

ALIGNED, NEAR = 0.25, 4


def units(text: Column) -> Column:
    """The text with two characters for each one that takes two UTF-16 units, so that places are units; letters
    and digits stay such."""
    letters = F.regexp_replace(text, r"[[\x{10000}-\x{10FFFF}]&&[\p{L}\p{N}]]", "xx")
    return F.regexp_replace(letters, r"[\x{10000}-\x{10FFFF}]", "\N{REPLACEMENT CHARACTER}" * 2)


def numbered_runs(runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Runs with run_no and line_no: a line begins where the gap before a run holds a line break.

    ``pages``: doc_id, page_index, text. Breaks and runs meet in one window by their places.
    """
    breaks = text_lines(pages.select(*PAGE, units(F.col("text")).alias("text"))).select(*PAGE, F.col("hi").alias("_at"), F.lit(1).alias("_kind"))
    both = runs.withColumns({"_at": F.col("run_lo").cast("bigint"), "_kind": F.lit(0)}).unionByName(breaks, allowMissingColumns=True)
    places = W.partitionBy(*PAGE).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = both.withColumn("_break", F.max(F.when(F.col("_kind") == 1, F.col("_at"))).over(places)).where("_kind = 0")
    order = W.partitionBy(*PAGE).orderBy("run_lo", "run_hi")
    before = F.lag("run_hi").over(order)
    met = met.withColumns({"run_no": F.row_number().over(order) - 1, "_new": F.when((before < F.col("run_lo")) & (F.col("_break") >= before), 1).otherwise(0)})
    return met.withColumn("line_no", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int")).drop("_at", "_kind", "_break", "_new")


def selection_lines(numbered: DataFrame) -> DataFrame:
    """(doc, page, line_no, visual_no, lo, hi, y0, y1, axis, p0, p1, runs) of ``numbered_runs``: the band, the
    direction of the line's first run, and what the line and each of its runs cover along it."""
    members = F.array_sort(F.collect_list(F.struct("run_no", "run_lo", "run_hi", "quad", "advances")))
    lines = numbered.groupBy(*PAGE, "line_no").agg(members.alias("_m"))

    def direction(q):
        dx, dy = q[1]["x"] - q[0]["x"], q[1]["y"] - q[0]["y"]
        long = F.sqrt(dx * dx + dy * dy)
        return F.when(long >= ALIGNED, G.point(dx / long, dy / long)).otherwise(G.point(F.lit(1.0), F.lit(0.0)))

    along = lambda p: p["x"] * F.col("axis.x") + p["y"] * F.col("axis.y")
    run = lambda r: F.struct(
        r["run_lo"].alias("lo"), r["run_hi"].alias("hi"), F.least(along(r["quad"][0]), along(r["quad"][1])).alias("s"), F.greatest(along(r["quad"][0]), along(r["quad"][1])).alias("e"),
        r["advances"].alias("advances"),
    )
    ys = F.flatten(F.transform("_m", lambda r: F.transform(r["quad"], lambda p: p["y"])))
    lines = lines.withColumns({"axis": direction(F.col("_m")[0]["quad"]), "y0": F.array_min(ys), "y1": F.array_max(ys), "lo": F.col("_m")[0]["run_lo"], "hi": F.element_at("_m", -1)["run_hi"]})
    lines = lines.withColumn("runs", F.transform("_m", run)).drop("_m")
    lines = lines.withColumns({"p0": F.array_min(F.transform("runs", lambda r: r["s"])), "p1": F.array_max(F.transform("runs", lambda r: r["e"]))})
    return lines.withColumn("visual_no", F.row_number().over(W.partitionBy(*PAGE).orderBy((F.col("y0") + F.col("y1")) / 2, "line_no")) - 1)


def text_offsets(points: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, page, id, line_no, offset): the text place nearest to each point (doc, page, id, x, y) of a page with
    lines (``selection_lines``).

    Of the four lines above and below the point the nearest by band and direction, ties to the earlier line; before
    or after the line its ends; else the nearest run, ties to the later one, and in it the nearest character end.
    """
    middle = (F.col("y0") + F.col("y1")) / 2
    places = lines.select(*PAGE, middle.alias("_at"), F.lit(1).alias("_kind"))
    asked = points.select(*PAGE, "id", "x", "y", F.col("y").alias("_at"), F.lit(0).alias("_kind"))
    page = W.partitionBy(*PAGE)
    both = asked.unionByName(places, allowMissingColumns=True)
    both = both.withColumns({"_low": F.sum("_kind").over(page.orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, W.currentRow)), "_n": F.sum("_kind").over(page)})
    some = both.where("_kind = 0 and _n > 0")
    some = some.withColumn("visual_no", F.explode(F.sequence(F.greatest(F.col("_low") - NEAR, F.lit(0)), F.least("_n", F.col("_low") + NEAR) - 1)))
    met = some.join(lines.drop("runs"), [*PAGE, "visual_no"])
    met = met.withColumn("_p", F.col("x") * F.col("axis.x") + F.col("y") * F.col("axis.y"))
    far = F.greatest(F.lit(0.0), F.col("y0") - F.col("y"), F.col("y") - F.col("y1")) + F.greatest(F.lit(0.0), F.col("p0") - F.col("_p"), F.col("_p") - F.col("p1"))
    best = met.groupBy(*PAGE, "id").agg(F.min_by(F.struct("line_no", "lo", "hi", "p0", "p1", "_p"), F.struct(far.alias("d"), "line_no")).alias("b"))
    best = best.select(*PAGE, "id", "b.*").join(lines.select(*PAGE, "line_no", "runs"), [*PAGE, "line_no"])
    p = F.col("_p")
    away = lambda r: F.greatest(F.lit(0.0), r["s"] - p, p - r["e"])
    best = best.withColumn("_r", F.element_at("runs", (1 - F.array_min(F.transform("runs", lambda r, k: F.struct(away(r).alias("d"), (-k).alias("k"))))["k"]).cast("int")))
    r = F.col("_r")
    best = best.withColumn("_total", F.aggregate(r["advances"], F.lit(0.0), lambda s, v: s + v))
    total = F.col("_total")
    target = F.when(r["e"] > r["s"], (p - r["s"]) / (r["e"] - r["s"])).otherwise(0.0) * total
    state = lambda at, k, d, best: F.struct(at.alias("at"), k.alias("k"), d.alias("d"), best.alias("best"))

    def walk(s, v):
        at, k = s["at"] + v, s["k"] + 1
        d = F.abs(at - F.col("_target"))
        return state(at, k, F.least(s["d"], d), F.when(d <= s["d"], k).otherwise(s["best"]))

    best = best.withColumn("_target", target)
    step = F.aggregate(r["advances"], state(F.lit(0.0), F.lit(0), F.abs(F.col("_target")), F.lit(0)), walk, lambda s: s["best"])
    offset = (
        F.when(p <= F.col("p0"), F.col("lo")).when(p >= F.col("p1"), F.col("hi")).when(p < r["s"], r["lo"]).when(p > r["e"], r["hi"])
        .when(total > 0, r["lo"] + step).otherwise(r["lo"])
    )
    return best.select(*PAGE, "id", "line_no", offset.cast("bigint").alias("offset"))


def words_at(offsets: DataFrame, lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc, page, id, offset, line_no, line_lo, line_hi, word_lo, word_hi): the line of each offset, and in that line
    the word at it or nearest to it. The lines' texts go with the offsets, not whole pages."""
    found = line_of_offset(offsets, lines.select(*PAGE, "line_no", "lo", "hi")).select(*PAGE, "id", "offset", "line.*")
    texts = lines.select(*PAGE, "line_no", "lo", "hi").join(pages.select(*PAGE, units(F.col("text")).alias("_t")), PAGE)
    texts = texts.select(*PAGE, "line_no", F.substring("_t", F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo")).cast("int")).alias("_t"))
    word = T.word_at(F.col("_t"), (F.col("offset") - F.col("lo")).cast("int"))
    met = found.join(texts, [*PAGE, "line_no"]).withColumn("_w", word)
    return met.select(*PAGE, "id", "offset", "line_no", F.col("lo").alias("line_lo"), F.col("hi").alias("line_hi"), (F.col("lo") + F.col("_w.lo")).alias("word_lo"), (F.col("lo") + F.col("_w.hi")).alias("word_hi"))


def resolved_ends(ends: DataFrame, known: DataFrame) -> DataFrame:
    """Selection ends (doc, page, id, anchor_page) with their text place, or a provisional one as long as the page
    isn't known: its start when dragging forward, the next page's start backward.

    ``known``: doc, page, id, offset and unit (struct<lo, hi> of the word or line chosen, null for characters).
    """
    met = ends.join(known.select(*PAGE, "id", "offset", "unit", F.lit(True).alias("_known")), [*PAGE, "id"], "left")
    ahead = F.when(F.col("_known") | (F.col("page_index") >= F.col("anchor_page")), F.col("page_index")).otherwise(F.col("page_index") + 1)
    place = F.struct(ahead.cast("int").alias("page"), F.coalesce("offset", F.lit(0)).cast("bigint").alias("offset"))
    return met.select(*PAGE, "id", place.alias("position"), "unit", F.col("_known").isNull().alias("provisional"))


def combined(anchor: Column, focus: Column) -> Column:
    """The selection of two ends (struct<position, unit>): the least of their starts to the greatest of their ends."""

    def edge(end, side):
        whole = F.struct(end["position"]["page"].alias("page"), end["unit"][side].cast("bigint").alias("offset"))
        return F.when(end["unit"].isNull(), end["position"]).otherwise(whole)

    return F.struct(F.least(edge(anchor, "lo"), edge(focus, "lo")).alias("start"), F.greatest(edge(anchor, "hi"), edge(focus, "hi")).alias("end"))


def aligned(quad: Column) -> Column:
    """Whether a quad's sides are level and upright, within a quarter of a point."""
    gap = lambda a, b, k: F.abs(quad[a][k] - quad[b][k]) <= ALIGNED
    return gap(0, 1, "y") & gap(3, 2, "y") & gap(0, 3, "x") & gap(1, 2, "x")


def display_quads(ranges: DataFrame, numbered: DataFrame) -> DataFrame:
    """(doc, page, id, line_no, quads) of text ranges (doc, page, id, lo, hi): one rectangle for a line whose parts are
    all upright, else the parts in order."""
    parts = quads_for_ranges(ranges, numbered)
    members = F.array_sort(F.collect_list(F.struct("run_no", "part")))
    lines = parts.groupBy(*PAGE, "id", "line_no").agg(members.alias("_m")).withColumn("_q", F.transform("_m", lambda m: m["part"]))
    whole = F.array(G.let(G.bounds(F.flatten("_q")), G.quad_of))
    return lines.select(*PAGE, "id", "line_no", F.when(F.forall("_q", aligned), whole).otherwise(F.col("_q")).alias("quads"))


def selection_highlights(ranges: DataFrame, numbered: DataFrame, maps: DataFrame) -> DataFrame:
    """(doc, page, id, quads): what marks a selection's ranges in page space. ``maps``: doc, page and the affine
    ``display`` of each page; pages whose map can't be turned round have none."""
    by_page = display_quads(ranges, numbered).groupBy(*PAGE, "id").agg(F.array_sort(F.collect_list(F.struct("line_no", "quads"))).alias("_l"))
    quads = by_page.select(*PAGE, "id", F.flatten(F.transform("_l", lambda x: x["quads"])).alias("quads"))
    back = quads.join(maps.select(*PAGE, G.inverse(F.col("display")).alias("_back")), PAGE).where("_back is not null")
    return back.select(*PAGE, "id", F.transform("quads", lambda q: G.moved_quad(q, F.col("_back"))).alias("quads"))

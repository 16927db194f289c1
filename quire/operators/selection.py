"""Text runs, selections and hit tests on them. Places in texts are UTF-16 units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as G
from ..functions.text import utf16_length, utf16_slice
from ..limits import GLYPHS_PER_PAGE, PAGE_TEXT_UNITS, SELECTION_UNITS

PAGE = ["doc_id", "page_index"]


def uniform_advances(lo: Column, hi: Column) -> Column:
    return F.array_repeat(F.lit(1.0), (hi - lo).cast("int"))


def quads_for_ranges(ranges: DataFrame, runs: DataFrame) -> DataFrame:
    """The quads of text ranges: each of ``ranges`` (doc, page, lo, hi, ...) with every run of its page that
    it meets, and the part of the run's quad that it covers, in run order.

    ``runs``: doc, page, run_lo, run_hi, quad, advances. The page is the join's key; the overlap narrows it.
    """
    met = ranges.join(runs, PAGE).where((F.col("lo") < F.col("run_hi")) & (F.col("run_lo") < F.col("hi")))
    a = (F.greatest("lo", "run_lo") - F.col("run_lo")).cast("int")
    b = (F.least("hi", "run_hi") - F.col("run_lo")).cast("int")
    return met.withColumn("part", G.part_of_quad(F.col("quad"), F.col("advances"), a, b))


def cut_text(text: Column, units: int = PAGE_TEXT_UNITS) -> Column:
    """A text's first UTF-16 units, without a last character that would be parted: half a pair, a letter whose
    marks follow, a line break of two."""
    short = F.substring(text, 1, units)  # as many characters hold the wanted units
    raw = F.encode(short, "UTF-16BE")
    half = F.hex(F.substring(raw, 2 * units - 1, 1)).between("D8", "DB")
    cut = F.decode(F.substring(raw, F.lit(1), F.when(half, 2 * units - 2).otherwise(2 * units)), "UTF-16BE")
    after = F.substring(text, F.length(cut) + 1, F.lit(1))
    parted = after.rlike(r"^[\p{M}\x{200D}]") | ((after == "\n") & cut.endswith("\r"))
    return F.when(utf16_length(text) <= units, text).when(parted, F.regexp_replace(cut, r"(?s)(\r|\P{M}\p{M}*)\z", "")).otherwise(cut)


def sanitize_runs(runs: DataFrame, pages: DataFrame, glyph_cap: int = GLYPHS_PER_PAGE, text_cap: int = PAGE_TEXT_UNITS) -> DataFrame:
    """Runs (doc, page, seq, run_lo, run_hi, quad, advances, ...) of a foreign page made safe, with their run_no.

    In this order: runs without a finite quad go; ranges are cut to the page's text (``pages``: doc, page, text,
    itself cut by ``cut_text``), and with them the advances; advances that then are too few or too many,
    negative or not finite become 1 a unit; from the run on that would exceed the page's cap all go; a page whose
    starts go back somewhere is sorted by (run_lo, run_hi, seq). Runs of unknown pages and of null texts go, null advances are none.
    """
    size = pages.select(*PAGE, F.coalesce(utf16_length(cut_text(F.col("text"), text_cap)), F.lit(0)).alias("_n"))
    out = runs.where(F.forall("quad", lambda p: G.finite(p["x"], p["y"]))).join(size, PAGE)
    lo = F.least(F.greatest(F.col("run_lo"), F.lit(0)), F.col("_n"))
    out = out.withColumns({"_lo": lo, "_hi": F.least(F.greatest(F.col("run_hi"), lo), F.col("_n"))}).where("_lo < _hi")
    n, given = (F.col("_hi") - F.col("_lo")).cast("int"), F.coalesce("advances", F.array().cast("array<double>"))
    skip = F.greatest(F.col("_lo") - F.col("run_lo"), F.lit(0)).cast("int")
    less = (F.col("_lo") != F.col("run_lo")) | (F.col("_hi") != F.col("run_hi"))
    out = out.withColumn("advances", F.when(less & (skip + n <= F.size(given)), F.slice(given, skip + 1, n)).otherwise(given))
    sound = (F.size("advances") == n) & F.forall("advances", lambda x: G.finite(x) & (x >= 0))
    out = out.withColumn("advances", F.when(sound, F.col("advances")).otherwise(uniform_advances(F.col("_lo"), F.col("_hi"))))
    in_turn = W.partitionBy(*PAGE).orderBy("seq")
    out = out.withColumn("_sum", F.sum(n).over(in_turn.rowsBetween(W.unboundedPreceding, W.currentRow))).where(F.col("_sum") <= glyph_cap)
    out = out.withColumn("_back", F.coalesce(F.lag("_lo").over(in_turn) > F.col("_lo"), F.lit(False)))
    out = out.withColumn("_back", F.max("_back").over(W.partitionBy(*PAGE)))
    order = W.partitionBy(*PAGE).orderBy(F.when(F.col("_back"), F.col("_lo")), F.when(F.col("_back"), F.col("_hi")), "seq")
    out = out.withColumn("run_no", F.row_number().over(order) - 1)
    return out.drop("run_lo", "run_hi", "_n", "_sum", "_back").withColumnsRenamed({"_lo": "run_lo", "_hi": "run_hi"})


def normal_selection(start_page, start_offset, end_page, end_offset) -> Column:
    """A selection with its ends in order."""
    a = F.struct(start_page.alias("page"), start_offset.alias("offset"))
    b = F.struct(end_page.alias("page"), end_offset.alias("offset"))
    return F.struct(F.least(a, b).alias("start"), F.greatest(a, b).alias("end"))


def page_ranges(selections: DataFrame, pages: DataFrame) -> DataFrame:
    """Each page a selection meets with the range it has there: clamped at its ends, whole between them.

    ``selections``: doc_id, selection (as by ``normal_selection``); ``pages``: doc_id, page_index, text.
    """
    s, e = F.col("selection.start"), F.col("selection.end")
    met = selections.join(pages, "doc_id").where((F.col("page_index") >= s["page"]) & (F.col("page_index") <= e["page"]))
    n = utf16_length(F.col("text"))
    lo = F.when(F.col("page_index") == s["page"], F.least(F.greatest(s["offset"], F.lit(0)), n)).otherwise(0)
    hi = F.when(F.col("page_index") == e["page"], F.least(F.greatest(e["offset"], F.lit(0)), n)).otherwise(n)
    return met.withColumns({"lo": lo.cast("int"), "hi": F.greatest(lo, hi).cast("int")})


def selected_strings(ranges: DataFrame, cap: int = SELECTION_UNITS) -> DataFrame:
    """The text of each document's selection: fragments by page, joined by line breaks, cut to whole characters of at
    most ``cap`` units."""
    part = F.coalesce(utf16_slice(F.col("text"), F.col("lo"), F.col("hi")), F.lit(""))
    parts = ranges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_index", part.alias("part")))).alias("parts"))
    joined = parts.select("doc_id", F.array_join(F.transform("parts", lambda x: x["part"]), "\n").alias("_all"))
    return joined.select("doc_id", cut_text(F.col("_all"), cap).alias("selected"))


def changed_pages(old: Column, new: Column, ends: Column) -> Column:
    """Pages to redraw: those of either selection but not both, and those where the new one ends."""
    return F.array_sort(F.array_union(F.array_union(F.array_except(old, new), F.array_except(new, old)), ends))


def text_lines(pages: DataFrame) -> DataFrame:
    """(doc, page, line_no, lo, hi) of the lines of each page's text, cut at LF, CR, LS and PS."""
    parts = pages.select(*PAGE, F.posexplode(F.split("text", "[\n\r  ]")).alias("line_no", "_t"))
    before = F.sum(utf16_length(F.col("_t")) + 1).over(W.partitionBy(*PAGE).orderBy("line_no").rowsBetween(W.unboundedPreceding, -1))
    lo = F.coalesce(before, F.lit(0))
    return parts.select(*PAGE, "line_no", lo.alias("lo"), (lo + utf16_length(F.col("_t"))).alias("hi"))


def line_of_offset(offsets: DataFrame, lines: DataFrame) -> DataFrame:
    """Each offset with its line: the last that starts at or before it; the first one for what lies before.
    Lines and offsets of a page meet in one window. ``offsets``: doc, page, id, offset."""
    starts = lines.select(*PAGE, F.col("lo").cast("bigint").alias("_at"), F.lit(0).alias("_kind"), F.struct("line_no", "lo", "hi").alias("line"))
    asked = offsets.select(*PAGE, "id", "offset", F.col("offset").cast("bigint").alias("_at"), F.lit(1).alias("_kind"))
    order = W.partitionBy(*PAGE).orderBy("_at", "_kind")
    met = asked.unionByName(starts, allowMissingColumns=True)
    up_to, all_of = order.rowsBetween(W.unboundedPreceding, W.currentRow), order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    met = met.withColumns({"_last": F.last("line", ignorenulls=True).over(up_to), "_first": F.first("line", ignorenulls=True).over(all_of)})
    return met.where("_kind = 1 and _first is not null").select(*PAGE, "id", "offset", F.coalesce("_last", "_first").alias("line"))


def hit_test(points: DataFrame, lines: DataFrame, window: int = 4) -> DataFrame:
    """Each point with the nearest line of its page by the distance to the line's band, and the nearest end
    among the line's characters.

    ``lines``: doc, page, line_no, lo, hi, y0, y1, x0, advance (of each character). Ties go to the earlier
    line and the later place. Only lines within ``window`` of the nearest in vertical order are ranked by the
    full distance.
    """
    met = points.join(lines, PAGE)
    band = F.greatest(F.lit(0.0), F.col("y0") - F.col("y"), F.col("y") - F.col("y1"))
    n = F.col("hi") - F.col("lo")
    end = F.col("x0") + n * F.col("advance")
    along = F.greatest(F.lit(0.0), F.col("x0") - F.col("x"), F.col("x") - end)
    met = met.withColumns({"_band": band, "_full": band + along})
    by = W.partitionBy(*PAGE, "id")
    met = met.withColumn("_near", F.min(F.struct("_band", "line_no")).over(by)["line_no"])
    met = met.where(F.abs(F.col("line_no") - F.col("_near")) <= window)
    first = met.withColumn("_rank", F.row_number().over(by.orderBy("_full", "line_no"))).where("_rank = 1")
    place = F.floor((F.col("x") - F.col("x0")) / F.col("advance") + 0.5)
    return first.select(*PAGE, "id", "line_no", (F.col("lo") + F.least(F.greatest(place, F.lit(0)), n)).alias("offset"))


def merged_quads(parts: DataFrame) -> DataFrame:
    """Rectangles of one line and id as one: doc, page, id, line_no and x, y, w, h of the union."""
    x1, y1 = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    out = parts.groupBy(*PAGE, "id", "line_no").agg(F.min("x").alias("x"), F.min("y").alias("y"), x1.alias("_x1"), y1.alias("_y1"))
    return out.select(*PAGE, "id", "line_no", "x", "y", (F.col("_x1") - F.col("x")).alias("w"), (F.col("_y1") - F.col("y")).alias("h"))

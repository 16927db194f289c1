"""Reading order: positioned text runs to lines, columns and page text.

Runs: doc_id, page_index, emit_idx, text, x, y (origin), dx, dy (direction), size (font size), width (sum of
advances), vertical. Comparisons are with the previous item of a total order, so windows express them.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..shared import written

#: The columns of runs that reading order needs.
RUN = ["page_index", "emit_idx", "text", "x", "y", "dx", "dy", "size", "width", "vertical"]
PAGE = ["doc_id", "page_index"]
CLASS = [*PAGE, "angle", "vertical"]
LINE = [*CLASS, "line_no"]
LINE_SHARE, SPACE_SHARE, SEGMENT_SHARE = 0.5, 0.15, 1.0
WIDE_SHARE, NARROW_SHARE, ANCHOR_SIZES = 0.6, 0.2, 3.0
EARLIER = (W.unboundedPreceding, W.currentRow)


def reference_percentile(values: Column, q: float) -> Column:
    """The value at index round(q (n - 1)) of the sorted values."""
    return F.element_at(F.sort_array(values), (F.round((F.size(values) - 1) * F.lit(q)) + 1).cast("int"))


def oriented(runs: DataFrame) -> DataFrame:
    """Runs with their angle class (whole degrees) and their place along and across its direction."""
    angle = F.round(F.degrees(F.atan2(F.col("dy"), F.col("dx")))).cast("int")
    length = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    # divided last, so that places on one line across or along the direction stay equal
    places = {"along": (F.col("x") * F.col("dx") + F.col("y") * F.col("dy"), F.col("x")), "across": (F.col("y") * F.col("dx") - F.col("x") * F.col("dy"), F.col("y"))}
    out = runs.withColumn("angle", F.when(F.col("vertical"), 0).otherwise(angle))
    out = out.withColumns({c: F.when(length > 0, v / length).otherwise(plain) for c, (v, plain) in places.items()})
    return out.withColumn("class_first", F.min("emit_idx").over(W.partitionBy(*CLASS)))


def lines(runs: DataFrame) -> DataFrame:
    """Runs with line_no (0 at the top) and their place in the line.

    Sorted across the direction, a run joins the line of the one before it if they are at most half the
    smaller font size apart, so lines may chain.
    """
    order = W.partitionBy(*CLASS).orderBy("across", "emit_idx")
    near = F.col("across") - F.lag("across").over(order) <= LINE_SHARE * F.least("size", F.lag("size").over(order))
    out = oriented(runs).withColumn("_near", near).withColumn("cluster_pos", F.row_number().over(order))
    up = F.sum(F.when(F.coalesce("_near", F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(*EARLIER))
    out = out.withColumn("_up", up)
    out = out.withColumn("line_no", (F.max("_up").over(W.partitionBy(*CLASS)) - F.col("_up")).cast("int"))
    place = F.row_number().over(W.partitionBy(*LINE).orderBy("along", "cluster_pos")) - 1
    return out.withColumn("line_pos", place).drop("_near", "_up")


def in_line(column: str) -> Column:
    return F.lag(column).over(W.partitionBy(*LINE).orderBy("line_pos"))


def spaced(runs: DataFrame) -> DataFrame:
    """Runs of ``lines`` with ``space``: whether the gap before them, over 15 % of the smaller font, is one;
    and ``segment_no``: gaps over one font size start a new segment of the line."""
    gap = F.col("along") - (in_line("along") + in_line("width"))
    small = F.least("size", in_line("size"))
    out = runs.withColumns({"space": F.coalesce(gap > SPACE_SHARE * small, F.lit(False)), "_cut": F.coalesce(gap > SEGMENT_SHARE * small, F.lit(False))})
    number = F.sum(F.col("_cut").cast("int")).over(W.partitionBy(*LINE).orderBy("line_pos").rowsBetween(*EARLIER))
    return out.withColumn("segment_no", number.cast("int")).drop("_cut")


def page_texts(runs: DataFrame, columns: bool = False) -> DataFrame:
    """(doc_id, page_index, text, runs): lines joined by line breaks, spaces inserted, and each run's range.

    Classes of direction follow one another by their first run. With ``columns``, columns are detected and
    read one after the other; without, lines are read from top to bottom.
    """
    own = spaced(lines(runs))
    if not columns:
        own = own.withColumn("read_pos", F.struct(F.lit(0).alias("band"), F.lit(0).alias("col"), F.col("line_no").alias("line")))
    else:
        own = written(own, "spaced-runs")  # read several times
        own = own.join(columns_of(own), [*LINE, "segment_no"])
        own = own.withColumn("space", F.col("space") & (F.col("read_pos") == F.lag("read_pos").over(W.partitionBy(*LINE).orderBy("line_pos"))))
    order = W.partitionBy(*PAGE).orderBy("class_first", "read_pos", "line_pos")
    new = F.coalesce((F.lag("class_first").over(order) != F.col("class_first")) | (F.lag("read_pos").over(order) != F.col("read_pos")), F.lit(False))
    sep = F.when(new, "\n").when(F.col("space"), " ").otherwise("")
    own = own.withColumn("_sep", sep).withColumn("_n", F.length("text"))
    own = own.withColumn("hi", F.sum(F.col("_n") + F.length("_sep")).over(order.rowsBetween(*EARLIER)))
    own = own.withColumn("lo", F.col("hi") - F.col("_n"))
    parts = F.array_sort(F.collect_list(F.struct("lo", "hi", "emit_idx", F.concat("_sep", "text").alias("part"))))
    out = own.groupBy(*PAGE).agg(parts.alias("p"))
    return out.select(*PAGE, F.array_join(F.transform("p", lambda x: x["part"]), "").alias("text"), F.transform("p", lambda x: F.struct(x["lo"], x["hi"], x["emit_idx"])).alias("runs"))


def segments(runs: DataFrame) -> DataFrame:
    """(class, line_no, segment_no, start, end, size, emit_idx) of the segments of ``spaced`` runs."""
    return runs.groupBy(*LINE, "segment_no").agg(
        F.min("along").alias("start"),
        F.max(F.col("along") + F.col("width")).alias("end"),
        F.max("size").alias("size"),
        F.min("emit_idx").alias("emit_idx"),
    )


def reliable_advances(runs: DataFrame) -> DataFrame:
    """(class, reliable): whether the lower quartile of width to span over the lines is at least one half."""
    spans = runs.groupBy(*LINE).agg((F.sum("width") / F.nullif(F.max(F.col("along") + F.col("width")) - F.min("along"), F.lit(0.0))).alias("share"))
    return spans.groupBy(*CLASS).agg(F.coalesce(reference_percentile(F.collect_list("share"), 0.25) >= 0.5, F.lit(False)).alias("reliable"))


def class_bounds(segs: DataFrame) -> DataFrame:
    """(class, left, right, anchor): p5 of the starts, p95 of the ends, and three median font sizes. Classes of
    one line, or without extent, have no row."""
    out = segs.groupBy(*CLASS).agg(
        reference_percentile(F.collect_list("start"), 0.05).alias("left"),
        reference_percentile(F.collect_list("end"), 0.95).alias("right"),
        (F.median("size") * ANCHOR_SIZES).alias("anchor"),
        F.count_distinct("line_no").alias("n"),
    )
    return out.where("n > 1 and right > left").drop("n")


def gutters(intervals: DataFrame, by: list[str], tolerance: Column | int, least: Column) -> DataFrame:
    """(by, from, to) of the gaps of at least ``least`` in which at most ``tolerance`` intervals overlap,
    strictly inside the band that the intervals take.

    A sweep: starts and ends are events, ends first at one place, and events are added up by place before the
    running sum, so the order within a place cannot matter.
    """
    tolerance = F.lit(tolerance) if isinstance(tolerance, int) else tolerance
    ends = intervals.select(*by, F.col("end").alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("d"))
    events = intervals.select(*by, F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("d")).unionByName(ends)
    events = events.groupBy(*by, "at", "kind").agg(F.sum("d").alias("d"))
    order = W.partitionBy(*by).orderBy("at", "kind")
    events = events.withColumn("cover", F.sum("d").over(order.rowsBetween(*EARLIER)))
    events = events.withColumn("before", F.col("cover") - F.col("d"))
    crossing = events.where(((F.col("cover") <= tolerance) & (F.col("before") > tolerance)) | ((F.col("cover") > tolerance) & (F.col("before") <= tolerance)))
    spans = crossing.withColumns({"to": F.lead("at").over(order), "from": F.col("at"), "opens": F.col("cover") <= tolerance})
    return spans.where(F.col("opens") & F.col("to").isNotNull() & (F.col("to") - F.col("from") >= least)).select(*by, "from", "to")


def peak_coverage(intervals: DataFrame, by: list[str]) -> DataFrame:
    """(by, peak): the most intervals at one place."""
    ends = intervals.select(*by, F.col("end").alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("d"))
    events = intervals.select(*by, F.col("start").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("d")).unionByName(ends)
    events = events.groupBy(*by, "at", "kind").agg(F.sum("d").alias("d"))
    cover = F.sum("d").over(W.partitionBy(*by).orderBy("at", "kind").rowsBetween(*EARLIER))
    return events.withColumn("c", cover).groupBy(*by).agg(F.max("c").alias("peak"))


def tolerant_gutters(intervals: DataFrame, by: list[str], least: Column) -> DataFrame:
    """(by, tolerance, from, to): gutters at the first of the tolerances 0, 1, 2, 4, ... and at last half the peak
    (1 at least) that gives any."""
    peak = peak_coverage(intervals, by).withColumn("most", F.greatest(F.lit(1), F.floor(F.col("peak") / 2)))
    steps = F.concat(F.array(F.lit(0)), F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int")))
    tried = peak.select(*by, F.explode(F.array_union(F.filter(steps, lambda t: t < F.col("most")), F.array(F.col("most").cast("int")))).alias("tolerance"))
    some = intervals.join(tried, by)
    found = gutters(some, [*by, "tolerance"], F.col("tolerance"), least)
    first = found.groupBy(*by).agg(F.min("tolerance").alias("tolerance"))
    return found.join(first, [*by, "tolerance"])


def merge_narrow(centres: list[float], segments: list[tuple[float, float]], least: float) -> list[float]:
    """Gutter centres after the first column narrower than ``least`` was merged, again and again.

    A column is as wide as its segments (start, end) reach; those that cross one of the given gutters don't
    count, and one without any has no width and lies midway between its gutters. It merges across the
    gutter to the neighbour with the nearer middle, the left one on a tie.
    """
    cuts = sorted(centres)
    whole = [(a, b) for a, b in segments if not any(a < c < b for c in cuts)]
    while cuts:
        spans: list[list[tuple[float, float]]] = [[] for _ in range(len(cuts) + 1)]
        for a, b in whole:
            spans[bisect_left(cuts, (a + b) / 2)].append((a, b))
        ends = [(min(a for a, _ in s), max(b for _, b in s)) if s else None for s in spans]
        k = next((i for i, e in enumerate(ends) if e is None or e[1] - e[0] < least), None)
        if k is None:
            break
        middle = [sum(e) / 2 if e else (cuts[max(i - 1, 0)] + cuts[min(i, len(cuts) - 1)]) / 2 for i, e in enumerate(ends)]
        right_is_nearer = 0 < k < len(cuts) and middle[k + 1] - middle[k] < abs(middle[k] - middle[k - 1])
        cuts.pop(0 if k == 0 else k if right_is_nearer else k - 1)
    return cuts


def reading_positions(segs: DataFrame, bounds: DataFrame, cuts: DataFrame) -> DataFrame:
    """``read_pos`` of each segment: bands from top to bottom, within a band columns from left to right.

    ``cuts``: class and ``centres`` (sorted gutter centres; classes without any read line by line). A segment
    that crosses a gutter parts the page, unless it starts at its column's left edge and ends short of the
    right margin: then it is an overrun and belongs to the column of its start.
    """
    met = segs.join(bounds, CLASS, "left").join(cuts, CLASS, "left")
    met = met.withColumn("centres", F.coalesce("centres", F.array().cast("array<double>")))
    column = lambda at: F.size(F.filter("centres", lambda c: c < at))
    met = met.withColumn("crosses", F.exists("centres", lambda c: (F.col("start") < c) & (c < F.col("end"))))
    met = met.withColumn("start_col", column(F.col("start")))
    edge = F.min(F.when(~F.col("crosses"), F.col("start"))).over(W.partitionBy(*CLASS, "start_col"))
    at_edge = F.abs(F.col("start") - edge) <= F.col("anchor")
    at_margin = F.abs(F.col("end") - F.col("right")) <= F.col("anchor")
    met = met.withColumn("overrun", F.col("crosses") & F.coalesce(at_edge & ~at_margin, F.lit(False)))
    met = met.withColumn("parts", F.max(F.col("crosses") & ~F.col("overrun")).over(W.partitionBy(*LINE)))
    by_line = met.groupBy(*LINE).agg(F.first("parts").alias("parts"))
    order = W.partitionBy(*CLASS).orderBy("line_no")
    flip = F.coalesce(F.lag("parts").over(order) != F.col("parts"), F.lit(False))
    bands = by_line.withColumn("_f", flip).withColumn("band", F.sum(F.col("_f").cast("int")).over(order.rowsBetween(*EARLIER)))
    met = met.join(bands.select(*LINE, "band"), LINE)
    col = F.when(F.col("parts"), 0).when(F.col("overrun"), F.col("start_col")).otherwise(column((F.col("start") + F.col("end")) / 2))
    pos = F.struct(F.col("band").cast("int").alias("band"), col.cast("int").alias("col"), F.col("line_no").alias("line"))
    return met.select(*LINE, "segment_no", pos.alias("read_pos"), "crosses", "overrun", "parts")


def columns_of(own: DataFrame) -> DataFrame:
    """Reading positions (class, line, segment to ``read_pos``) of all segments of ``spaced`` runs.

    Wide segments (60 % of the extent) don't take part in the search for gutters. Where advances are not
    reliable, or no gutter is found, lines are read as they are.
    """
    segs = written(segments(own), "segments")
    bounds = written(class_bounds(segs).join(reliable_advances(own).where("reliable").select(*CLASS), CLASS), "bounds")
    extent = F.col("right") - F.col("left")
    narrow = segs.join(bounds, CLASS).where(F.col("end") - F.col("start") < WIDE_SHARE * extent)
    median = segs.groupBy(*CLASS).agg(F.median("size").alias("m"))  # a gutter is at least that wide
    found = tolerant_gutters(narrow.join(median, CLASS).select(*CLASS, "m", "start", "end"), [*CLASS, "m"], F.col("m"))
    centres = found.groupBy(*CLASS).agg(F.array_sort(F.collect_list((F.col("from") + F.col("to")) / 2)).alias("centres"))
    ends = narrow.groupBy(*CLASS, "left", "right").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    centres = centres.join(ends, CLASS)
    kinds = ", ".join(f"{c} {t}" for c, t in centres.dtypes if c in CLASS)

    def merge(batches):
        for pdf in batches:
            columns = (pdf[c] for c in ("centres", "starts", "ends", "left", "right"))
            pdf["centres"] = [merge_narrow(list(c), list(zip(s, e, strict=True)), NARROW_SHARE * (b - a)) for c, s, e, a, b in zip(*columns, strict=True)]
            yield pdf[[*CLASS, "centres"]]

    cuts = written(centres.mapInPandas(merge, f"{kinds}, centres array<double>"), "cuts")
    return written(reading_positions(segs, bounds, cuts).select(*LINE, "segment_no", "read_pos"), "reading")

"""Vertical page layout, tiles at scales, and the queue of requests for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..limits import TILE_KEYS

INSET, SPACING, LONGEST = 12.0, 12.0, 50_000.0
TILE = 512.0
PREFETCH, PREVIEWS = 0.5, 3


def side(v: Column) -> Column:
    return F.least(F.greatest(v.cast("double"), F.lit(1.0)), F.lit(LONGEST))


def page_frames(pages: DataFrame) -> DataFrame:
    """(doc_id, page_index, x, y, w, h): pages below one another, centred on the widest.

    ``pages``: doc_id, page_index, w, h; sides are kept between 1 and 50,000.
    """
    sized = pages.select("doc_id", "page_index", side(F.col("w")).alias("w"), side(F.col("h")).alias("h"))
    doc = W.partitionBy("doc_id")
    before = F.sum(F.col("h") + SPACING).over(doc.orderBy("page_index").rowsBetween(W.unboundedPreceding, -1))
    y = F.lit(INSET) + F.coalesce(before, F.lit(0.0))
    x = F.lit(INSET) + (F.max("w").over(doc) - F.col("w")) / 2
    return sized.select("doc_id", "page_index", x.alias("x"), y.alias("y"), "w", "h")


def page_at_y(points: DataFrame, frames: DataFrame) -> DataFrame:
    """Each y (doc_id, id, y) with its page: the first that ends below it, so a gap belongs to the next page;
    above the first page the first, below the last one the last."""
    kinds = dict(points.dtypes)
    ends = frames.select("doc_id", F.lit(None).cast(kinds["id"]).alias("id"), F.lit(None).cast(kinds["y"]).alias("y"), (F.col("y") + F.col("h")).alias("_at"), F.lit(0).alias("_kind"), "page_index")
    asked = points.select("doc_id", "id", "y", F.col("y").cast("double").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(dict(frames.dtypes)["page_index"]).alias("page_index"))
    both, doc = ends.unionByName(asked), W.partitionBy("doc_id")
    order = doc.orderBy(F.desc("_at"), "_kind", F.desc("page_index"))  # ends below first, of one place the first page last
    found = both.withColumns({"_a": F.last("page_index", ignorenulls=True).over(order), "_b": F.max("page_index").over(doc)})
    found = found.where("_kind = 1 and _b is not null")
    return found.select("doc_id", "id", "y", F.when(F.col("y").isNull(), F.col("_b")).otherwise(F.coalesce("_a", "_b")).alias("page_index"))


def visible_parts(views: DataFrame, frames: DataFrame) -> DataFrame:
    """The pages each view (doc_id, id, vx, vy, vw, vh) shows, and the rectangle of each, in page space. A view
    meets only the pages from its top to its bottom."""
    numbered = views.withColumn("_n", F.struct("id", "vx", "vy", "vw", "vh"))
    ends = numbered.select("doc_id", F.col("_n").alias("id"), F.explode(F.array("vy", F.col("vy") + F.col("vh"))).alias("y"))
    span = page_at_y(ends, frames).groupBy("doc_id", "id").agg(F.min("page_index").alias("_a"), F.max("page_index").alias("_b"))
    span = span.select("doc_id", "id.*", F.explode(F.sequence("_a", "_b")).alias("page_index"))
    met = span.join(frames, ["doc_id", "page_index"])
    x0, y0 = F.greatest("vx", "x"), F.greatest("vy", "y")
    x1, y1 = F.least(F.col("vx") + F.col("vw"), F.col("x") + F.col("w")), F.least(F.col("vy") + F.col("vh"), F.col("y") + F.col("h"))
    met = met.where((x1 > x0) & (y1 > y0))
    return met.select("doc_id", "id", "page_index", (x0 - F.col("x")).alias("px"), (y0 - F.col("y")).alias("py"), (x1 - x0).alias("pw"), (y1 - y0).alias("ph"))


def current_page(views: DataFrame, frames: DataFrame) -> DataFrame:
    """(doc_id, id, page_index): the page at the middle of each view (doc_id, id, vy, vh)."""
    middles = views.select("doc_id", "id", (F.col("vy") + F.col("vh") / 2).alias("y"))
    return page_at_y(middles, frames).select("doc_id", "id", "page_index")


def near_range(first: Column, last: Column, count: Column, margin: int = 2) -> Column:
    """The pages to keep ready around those on show."""
    return F.struct(F.greatest(first - margin, F.lit(0)).alias("lo"), F.least(last + margin, count - 1).alias("hi"))


def scale_bucket(scale: Column) -> Column:
    """Half octaves of a scale, -8 to 12; 0 for what isn't a positive finite number."""
    ok = (scale > 0) & (scale < float("inf")) & ~F.isnan(scale)
    return F.when(ok, F.least(F.greatest(F.round(F.log2(scale) * 2), F.lit(-8.0)), F.lit(12.0))).otherwise(0.0).cast("int")


def bucket_scale(bucket: Column) -> Column:
    return F.pow(F.lit(2.0), bucket / 2)


def tile_side(bucket: Column) -> Column:
    return F.lit(TILE) / bucket_scale(bucket)


def tile_count(length: Column, bucket: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(length / tile_side(bucket))).cast("int")


def tiles(rects: DataFrame, cap: int = TILE_KEYS) -> DataFrame:
    """The tiles that rectangles (id, w, h, bucket, rx, ry, rw, rh) of pages meet, row by row, each clipped to
    the page; the first ``cap`` of each rectangle."""
    s, eps = tile_side(F.col("bucket")), 1e-6

    def first_last(start, length, count):
        lo = F.greatest(F.floor((start + eps) / s), F.lit(0)).cast("int")
        hi = F.least(F.ceil((start + length - eps) / s).cast("int") - 1, count - 1)
        return lo, hi

    cols, rows = tile_count(F.col("w"), F.col("bucket")), tile_count(F.col("h"), F.col("bucket"))
    c0, c1 = first_last(F.col("rx"), F.col("rw"), cols)
    r0, r1 = first_last(F.col("ry"), F.col("rh"), rows)
    some = rects.where((F.col("rw") > 0) & (F.col("rh") > 0)).withColumns({"c0": c0, "c1": c1, "r0": r0, "r1": r1}).where("c1 >= c0 and r1 >= r0")
    width = F.col("c1") - F.col("c0") + 1
    n = F.least(width.cast("bigint") * (F.col("r1") - F.col("r0") + 1), F.lit(cap))
    each = some.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    each = each.withColumns({"tile_col": (F.col("c0") + F.col("_k") % width).cast("int"), "tile_row": (F.col("r0") + F.floor(F.col("_k") / width)).cast("int")})
    x, y = F.col("tile_col") * s, F.col("tile_row") * s
    return each.select("id", "tile_col", "tile_row", x.alias("x"), y.alias("y"), F.least(s, F.col("w") - x).alias("tw"), F.least(s, F.col("h") - y).alias("th"))


def desired(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """The union of key sets with their priorities; of one key the highest."""
    out = None
    for keys, priority in parts:
        own = keys.select("key", F.lit(priority).alias("priority"))
        out = own if out is None else out.unionByName(own)
    return out.groupBy("key").agg(F.max("priority").alias("priority"))


def enqueue(requests: DataFrame) -> DataFrame:
    """The buffer after all requests (seq, key, priority): a key keeps its first seq and its highest priority."""
    return requests.groupBy("key").agg(F.max("priority").alias("priority"), F.min("seq").alias("seq"))


def dequeue_order(buffer: DataFrame, parts: str | None = None) -> DataFrame:
    """The order in which requests leave: by priority, then first come first served.

    ``parts``: a column that separates independent queues, which keeps each queue's order in one task only.
    """
    window = (W.partitionBy(parts) if parts else W.partitionBy()).orderBy(F.desc("priority"), "seq")
    return buffer.withColumn("place", F.row_number().over(window))


def keep_desired(buffer: DataFrame, wanted: DataFrame, always: DataFrame | None = None) -> DataFrame:
    """The requests whose key is wanted or always kept."""
    keep = wanted.select("key") if always is None else wanted.select("key").unionByName(always.select("key"))
    return buffer.join(keep.distinct(), "key", "left_semi")


def without_keys(buffer: DataFrame, keys: DataFrame) -> DataFrame:
    return buffer.join(keys.select("key"), "key", "left_anti")


def prefetch_tiles(views: DataFrame, frames: DataFrame) -> DataFrame:
    """(doc_id, id, page_index, tile_col, tile_row) to make ready beside what views (doc_id, id, vx, vy, vw, vh, bucket)
    show: half a view above and below on the shown pages, and what of it passes a page's edge as a strip of the
    neighbour that isn't shown. Tiles on show are left out."""
    shown = visible_parts(views, frames)
    sized = shown.join(views.select("doc_id", "id", "bucket", (F.col("vh") * PREFETCH).alias("_m")), ["doc_id", "id"])
    sized = sized.join(frames.select("doc_id", "page_index", "w", "h"), ["doc_id", "page_index"])
    top, bottom = F.col("py") - F.col("_m"), F.col("py") + F.col("ph") + F.col("_m")
    y0, y1 = F.greatest(top, F.lit(0.0)), F.least(bottom, F.col("h"))
    key = ["doc_id", "id", "page_index"]
    own = sized.select(*key, "bucket", "w", "h", F.col("px").alias("rx"), y0.alias("ry"), F.col("pw").alias("rw"), (y1 - y0).alias("rh"))
    over = F.array(F.struct(F.lit(-1).alias("to"), (-top).alias("by")), F.struct(F.lit(1).alias("to"), (bottom - F.col("h")).alias("by")))
    spill = sized.select("doc_id", "id", "bucket", "px", "pw", "page_index", F.explode(over).alias("o")).where("o.by > 0")
    spill = spill.select("doc_id", "id", (F.col("page_index") + F.col("o.to")).alias("page_index"), "bucket", "px", "pw", "o.*").join(shown.select(*key), key, "left_anti")
    spill = spill.join(frames.select("doc_id", "page_index", "w", "h"), ["doc_id", "page_index"]).withColumn("by", F.least("by", "h"))
    ry = F.when(F.col("to") < 0, F.col("h") - F.col("by")).otherwise(0.0)
    strips = spill.select(*key, "bucket", "w", "h", F.col("px").alias("rx"), ry.alias("ry"), F.col("pw").alias("rw"), F.col("by").alias("rh"))
    on_show = sized.select(*key, "bucket", "w", "h", F.col("px").alias("rx"), F.col("py").alias("ry"), F.col("pw").alias("rw"), F.col("ph").alias("rh"))
    every = own.withColumn("_seen", F.lit(0)).unionByName(strips.withColumn("_seen", F.lit(0))).unionByName(on_show.withColumn("_seen", F.lit(1)))
    found = tiles(every.withColumn("id", F.struct(*key, "_seen")))
    once = found.select("id.*", "tile_col", "tile_row").groupBy(*key, "tile_col", "tile_row").agg(F.max("_seen").alias("_seen"))
    return once.where("_seen = 0").drop("_seen")


def prefetch_previews(views: DataFrame, frames: DataFrame) -> DataFrame:
    """(doc_id, id, page_index): the pages within three of those on show that are not on show."""
    shown = visible_parts(views, frames).select("doc_id", "id", "page_index")
    span = shown.groupBy("doc_id", "id").agg(F.min("page_index").alias("_a"), F.max("page_index").alias("_b"))
    near = span.select("doc_id", "id", F.explode(F.sequence(F.col("_a") - PREVIEWS, F.col("_b") + PREVIEWS)).alias("page_index"))
    real = near.join(frames.select("doc_id", "page_index"), ["doc_id", "page_index"], "left_semi")
    return real.join(shown, ["doc_id", "id", "page_index"], "left_anti")


def capture(y: Column, frame_y: Column, frame_h: Column) -> Column:
    """The place on a page, 0 to 1, that a content y shows."""
    return F.least(F.greatest((y - frame_y) / frame_h, F.lit(0.0)), F.lit(1.0))


def restore(offset: Column, frame_y: Column, frame_h: Column) -> Column:
    return frame_y + offset * frame_h


def fit_width(view: Column, widest: Column) -> Column:
    """The scale at which the widest page with its insets fills a view."""
    return view / (widest + 2 * INSET)


def centred(target_lo: Column, target_hi: Column, view: Column, content: Column) -> Column:
    """Where to scroll so that a target stands in the middle of the view, within the content."""
    return F.least(F.greatest((target_lo + target_hi) / 2 - view / 2, F.lit(0.0)), F.greatest(content - view, F.lit(0.0)))

"""Rectangles, quads and page transforms as column expressions.

A rectangle is struct<x, y, w, h>, a point struct<x, y>, a quad an array of four points in order around
its outline, an affine map struct<a, b, c, d, tx, ty> with x' = a x + c y + tx and y' = b x + d y + ty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(*(v.cast("double").alias(n) for n, v in zip("xywh", (x, y, w, h), strict=True)))


def finite(*values: Column) -> Column:
    """Whether all values are finite numbers."""
    out = F.lit(True)
    for v in values:
        out = out & F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))
    return out


def normal_rect(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The rectangle between two corners in any order; null if degenerate or not finite."""
    w, h = F.abs(x1 - x0), F.abs(y1 - y0)
    return F.when(finite(x0, y0, x1, y1) & (w > 0) & (h > 0), rect(F.least(x0, x1), F.least(y0, y1), w, h))


def intersection(a: Column, b: Column) -> Column:
    """The common part of two rectangles; null if it has no area."""
    x0, y0 = F.greatest(a["x"], b["x"]), F.greatest(a["y"], b["y"])
    x1, y1 = F.least(a["x"] + a["w"], b["x"] + b["w"]), F.least(a["y"] + a["h"], b["y"] + b["h"])
    return F.when((x1 > x0) & (y1 > y0), rect(x0, y0, x1 - x0, y1 - y0))


def quad_of(r: Column) -> Column:
    """Corners of a rectangle from its origin around; negative sides are turned, not finite gives zeros."""
    x0, x1 = F.least(r["x"], r["x"] + r["w"]), F.greatest(r["x"], r["x"] + r["w"])
    y0, y1 = F.least(r["y"], r["y"] + r["h"]), F.greatest(r["y"], r["y"] + r["h"])
    zero = point(F.lit(0.0), F.lit(0.0))
    corners = F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1))
    return F.when(finite(r["x"], r["y"], r["w"], r["h"]), corners).otherwise(F.array(zero, zero, zero, zero))


def bounds(quad: Column) -> Column:
    """The smallest rectangle around a quad."""

    def box(quad):
        xs, ys = F.transform(quad, lambda p: p["x"]), F.transform(quad, lambda p: p["y"])
        x, y = F.array_min(xs), F.array_min(ys)
        return rect(x, y, F.array_max(xs) - x, F.array_max(ys) - y)

    return let(quad, box)


def rotation(value: Column) -> Column:
    """A multiple of 90 as 0, 90, 180 or 270; anything else, and null, is 0. Reals are rounded first."""
    r = F.round(value).cast("bigint")
    return F.coalesce(F.when(r % 90 == 0, F.pmod(r, F.lit(360))), F.lit(0)).cast("int")


def display_size(r: Column, turn: Column) -> Column:
    swap = turn.isin(90, 270)
    return F.struct(F.when(swap, r["h"]).otherwise(r["w"]).alias("w"), F.when(swap, r["w"]).otherwise(r["h"]).alias("h"))


def affine(*values) -> Column:
    return F.struct(*((v if isinstance(v, Column) else F.lit(float(v))).alias(n) for n, v in zip(("a", "b", "c", "d", "tx", "ty"), values, strict=True)))


def display_map(crop: Column, turn: Column) -> Column:
    """From page space (origin at the lower left, y up) to display space (upper left, y down) of a page
    that is turned clockwise."""
    x, y, w, h = (crop[k] for k in "xywh")
    return (
        F.when(turn == 90, affine(0, 1, 1, 0, -y, -x))
        .when(turn == 180, affine(-1, 0, 0, 1, x + w, -y))
        .when(turn == 270, affine(0, -1, -1, 0, y + h, x + w))
        .otherwise(affine(1, 0, 0, -1, -x, y + h))
    )


def moved(p: Column, m: Column) -> Column:
    return point(m["a"] * p["x"] + m["c"] * p["y"] + m["tx"], m["b"] * p["x"] + m["d"] * p["y"] + m["ty"])


def moved_quad(quad: Column, m: Column) -> Column:
    return F.transform(quad, lambda p: moved(p, m))


def inverse(m: Column) -> Column:
    """The inverse map; null if there is none."""

    def turned(m):
        det = m["a"] * m["d"] - m["b"] * m["c"]
        a, b, c, d = m["d"] / det, -m["b"] / det, -m["c"] / det, m["a"] / det
        return F.when(det != 0, affine(a, b, c, d, -(a * m["tx"] + c * m["ty"]), -(b * m["tx"] + d * m["ty"])))

    return let(m, turned)


def page_quad(normal: Column, crop: Column, turn: Column) -> Column:
    """The page quad of a rectangle in shares (0 to 1, not clamped) of the displayed page."""
    size = display_size(crop, turn)
    r = rect(normal["x"] * size["w"], normal["y"] * size["h"], normal["w"] * size["w"], normal["h"] * size["h"])
    return let(inverse(display_map(crop, turn)), lambda m: moved_quad(let(r, quad_of), m))


def inside(p: Column, quad: Column) -> Column:
    """Whether a point lies in a convex quad; the outline counts. A quad without extent, and values that
    are not finite, hold nothing."""
    sides = []
    for i in range(4):
        a, b = quad[i], quad[(i + 1) % 4]
        sides.append((b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"]))
    every = [p["x"], p["y"], *(quad[i][k] for i in range(4) for k in "xy")]
    up, down = F.greatest(*sides), F.least(*sides)
    return F.coalesce(finite(*every) & ((down >= 0) | (up <= 0)) & ~((down == 0) & (up == 0)), F.lit(False))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return point(a["x"] + (b["x"] - a["x"]) * t, a["y"] + (b["y"] - a["y"]) * t)


def part_of_quad(quad: Column, advances: Column, lo: Column, hi: Column) -> Column:
    """The part of a run's quad that units lo to hi take by their advances; all of it if these sum to 0."""
    total = F.aggregate(advances, F.lit(0.0), lambda s, x: s + x)
    start = F.aggregate(F.slice(advances, F.lit(1), lo), F.lit(0.0), lambda s, x: s + x)
    end = F.aggregate(F.slice(advances, F.lit(1), hi), F.lit(0.0), lambda s, x: s + x)
    a, b = start / total, end / total
    cut = F.array(lerp(quad[0], quad[1], a), lerp(quad[0], quad[1], b), lerp(quad[3], quad[2], b), lerp(quad[3], quad[2], a))
    return F.when(total > 0, cut).otherwise(quad)

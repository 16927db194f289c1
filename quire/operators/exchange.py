"""What applications keep between sessions, as JSON: quads, highlights, selections and reading positions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .selection import normal_selection

CORNERS = ("topLeft", "topRight", "bottomRight", "bottomLeft")


def quad_json(quad: Column) -> Column:
    """A quad as an object of four [x, y] pairs."""
    return F.to_json(F.struct(*(F.array(quad[k]["x"], quad[k]["y"]).alias(n) for k, n in enumerate(CORNERS))))


def quad_from_json(text: Column) -> Column:
    """The quad of such an object; null if it is none."""
    return _once(F.from_json(text, ", ".join(f"{n} array<double>" for n in CORNERS)), _quad)


def _once(value: Column, f) -> Column:
    """``f(value)`` with ``value`` computed once, however often ``f`` names it."""
    return F.transform(F.array(value), f)[0]


def _quad(read: Column) -> Column:
    points = F.array(*(F.struct(read[n][0].alias("x"), read[n][1].alias("y")) for n in CORNERS))
    whole = F.lit(True)
    for n in CORNERS:
        whole = whole & F.coalesce(F.size(read[n]) == 2, F.lit(False))
    return F.when(whole, points)


def selection_from_json(text: Column) -> Column:
    """A selection with its ends in order, whichever way it was kept."""
    read = F.from_json(text, "start struct<page:int,offset:int>, end struct<page:int,offset:int>")
    return _once(read, lambda r: normal_selection(r["start"]["page"], r["start"]["offset"], r["end"]["page"], r["end"]["offset"]))


def selection_json(selection: Column) -> Column:
    return F.to_json(selection)


def position_json(page: Column, offset: Column, zoom: Column) -> Column:
    """A reading position: the page, the place on it from 0 to 1, and the zoom."""
    return F.to_json(F.struct(page.alias("page"), F.least(F.greatest(offset, F.lit(0.0)), F.lit(1.0)).alias("offset"), zoom.alias("zoom")))


def highlight_json(mark: Column) -> Column:
    return F.to_json(mark)


def position_from_json(text: Column) -> Column:
    """A reading position (page, offset, zoom) with the offset within 0 to 1; null where one of them is missing."""

    def checked(read):
        whole = read["page"].isNotNull() & read["offset"].isNotNull() & read["zoom"].isNotNull()
        return F.when(whole, F.struct(read["page"].alias("page"), F.least(F.greatest(read["offset"], F.lit(0.0)), F.lit(1.0)).alias("offset"), read["zoom"].alias("zoom")))

    return _once(F.from_json(text, "page int, offset double, zoom double"), checked)


MARK = "id string, page int, quads array<string>, color struct<red:double,green:double,blue:double,alpha:double>"


def highlight_from_json(text: Column) -> Column:
    """A highlight (id, page, quads, color) whose quads are objects as by ``quad_json``; null without id or page.
    Objects that are no quads are left out."""

    def checked(read):
        quads = F.filter(F.transform(read["quads"], quad_from_json), lambda q: q.isNotNull())
        return F.when(read["id"].isNotNull() & read["page"].isNotNull(), F.struct(read["id"].alias("id"), read["page"].alias("page"), quads.alias("quads"), read["color"].alias("color")))

    return _once(F.from_json(text, MARK), checked)

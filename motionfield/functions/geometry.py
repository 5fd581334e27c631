"""Points, rectangles, rings and lines as column expressions.

A polygon is its edges, an array of struct<x1, y1, x2, y2>.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_edges(ring: Column) -> Column:
    """Edges of a ring of points, closed if it isn't."""
    nxt = lambda i: F.get(ring, F.pmod(i + 1, F.size(ring)))
    edges = F.transform(ring, lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), nxt(i)["x"].alias("x2"), nxt(i)["y"].alias("y2")))
    return F.filter(edges, lambda e: (e["x1"] != e["x2"]) | (e["y1"] != e["y2"]))


def crosses(x: Column, y: Column, e: Column) -> Column:
    """Whether the ray from (x, y) to the right crosses an edge."""
    at = F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
    return ((e["y1"] > y) != (e["y2"] > y)) & F.coalesce(x < at, F.lit(False))


def inside(x: Column, y: Column, edges: Column) -> Column:
    """Point in polygon by crossing count."""
    return F.size(F.filter(edges, lambda e: crosses(x, y, e))) % 2 == 1


def edge_meets_box(e: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Whether an edge has a point in a closed rectangle: their bounds overlap, and the corners aren't all on one side of the edge."""
    overlap = (F.least(e["x1"], e["x2"]) <= xmax) & (F.greatest(e["x1"], e["x2"]) >= xmin) & (F.least(e["y1"], e["y2"]) <= ymax) & (F.greatest(e["y1"], e["y2"]) >= ymin)
    side = lambda x, y: (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    corners = [side(xmin, ymin), side(xmin, ymax), side(xmax, ymin), side(xmax, ymax)]
    return overlap & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)


def box_meets_polygon(xmin: Column, ymin: Column, xmax: Column, ymax: Column, edges: Column) -> Column:
    """Closed rectangle and polygon have a point in common: an edge meets the rectangle, or a corner is inside."""
    return F.exists(edges, lambda e: edge_meets_box(e, xmin, ymin, xmax, ymax)) | inside(xmin, ymin, edges)


def bounds(edges: Column) -> Column:
    xs = F.flatten(F.transform(edges, lambda e: F.array(e["x1"], e["x2"])))
    ys = F.flatten(F.transform(edges, lambda e: F.array(e["y1"], e["y2"])))
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def level(box: Column) -> Column:
    """The smallest whole number whose power of 2 is no less than the sides of a rectangle: it touches at most 4 cells of that size."""
    return F.ceil(F.log2(F.greatest(box["xmax"] - box["xmin"], box["ymax"] - box["ymin"], F.lit(2.0**-30)))).cast("int")


def cell_range(low: Column, high: Column, size: Column) -> Column:
    """Numbers of the grid cells that an interval touches."""
    return F.sequence(F.floor(low / size), F.floor(high / size))


#: Grids of polygons lie off the origin by this share of a cell, so that round coordinates are not on their lines.
SHIFT = 0.3819660112501051


def grid_number(v: Column, size: Column) -> Column:
    return F.floor(v / size - F.lit(SHIFT)).cast("long")


def grid_range(low: Column, high: Column, size: Column) -> Column:
    """Numbers of the shifted grid's cells that an interval touches, null where it is empty."""
    return F.when(low <= high, F.sequence(grid_number(low, size), grid_number(high, size)))


def grid_line(n: Column, size: Column) -> Column:
    """The lower bound of a cell of the shifted grid."""
    return (n + F.lit(SHIFT)) * size

"""Pixels in polygons, values under points, and their summaries."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..storage import materialize
from . import raster


def zones_from_edges(edges: DataFrame, zone: str = "zone_id") -> DataFrame:
    """(zone_id, edges): one row for each polygon."""
    return edges.groupBy(zone).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges"))


def with_level(zones: DataFrame, most: int = 10) -> DataFrame:
    """Adds zb, the bounds, and gl, the level of the polygon's own grid: about as many cells as edges, whatever its size."""
    finer = F.least(F.greatest(F.ceil(F.log2(F.size("edges").cast("double")) / 2) + 1, F.lit(1)), F.lit(most))
    return zones.withColumn("zb", G.bounds(F.col("edges"))).withColumn("gl", (G.level(F.col("zb")) - finer).cast("int"))


def polygon_cells(sized: DataFrame) -> DataFrame:
    """(zone_id, gl, gx, gy, parity, edges): the grid cells of each polygon that hold a part of it.

    ``edges`` are those that pass the cell, none for cells that lie inside;
    ``parity`` tells whether the cell's lower right corner is inside.  Each
    edge is walked row by row through the cells that it passes; the lower line
    of each row is cut by edges, and between each second and next cut, from
    the right, lie the corners that are inside.
    """
    size, e = F.pow(F.lit(2.0), "gl"), F.col("e")
    sides = sized.select("zone_id", "gl", F.explode("edges").alias("e"))
    low, high = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    rows = sides.withColumn("gy", F.explode(G.grid_range(low, high, size)))
    y0 = G.grid_line(F.col("gy"), size)
    at = lambda y: F.coalesce(e["x1"] + F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]), e["x1"])
    # the part of the edge within the row; a horizontal one as a whole
    flat, a, b = e["y1"] == e["y2"], at(F.greatest(low, y0)), at(F.least(high, y0 + size))
    ends = [F.when(flat, e["x1"]).otherwise(a), F.when(flat, e["x2"]).otherwise(b)]
    pad = size * 1e-9
    passed = rows.withColumn("gx", F.explode(G.grid_range(F.least(*ends) - pad, F.greatest(*ends) + pad, size)))
    passed = passed.groupBy("zone_id", "gl", "gx", "gy").agg(F.collect_list("e").alias("edges"))
    # a cut at x counts for the corners to the left of it
    cuts = rows.filter((e["y1"] > y0) != (e["y2"] > y0)).select("zone_id", "gl", "gy", (F.ceil(at(y0) / size - F.lit(G.SHIFT)).cast("long") - 2).alias("last"))
    runs = cuts.groupBy("zone_id", "gl", "gy").agg(F.sort_array(F.collect_list("last"), asc=False).alias("c"))
    pairs = F.transform(F.sequence(F.lit(0), F.floor((F.size("c") - 1) / 2).cast("int")), lambda k: F.struct((F.get("c", 2 * k + 1) + 1).alias("first"), F.get("c", 2 * k).alias("last")))
    odd = runs.select("zone_id", "gl", "gy", F.explode(pairs).alias("r")).filter("r.first <= r.last").select("zone_id", "gl", F.explode(F.sequence("r.first", "r.last")).alias("gx"), "gy", F.lit(1).alias("parity"))
    cells = passed.join(odd, ["zone_id", "gl", "gx", "gy"], "full")
    none = F.array().cast(sized.schema["edges"].dataType)
    return cells.select("zone_id", "gl", "gx", "gy", F.coalesce("parity", F.lit(0)).alias("parity"), F.coalesce("edges", none).alias("edges"))


def inside_cell(x, y):
    """Whether a point is inside the polygon of its cell: from the point right to the cell's border, then down to the corner, counting edges."""
    size = F.pow(F.lit(2.0), "gl")
    right, low = G.grid_line(F.col("gx") + 1, size), G.grid_line(F.col("gy"), size)

    def met(e):
        at_x = F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
        at_y = F.try_divide((e["y2"] - e["y1"]) * (right - e["x1"]), e["x2"] - e["x1"]) + e["y1"]
        over = ((e["y1"] > y) != (e["y2"] > y)) & (at_x > x) & (at_x <= right)
        down = ((e["x1"] > right) != (e["x2"] > right)) & (at_y > low) & (at_y <= y)
        return F.coalesce(over, F.lit(False)) != F.coalesce(down, F.lit(False))

    return (F.col("parity") + F.size(F.filter("edges", met))) % 2 == 1


def zonal_join(pixels: DataFrame, zones: DataFrame) -> DataFrame:
    """Pixels (with x, y) inside each polygon of ``zones`` (zone_id, edges).

    An equi-join with the polygons' cells: a pixel goes to its cell of every
    level in use (few: levels follow the size of polygons and the number of
    their edges) and is tested against the edges that pass this cell alone;
    cells inside a polygon are taken untested.
    """
    sized = with_level(zones)
    levels = sized.agg(F.array_sort(F.collect_set("gl"))).scalar()
    size = F.pow(F.lit(2.0), "gl")
    placed = pixels.withColumn("gl", F.explode(levels)).withColumns({"gx": G.grid_number(F.col("x"), size), "gy": G.grid_number(F.col("y"), size)})
    met = placed.join(polygon_cells(sized), ["gl", "gx", "gy"]).filter((F.size("edges") == 0) | inside_cell(F.col("x"), F.col("y")))
    met = met.drop("gl", "gx", "gy", "parity", "edges")
    others = [c for c in zones.columns if c not in ("zone_id", "edges")]
    return met.join(zones.select("zone_id", *others), "zone_id") if others else met


def zone_mean(hits: DataFrame, value: str = "magn") -> DataFrame:
    """Mean of ``value`` for each zone and raster."""
    return hits.groupBy("zone_id", "raster_id").agg(F.avg(value).alias("d"))


def geomorph_overview(hits: DataFrame, pairs: DataFrame, value: str = "magn") -> DataFrame:
    """(zone_id, raster_id, L, R, D, V): mean displacement of complete pairs, and per year."""
    years = pairs.filter("pa_status = 'complete'").select("raster_id", F.col("left_year").alias("L"), F.col("right_year").alias("R"))
    d = zone_mean(hits, value).join(years, "raster_id")
    return d.select("zone_id", "raster_id", "L", "R", F.col("d").alias("D"), F.try_divide("d", F.abs(F.col("L") - F.col("R"))).alias("V"))


def xzone_overview(hits: DataFrame, pairs: DataFrame, value: str = "magn") -> DataFrame:
    """(zone_id, raster_id, l, r, d, s, abs_s): s is signed by the order of the years; abs_s is |d|."""
    years = pairs.filter("pa_status = 'complete'").select("raster_id", F.col("left_year").alias("l"), F.col("right_year").alias("r"))
    d = zone_mean(hits, value).join(years, "raster_id")
    return d.select("zone_id", "raster_id", "l", "r", "d", F.try_divide("d", F.col("r") - F.col("l")).alias("s"), F.abs("d").alias("abs_s"))


def point_cells(points: DataFrame, x0: float, y0: float, px: float, py: float) -> DataFrame:
    return points.withColumns({"row": F.floor((F.col("y") - y0) / py).cast("int"), "col": F.floor((F.col("x") - x0) / px).cast("int")})


def sample_points(points: DataFrame, rasters: DataFrame, value: str, name: str, x0: float, y0: float, px: float, py: float) -> DataFrame:
    """Adds raster_id and the value of the cell under each point, for each raster on the grid that has the cell.

    ``rasters``: pixels, or tiles as by ``tile_rasters``, of which an element
    is read.  The value's column is named after the raster file up to the
    first dot; a point off all rasters is one row of nulls.
    """
    column = name.split(".")[0]
    cells, tiles = point_cells(points, x0, y0, px, py), raster.stored_tiles(rasters, [value])
    found = raster.sample_cells(cells, tiles, [value]).withColumnRenamed(value, column)
    there = raster.as_pixels(tiles, [value]).select("row", "col").distinct()
    off = cells.join(there.hint("merge"), ["row", "col"], "left_anti").withColumns({"raster_id": F.lit(None).cast(tiles.schema["raster_id"].dataType), column: F.lit(None).cast("double")})
    return found.unionByName(off).drop("row", "col")


def sample_points_buffer(points: DataFrame, rasters: DataFrame, value: str, radius: float, x0: float, y0: float, px: float, py: float, key: str = "point_id") -> DataFrame:
    """(key, raster_id, mean): mean of a raster's cells whose centres are within ``radius`` of the point; one row of nulls where there is none.

    Tiles have a halo of the radius, so a point's cells lie in one tile and
    its means need no shuffle.  Points with the same cells are one class,
    which is averaged once for each raster; its keys are listed in parts.
    Keys of several rows, whose cells count together, and radii beyond a
    tile's side are averaged from the rows of single cells.
    """
    halo, tile = math.ceil(max(radius / abs(px), radius / abs(py))) + 1, raster.TILE
    side, pixels = tile + 2 * halo, raster.as_pixels(rasters, [value])
    span = lambda c, o, size: F.sequence(F.floor(F.least((F.col(c) - radius - o) / size, (F.col(c) + radius - o) / size)), F.ceil(F.greatest((F.col(c) - radius - o) / size, (F.col(c) + radius - o) / size)))
    cx, cy = F.lit(x0) + (F.col("col") + 0.5) * px, F.lit(y0) + (F.col("row") + 0.5) * py

    def near(p: DataFrame) -> DataFrame:
        cells = p.withColumn("row", F.explode(span("y", y0, py).cast("array<int>"))).withColumn("col", F.explode(span("x", x0, px).cast("array<int>")))
        return cells.filter((cx - F.col("x")) * (cx - F.col("x")) + (cy - F.col("y")) * (cy - F.col("y")) <= radius * radius).drop("x", "y")

    def averaged(p: DataFrame) -> DataFrame:
        means = raster.sample_cells(near(p.select(key, "x", "y")), raster.stored_tiles(rasters, [value]), [value]).groupBy(key, "raster_id").agg(F.avg(value).alias("mean"))
        return p.select(key).join(means.hint("merge"), key, "left")

    if halo > tile:
        return averaged(points)
    many = points.groupBy(key).agg(F.count("*").alias("mf_n")).filter((F.col("mf_n") > 1) & F.col(key).isNotNull()).select(key)
    once = points.select(key, "x", "y").join(many.hint("merge"), key, "left_anti")
    again = points.join(many.hint("merge"), key, "left_semi")
    place = point_cells(once, x0, y0, px, py).filter(F.col(key).isNotNull()).select(key, "x", "y", F.floor(F.col("row") / tile).cast("int").alias("tr"), F.floor(F.col("col") / tile).cast("int").alias("tc"))
    at = (F.col("row") - F.col("tr") * tile + halo) * side + F.col("col") - F.col("tc") * tile + halo
    classed = near(place).groupBy(key, "tr", "tc").agg(F.sort_array(F.collect_list(at)).alias("mf_at"))
    tiles = materialize(raster.tile_rasters(pixels, [value], tile, halo), "tiles")
    # parts of a class: as many as its size asks for
    own = ["tr", "tc", "mf_at"]
    sizes = classed.groupBy(*own).agg(F.ceil(F.count("*") / F.lit(raster.BLOCK)).cast("int").alias("mf_n"))
    parts = classed.join(sizes.hint("merge"), own).withColumn("mf_p", F.pmod(F.xxhash64(key), "mf_n")).groupBy(*own, "mf_p").agg(F.collect_list(key).alias("mf_keys"))
    met = raster.meet_tiles(parts, tiles, ["tr", "tc"], F.struct("mf_at", "mf_keys"), ["mf_at", "mf_p"], F.size("mf_keys"), raster.PASSED)

    def add(a, p):
        v = F.get(value, p)
        known = v.isNotNull() & ~F.isnan(v)
        # NaN is a cell that the raster doesn't have
        return F.struct((a["s"] + F.when(known, v).otherwise(0.0)).alias("s"), (a["k"] + F.when(known, 1).otherwise(0)).alias("k"), (a["n"] + F.when(F.coalesce(F.isnan(v), F.lit(False)), 0).otherwise(1)).alias("n"))

    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("k"), F.lit(0).alias("n"))
    seen = F.filter(F.transform("mf_cells", lambda c: F.struct(c["mf_keys"].alias("keys"), F.aggregate(c["mf_at"], zero, add).alias("a"))), lambda c: c["a"]["n"] > 0)
    means = met.select("raster_id", F.explode(seen).alias("c")).select("raster_id", F.try_divide("c.a.s", "c.a.k").alias("mean"), F.explode("c.keys").alias(key)).select(key, "raster_id", "mean")
    there, pos = pixels.select("row", "col").distinct(), F.col("pos")
    cells = sizes.select(*own, F.explode("mf_at").alias("pos")).select(*own, (F.col("tr") * tile + F.floor(pos / side) - halo).cast("int").alias("row"), (F.col("tc") * tile + pos % side - halo).cast("int").alias("col"))
    hit = classed.join(cells.join(there.hint("merge"), ["row", "col"], "left_semi").select(*own).distinct().hint("merge"), own, "left_semi")
    off = once.join(hit.select(key).hint("merge"), key, "left_anti").select(key, F.lit(None).cast(tiles.schema["raster_id"].dataType).alias("raster_id"), F.lit(None).cast("double").alias("mean"))
    return means.unionByName(off).unionByName(averaged(again))

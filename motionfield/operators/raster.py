"""Rasters as tables of pixels: (raster_id, row, col, bands...).  Nodata is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.displacement import cc_filter
from ..storage import materialize
from . import order


def with_centres(pixels: DataFrame, x0: float, y0: float, px: float, py: float) -> DataFrame:
    """Adds x, y of the pixel centres."""
    return pixels.withColumns({"x": F.lit(x0) + (F.col("col") + 0.5) * px, "y": F.lit(y0) + (F.col("row") + 0.5) * py})


def to_pixels(tiles: DataFrame, data: str, width: int) -> DataFrame:
    """A row for each value of a row-major tile."""
    rows = tiles.select(*[c for c in tiles.columns if c != data], F.posexplode(data).alias("pos", "value"))
    return rows.withColumns({"row": F.floor(F.col("pos") / width).cast("int"), "col": (F.col("pos") % width).cast("int")}).drop("pos")


def to_tiles(pixels: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The inverse of ``to_pixels``: row-major arrays; a tile is a bounded group."""
    at = F.struct((F.col("row") * width + F.col("col")).alias("pos"), "value")
    return pixels.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(at)), lambda s: s["value"]).alias("data"))


TILE = 64
#: Tiles of one place that a task holds at once, cells that pass them, cells in a block.
HELD, PASSED, BLOCK = 256, 65_536, 1_024


def tile_rasters(pixels: DataFrame, columns: list[str], tile: int = TILE, halo: int = 0) -> DataFrame:
    """(raster_id, tr, tc, an array for each column): rasters as row-major tiles, to be stored and sampled by place.

    A value of the arrays is null where the cell's is, and NaN where there is
    no cell; ``tr``, ``tc`` are the index of the tiles.  With ``halo`` a tile
    also has so many cells beyond each of its borders.
    """
    import numpy as np
    import pyarrow as pa

    kind, side = pixels.schema["raster_id"].dataType.simpleString(), tile + 2 * halo

    def run(key, table):
        at = (table.column("row").to_numpy() - key[1].as_py() * tile + halo) * side + table.column("col").to_numpy() - key[2].as_py() * tile + halo
        out = {"raster_id": table.column("raster_id").slice(0, 1), "tr": pa.array([key[1].as_py()], pa.int32()), "tc": pa.array([key[2].as_py()], pa.int32())}
        for c in columns:
            v, null = np.full(side * side, np.nan), np.zeros(side * side, bool)
            own = table.column(c).combine_chunks()
            # NaN is no value either
            gone = own.is_null(nan_is_null=True).to_numpy(zero_copy_only=False)
            v[at], null[at] = np.where(gone, 0.0, own.fill_null(0.0).to_numpy(zero_copy_only=False)), gone
            out[c] = pa.array([pa.array(v, mask=null)], pa.list_(pa.float64()))
        return pa.table(out)

    rows = pixels.select("raster_id", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(c).cast("double").alias(c) for c in columns])
    if halo:
        span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile).cast("int"), F.floor((F.col(c) + halo) / tile).cast("int")))
        placed = rows.withColumn("tr", span("row")).withColumn("tc", span("col"))
    else:
        placed = rows.withColumns({"tr": F.floor(F.col("row") / tile).cast("int"), "tc": F.floor(F.col("col") / tile).cast("int")})
    return placed.groupBy("raster_id", "tr", "tc").applyInArrow(run, f"raster_id {kind}, tr int, tc int, " + ", ".join(f"`{c}` array<double>" for c in columns))


def as_tiles(rasters: DataFrame, columns: list[str], tile: int = TILE) -> DataFrame:
    """Stored tiles as they are, pixels as tiles."""
    return rasters if {"tr", "tc"} <= set(rasters.columns) else tile_rasters(rasters, columns, tile)


def stored_tiles(rasters: DataFrame, columns: list[str], tile: int = TILE) -> DataFrame:
    """Stored tiles as they are, pixels as tiles that are stored, to be read more than once."""
    return rasters if {"tr", "tc"} <= set(rasters.columns) else materialize(tile_rasters(rasters, columns, tile), "tiles")


def as_pixels(rasters: DataFrame, columns: list[str], tile: int = TILE) -> DataFrame:
    """Pixels as they are, stored tiles as pixels."""
    if not {"tr", "tc"} <= set(rasters.columns):
        return rasters.select("raster_id", "row", "col", *columns)
    rows = rasters.select("raster_id", "tr", "tc", F.posexplode(F.arrays_zip(*columns)).alias("pos", "v")).filter(F.col("v")[columns[0]].isNull() | ~F.isnan(F.col("v")[columns[0]]))
    return rows.select("raster_id", (F.col("tr") * tile + F.floor(F.col("pos") / tile)).cast("int").alias("row"), (F.col("tc") * tile + F.col("pos") % tile).cast("int").alias("col"), *[F.col("v")[c].alias(c) for c in columns])


def tile_place(row: Column, col: Column, tile: int = TILE) -> dict[str, Column]:
    """Tile and position within it of a cell."""
    return {"tr": F.floor(row / tile).cast("int"), "tc": F.floor(col / tile).cast("int"), "mf_pos": (F.pmod(row, F.lit(tile)) * tile + F.pmod(col, F.lit(tile))).cast("int")}


def meet_tiles(cells: DataFrame, tiles: DataFrame, on: list[str], cell: Column, spread: list[str], size: Column | None = None, block: int = BLOCK, own: str = "raster_id") -> DataFrame:
    """The columns of ``tiles`` and mf_cells, an array of ``cell``: blocks of cells with each tile of their place ``on``.

    The tiles of a place are dealt to groups of about ``HELD`` by ``own``, its
    cells, of which a row counts for ``size``, to groups of about ``PASSED``
    by ``spread``; a pair of groups is the join key.  So a place of any size
    is shared by many tasks, each side is copied once for each group of the
    other, and what a task holds is bounded: a merge join streams its left
    side, the blocks, and holds the tiles of one group.
    """
    tile_n = tiles.groupBy(*on).agg(F.ceil(F.count("*") / F.lit(HELD)).cast("int").alias("mf_ns"))
    cell_n = cells.groupBy(*on).agg(F.sum(F.lit(1) if size is None else size).alias("mf_n"))
    places = materialize(tile_n.join(cell_n.hint("merge"), on).select(*on, "mf_ns", *[F.ceil(F.col("mf_n") / n).cast("int").alias(c) for c, n in (("mf_ng", PASSED), ("mf_nb", block))]), "places")
    # compressed bytes tell little of the rows' size: tiles and cells are never broadcast, places if they are few
    places = F.broadcast(places) if places.count() <= 100_000 else places.hint("merge")
    h = lambda by, n: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    blocks = cells.join(places, on).withColumn("mf_b", h(spread, "mf_nb")).groupBy(*on, "mf_ns", "mf_ng", "mf_b").agg(F.collect_list(cell).alias("mf_cells"))
    blocks = blocks.withColumn("mf_g", F.pmod("mf_b", "mf_ng")).withColumn("mf_s", each("mf_ns")).select(*on, "mf_g", "mf_s", "mf_cells")
    dealt = tiles.join(places, on).withColumn("mf_s", h([own], "mf_ns")).withColumn("mf_g", each("mf_ng")).drop("mf_ns", "mf_ng", "mf_nb")
    return blocks.join(dealt.hint("merge"), [*on, "mf_g", "mf_s"]).drop("mf_g", "mf_s")


def sample_cells(cells: DataFrame, tiles: DataFrame, columns: list[str], tile: int = TILE) -> DataFrame:
    """The rows of ``cells`` (row, col, ...) with raster_id and the columns' values, for each raster that has the cell.

    Cells go to the tiles in blocks, so an array is read many times where it
    lies, and the rows come out of the join: they are not shuffled.
    """
    own = [c for c in cells.columns if c not in ("row", "col")]
    placed = cells.withColumns(tile_place(F.col("row"), F.col("col"), tile))
    met = meet_tiles(placed, tiles, ["tr", "tc"], F.struct("mf_pos", *own), ["mf_pos", *own])
    rows = met.select("raster_id", "tr", "tc", *[F.col(c).alias(f"mf_{k}") for k, c in enumerate(columns)], F.explode("mf_cells").alias("mf_c"))
    pos = F.col("mf_c.mf_pos")
    at = [(F.col("tr") * tile + F.floor(pos / tile)).cast("int").alias("row"), (F.col("tc") * tile + pos % tile).cast("int").alias("col")]
    found = rows.select(*at, *[f"mf_c.{c}" for c in own], "raster_id", *[F.get(f"mf_{k}", pos).alias(f"mf_{k}") for k in range(len(columns))])
    # NaN in the first column is a cell that the raster doesn't have
    return found.filter("mf_0 is null or not isnan(mf_0)").withColumnsRenamed({f"mf_{k}": c for k, c in enumerate(columns)})


def crop_pixels(pixels: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, x0: float, y0: float, px: float, py: float) -> DataFrame:
    """Pixels whose centres lie in the bounds, as row and column ranges that reach the scan."""
    import math

    cols = sorted([(xmin - x0) / px - 0.5, (xmax - x0) / px - 0.5])
    rows = sorted([(ymin - y0) / py - 0.5, (ymax - y0) / py - 0.5])
    return pixels.filter(F.col("col").between(math.ceil(cols[0]), math.floor(cols[1])) & F.col("row").between(math.ceil(rows[0]), math.floor(rows[1])))


def mask_pixels(pixels: DataFrame, hits: DataFrame, bands: list[str]) -> DataFrame:
    """Null in ``bands`` for pixels that aren't in ``hits`` (raster_id, row, col)."""
    keys = ["raster_id", "row", "col"]
    joined = pixels.join(hits.select(*keys).distinct().withColumn("mf_in", F.lit(True)), keys, "left")
    return joined.withColumns({b: F.when(F.col("mf_in"), F.col(b)) for b in bands}).drop("mf_in")


def cc_threshold_filter(disp: DataFrame, cc: DataFrame, bands: list[str], least: float = 0.5) -> DataFrame:
    """Displacements whose correlation, in a raster of its own, is ``least`` or more."""
    joined = disp.join(cc.select("raster_id", "row", "col", F.col("cc").alias("mf_cc")), ["raster_id", "row", "col"], "left")
    return joined.withColumns({b: cc_filter(F.col(b), F.col("mf_cc"), least) for b in bands}).drop("mf_cc")


def stride_field(pixels: DataFrame, every: int) -> DataFrame:
    """Each ``every``-th row and column, with the magnitude in pixels."""
    return pixels.filter((F.col("row") % every == 0) & (F.col("col") % every == 0)).withColumn("magn", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))


def clip_extents(left: Column, right: Column) -> Column:
    """The common rectangle of two extents, null where there is none."""
    out = F.struct(F.greatest(left["xmin"], right["xmin"]).alias("xmin"), F.greatest(left["ymin"], right["ymin"]).alias("ymin"), F.least(left["xmax"], right["xmax"]).alias("xmax"), F.least(left["ymax"], right["ymax"]).alias("ymax"))
    return F.when((out["xmin"] < out["xmax"]) & (out["ymin"] < out["ymax"]), out)


def clip_pair(pixels: DataFrame, pairs: DataFrame, value: str, origin: DataFrame | None = None) -> DataFrame:
    """(pair, row, col, left, right): cells that both rasters of a pair have.

    ``pairs``: pair_id, left_id, right_id.  ``origin`` (raster_id, row0, col0)
    places each raster on the common grid.
    """
    placed = pixels.select("raster_id", "row", "col", F.col(value).alias("value"))
    if origin is not None:
        placed = placed.join(origin, "raster_id").select("raster_id", (F.col("row") + F.col("row0")).alias("row"), (F.col("col") + F.col("col0")).alias("col"), "value")
    side = lambda s: pairs.select("pair_id", F.col(f"{s}_id").alias("raster_id")).join(placed, "raster_id").select("pair_id", "row", "col", F.col("value").alias(s))
    return side("left").join(side("right"), ["pair_id", "row", "col"])


def mosaic(pixels: DataFrame, keys: list[str], order: str = "filepath", value: str = "value") -> DataFrame:
    """Per cell the first value, files in order; cells without any value are null."""
    first = F.min_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order)))
    return pixels.groupBy(*keys).agg(first.alias(value))


def resample_average(pixels: DataFrame, bands: list[str], px: float, py: float, out: float) -> DataFrame:
    """Mean of the values whose cells fall in an output cell."""
    cell = lambda c, size: F.floor(F.col(c) * abs(size) / out).cast("int")
    return pixels.groupBy("raster_id", cell("row", py).alias("row"), cell("col", px).alias("col")).agg(*[F.avg(b).alias(b) for b in bands])


def resample_nearest(pixels: DataFrame, bands: list[str], px: float, py: float, out: float) -> DataFrame:
    """The value of the source cell that holds an output cell's centre.

    Each source cell knows the output cells whose centres it holds, so nothing is joined.
    """

    def cells(c: str, size: float):
        s = abs(size)
        first, end = F.ceil(F.col(c) * s / out - 0.5), F.ceil((F.col(c) + 1) * s / out - 0.5)
        return F.when(end > first, F.sequence(first, end - 1))

    rows = pixels.withColumn("mf_r", F.explode(cells("row", py))).withColumn("mf_c", F.explode(cells("col", px)))
    return rows.select("raster_id", F.col("mf_r").cast("int").alias("row"), F.col("mf_c").cast("int").alias("col"), *bands)


def regrid(pixels: DataFrame, grids: DataFrame, res: float, how: str = "nearest", value: str = "value") -> DataFrame:
    """Pixels of files of any origin and pixel size on the grids that they are asked for.

    ``pixels``: filepath, row, col, value.  ``grids``: filepath, x0, y0, px, py
    of the file and gx0, gy0, n_rows, n_cols of a grid of ``res`` from its
    upper left corner, with any other columns, once for each grid that the
    file goes to.  'nearest' takes the value of the source cell that holds the
    centre of a cell, 'average' the mean of the source cells whose centres lie
    in it, where there are any, else as nearest.  A file on the grid's own
    pixel size is moved, not averaged.

    A source cell knows the cells of the grid that it serves, so nothing is
    joined but the grids, by file, and neither side is broadcast.
    """
    if how not in ("nearest", "average"):
        raise ValueError(how)
    f = pixels.join(grids.hint("merge"), "filepath")

    def centres(first: Column, size: Column, n: Column) -> Column:
        """Numbers of the grid cells whose centres lie in [first, first + size)."""
        lo, hi = F.greatest(F.ceil(first / res - 0.5), F.lit(0)), F.least(F.ceil((first + size) / res - 0.5), n.cast("long")) - 1
        return F.when(hi >= lo, F.sequence(lo, hi))

    px, py = F.abs("px"), F.abs("py")
    # from the grid's upper left corner right and down
    right, down = F.col("x0") + F.col("col") * px - F.col("gx0"), F.col("gy0") - F.col("y0") + F.col("row") * py
    rows, cols = centres(down, py, F.col("n_rows")), centres(right, px, F.col("n_cols"))
    if how == "average":
        inner = lambda first, size, n: F.when((first + size / 2 >= 0) & (first + size / 2 < n * res), F.array(F.floor((first + size / 2) / res)))
        finer = (px < res) & (py < res)
        rows, cols = F.when(finer, inner(down, py, F.col("n_rows"))).otherwise(rows), F.when(finer, inner(right, px, F.col("n_cols"))).otherwise(cols)
    others = [c for c in f.columns if c not in ("row", "col", "x0", "y0", "px", "py", "gx0", "gy0", "n_rows", "n_cols", value)]
    out = f.withColumn("mf_r", F.explode(rows)).withColumn("mf_c", F.explode(cols)).select(*others, F.col("mf_r").cast("int").alias("row"), F.col("mf_c").cast("int").alias("col"), value)
    return out if how == "nearest" else out.groupBy(*others, "row", "col").agg(F.avg(value).alias(value))


def center_disp(pixels: DataFrame, value: str, how: str = "median", accuracy: int | None = None) -> DataFrame:
    """Subtracts the raster's median, or its mean (null for all if one value is missing).

    The median is selected by rank from the counts of value ranges
    (``order``), so no task holds a raster's values; NaN is left out.
    ``accuracy`` takes the approximate median instead.
    """
    v = F.col(value)
    if how == "median" and not accuracy:
        buckets, names = order.value_buckets(pixels, value, "raster_id")
        centre = names.join(order.quantiles(buckets, [0.5]), "g").select("raster_id", F.get("q", 0).alias("mf_m"))
    elif how == "median":
        centre = pixels.groupBy("raster_id").agg(F.percentile_approx(v, 0.5, accuracy).alias("mf_m"))
    elif how == "mean":
        centre = pixels.groupBy("raster_id").agg(F.when(F.count("*") == F.count(v), F.avg(v)).alias("mf_m"))
    else:
        raise ValueError(how)
    # a row for each raster; one without values has no median
    return pixels.join(centre, "raster_id", "left").withColumn(value, v - F.col("mf_m")).drop("mf_m")


def densify(pixels: DataFrame, meta: DataFrame) -> DataFrame:
    """All cells of each raster (raster_id, n_rows, n_cols), null where ``pixels`` has none."""
    grid = meta.select("raster_id", F.explode(F.sequence(F.lit(0), F.col("n_rows") - 1)).alias("row"), "n_cols")
    grid = grid.select("raster_id", F.col("row").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("col"))
    return grid.join(pixels, ["raster_id", "row", "col"], "left")


def _pass(df: DataFrame, value: str, n: int, along: str, fn) -> DataFrame:
    across = "row" if along == "col" else "col"
    w = Window.partitionBy("raster_id", across).orderBy(along).rangeBetween(-(n // 2), n - 1 - n // 2)
    return df.withColumn(value, fn(value).over(w))


def morph_open(pixels: DataFrame, value: str, n: int = 30) -> DataFrame:
    """Erosion then dilation with an n x n box, row and column passes in the order that needs three exchanges.  The grid must be full."""
    for along, fn in (("col", F.min), ("row", F.min), ("row", F.max), ("col", F.max)):
        pixels = _pass(pixels, value, n, along, fn)
    return pixels


def morph_close(pixels: DataFrame, value: str, n: int = 30) -> DataFrame:
    """Dilation then erosion."""
    for along, fn in (("col", F.max), ("row", F.max), ("row", F.min), ("col", F.min)):
        pixels = _pass(pixels, value, n, along, fn)
    return pixels

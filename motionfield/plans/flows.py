"""Whole flows, composed of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.displacement import magnitude, vector_attributes
from ..operators import catalog, matching, raster, segment, zones
from ..storage import materialize


def zone_velocities(pixels: DataFrame, pairs: DataFrame, polygons: DataFrame, px: float) -> DataFrame:
    """Mean displacement and velocity of each polygon for each complete pair (pixels with x, y)."""
    measured = pixels.withColumn("magn", magnitude(F.col("dx"), F.col("dy"), F.lit(float(px))))
    done = pairs.filter("pa_status = 'complete'")
    # a semi join before the polygons: pixels of other pairs go no further
    used = measured.join(done.select("raster_id"), "raster_id", "left_semi").select("raster_id", "x", "y", "magn")
    return zones.geomorph_overview(zones.zonal_join(used, polygons), done)


def sieve(images: DataFrame, polygons: DataFrame, stored: DataFrame, data_type: str = "optical") -> DataFrame:
    """Scenes to cut: images meeting each zone, by date and sensor, without those whose thumb is stored."""
    scenes = catalog.group_scenes(catalog.images_on_zones(images, polygons))
    if data_type == "dem":
        scenes = catalog.dem_scenes(scenes)
    name = F.concat(F.col("zone_id").cast("string"), F.lit("_"), "acq_date", F.lit("_"), "sensor")
    path = F.concat(F.lit("/thumbs/"), F.col("zone_id").cast("string"), F.lit("/opticals/"), name, F.lit(".tif"))
    return catalog.pending_thumbs(scenes.withColumn("th_path", path), stored)


def cut_scenes(scenes: DataFrame, pixels: DataFrame, headers: DataFrame, polygons: DataFrame, res: float, how: str = "nearest") -> DataFrame:
    """(th_path, row, col, value): the mosaic of each scene's files within the zone's bounds, on a grid of ``res`` from their upper left corner.

    ``pixels``: filepath, row, col, value; ``headers``: filepath, x0, y0, px,
    py.  Each file is brought from its own grid to the scene's first, so a
    scene may mix origins and pixel sizes; cells whose centres lie outside of
    the bounds are left out.
    """
    from ..functions.geometry import bounds

    b = F.col("b")
    box = polygons.select("zone_id", bounds(F.col("edges")).alias("b"))
    n = lambda lo, hi: F.ceil((b[hi] - b[lo]) / res - 0.5).cast("int")
    grid = scenes.join(box, "zone_id").select("th_path", F.explode("files").alias("filepath"), b["xmin"].alias("gx0"), b["ymax"].alias("gy0"), n("ymin", "ymax").alias("n_rows"), n("xmin", "xmax").alias("n_cols"))
    grids = grid.join(headers.select("filepath", "x0", "y0", "px", "py").hint("merge"), "filepath")
    return raster.mosaic(raster.regrid(pixels, grids, res, how), ["th_path", "row", "col"])


def process_project(pixels: DataFrame, value: str, pairs: DataFrame, px: float, py: float, origin: DataFrame | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """``process_pairs`` from the thumbs' pixels (raster_id, row, col, value): each pair is clipped to its common area first.

    ``pairs``: pair_id, left_id, right_id, pz_name, left_year, right_year;
    ``origin`` (raster_id, row0, col0) places the rasters on one grid.
    """
    clipped = materialize(raster.clip_pair(pixels, pairs.select("pair_id", "left_id", "right_id"), value, origin), "clipped")
    return process_pairs(clipped, pairs.drop("left_id", "right_id"), px, py, **how)


def process_pairs(clipped: DataFrame, pairs: DataFrame, px: float, py: float, *, kernel: int = 7, search: int = 10, threshold: float = 10.0, vector_size: float | None = 20.0) -> tuple[DataFrame, DataFrame]:
    """(vectors, log) of pairs (pair_id, pz_name, left_year, right_year): match, evaluate, resample, attributes.

    A pair without a single match is in the log as ABORT.
    """
    disp = materialize(matching.match_blocks(clipped, kernel, search, threshold), "matches")
    cc = matching.corr_eval_tiles(clipped, disp, kernel, search)
    field = disp.join(cc, ["pair_id", "row", "col"]).withColumnRenamed("pair_id", "raster_id")
    if vector_size:
        field = raster.resample_average(field, ["dx", "dy", "cc"], px, py, vector_size)
    rows = field.join(pairs.withColumnRenamed("pair_id", "raster_id"), "raster_id")
    attributes = vector_attributes(F.col("dx"), F.col("dy"), F.lit(float(px)), F.lit(float(py)), F.col("left_year"), F.col("right_year"))
    vectors = rows.filter("dx is not null and dy is not null").select(F.col("raster_id").alias("pair_id"), "row", "col", "cc", *[c.alias(n) for n, c in attributes.items()])
    good = disp.groupBy("pair_id").agg(F.max("good").alias("good"))
    status = pairs.join(good, "pair_id", "left").withColumn("outcome", F.when(F.col("good") == 1, "COMPLETE").otherwise("ABORT"))
    return vectors, catalog.batch_log(status, "pz_name", "pair_id")


def moving_areas(pixels: DataFrame, pairs: DataFrame, value: str, n_rows: int, n_cols: int, px: float, py: float, *, box: int = 30, min_surface: float = 0.0) -> DataFrame:
    """(zone, component, raster_val, n, area, extent) of each zone's moving areas: k-means of each complete pair, sum, k-means of the sum, closing, areas, label 1 above a size.

    Cells that not all of a zone's pairs have stay outside: the closing doesn't fill them.
    """
    done = pairs.filter("pa_status = 'complete'")
    labels, _ = segment.kmeans_1d(pixels.join(done.select("raster_id"), "raster_id", "left_semi"), value)
    sums = segment.add_moving_areas(labels, pairs)
    grouped, _ = segment.cluster_addition(sums)
    # a number for each zone's name, of which there is one row; written, so that it stays the same
    numbers = materialize(grouped.select("zone").distinct().coalesce(1).withColumn("raster_id", F.monotonically_increasing_id()), "zone-numbers")
    zone_ids = materialize(grouped.join(numbers, "zone").select("raster_id", "row", "col", "label"), "zone-labels")
    meta = zone_ids.select("raster_id").distinct().withColumns({"n_rows": F.lit(n_rows), "n_cols": F.lit(n_cols)})
    closed = raster.morph_close(raster.densify(zone_ids, meta), "label", box)
    closed = closed.join(zone_ids.select("raster_id", "row", "col"), ["raster_id", "row", "col"], "left_semi")
    stats = segment.area_stats(segment.connected_areas(closed, n_cols), px, py)
    return segment.min_surface_filter(stats, min_surface, 1).join(numbers, "raster_id").drop("raster_id")

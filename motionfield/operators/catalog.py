"""Catalogue of images, thumbs and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions.naming import acquisition, file_name, pair_key, pair_paths, parse_pair, thumb_parts
from .zones import inside_cell, polygon_cells, with_level

# ---- thumbs and pairs -------------------------------------------------------------


def parse_thumbs(files: DataFrame, path_col: str = "th_path") -> DataFrame:
    """Adds th_pz_name, th_date, th_sensor and th_year; rows whose name isn't a thumb's are left out."""
    found = files.withColumn("mf_t", thumb_parts(F.col(path_col))).filter("mf_t is not null")
    return found.withColumns({"th_key": F.col("mf_t.key"), "th_pz_name": F.col("mf_t.pz_name"), "th_date": F.col("mf_t.date"), "th_sensor": F.col("mf_t.sensor"), "th_year": F.col("mf_t.year")}).drop("mf_t")


def dedupe_thumbs(thumbs: DataFrame) -> DataFrame:
    """One row for each path; a thumb is valid if any of its rows says so."""
    others = [c for c in thumbs.columns if c not in ("th_path", "th_valid")]
    return thumbs.groupBy("th_path").agg(F.max("th_valid").alias("th_valid"), *[F.first(c, ignorenulls=True).alias(c) for c in others])


def make_pairs(thumbs: DataFrame, block: int = 256) -> DataFrame:
    """All ordered pairs of thumbs of one zone with different paths: a self-join of blocks.

    The thumbs of a zone are dealt to blocks of about ``block``, as many as
    the zone's size asks for; zone and pair of blocks are the join key, so the
    N * (N - 1) pairs of a large zone come out of all tasks in like parts.  A
    zone of one block is joined as a whole.
    """
    zone = "th_pz_name"
    many = thumbs.groupBy(zone).agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("mf_n")).filter("mf_n > 1")
    placed = thumbs.join(many, zone, "left").select(zone, *[f"th_{c}" for c in ("path", "date", "sensor", "year")], F.coalesce("mf_n", F.lit(1)).alias("mf_n"))
    placed = placed.withColumn("mf_b", F.pmod(F.xxhash64("th_path"), F.col("mf_n")).cast("int"))
    tasks, others = int(thumbs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.explode(F.sequence(F.lit(0), F.col("mf_n") - 1))

    def side(s: str, own: str, other: str) -> DataFrame:
        named = [F.col(f"th_{c}").alias(f"pa_{s}_{c}") for c in ("path", "date", "sensor", "year")]
        # a given number of tasks: few rows in are many pairs out
        return placed.select(F.col(zone).alias("pa_pz_name"), F.col("mf_b").alias(own), others.alias(other), *named).repartition(tasks, "pa_pz_name", "mf_l", "mf_r")

    pairs = side("left", "mf_l", "mf_r").join(side("right", "mf_r", "mf_l"), ["pa_pz_name", "mf_l", "mf_r"]).drop("mf_l", "mf_r").filter("pa_left_path <> pa_right_path")
    return pairs.withColumn("pa_key", pair_key(*[F.col(f"pa_{c}") for c in ("pz_name", "left_date", "left_sensor", "right_date", "right_sensor")]))


def valid_thumbs(thumbs: DataFrame, zone: str | None = None) -> DataFrame:
    good = thumbs.filter(F.col("th_valid") == "1")
    return good if zone is None else good.filter(F.col("th_pz_name") == zone)


def make_valid_pairs(thumbs: DataFrame) -> DataFrame:
    return make_pairs(valid_thumbs(thumbs))


def pair_files(pairs: DataFrame) -> DataFrame:
    """Adds the folder and files of each pair."""
    return pairs.withColumn("mf_p", pair_paths(F.col("pa_left_path"), F.col("pa_key"))).select("*", *[F.col(f"mf_p.{c}").alias(f"pa_{c}_path" if c != "path" else "pa_path") for c in ("path", "dispf", "snr", "magn", "vect")]).drop("mf_p")


def parse_pair_paths(paths: DataFrame, path_col: str = "pa_path") -> DataFrame:
    return paths.withColumn("mf_p", parse_pair(F.col(path_col))).filter("mf_p is not null").select("*", "mf_p.*").drop("mf_p")


def pair_status(pairs: DataFrame, artifacts: DataFrame, key: str = "pa_key") -> DataFrame:
    """Adds pa_status from a listing (key, kind: folder | inputs | dispf)."""
    seen = artifacts.groupBy(key).agg(*[F.max(F.when(F.col("kind") == k, True)).alias(f"mf_{k}") for k in ("folder", "inputs", "dispf")])
    status = F.when(F.col("mf_folder").isNull(), "empty").when(F.col("mf_dispf"), "complete").when(F.col("mf_inputs"), "clipped").otherwise("corrupt")
    return pairs.join(seen, key, "left").withColumn("pa_status", status).drop("mf_folder", "mf_inputs", "mf_dispf")


def refresh_thumbs(stored: DataFrame, listed: DataFrame) -> DataFrame:
    """Stored thumbs that are still listed keep their row, listed ones that are new are added, others vanish.

    Only ``opticals`` folders and the suffix ``.tif`` count; names must parse.
    """
    good = dedupe_thumbs(parse_thumbs(listed.filter(F.col("th_path").rlike(r"/opticals/[^/]*\.tif$"))))
    kept = stored.join(good.select("th_path"), "th_path", "left_semi")
    new = good.join(stored.select("th_path"), "th_path", "left_anti")
    columns = [c for c in stored.columns if c in good.columns]
    return kept.select(*columns).unionByName(new.select(*columns))


def pending_thumbs(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Wanted thumbs that aren't stored yet."""
    return wanted.join(stored.select("th_path").hint("merge"), "th_path", "left_anti")


def refresh_pairs(thumbs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """The pairs of all zones, with files and status.

    The files follow from the path and the key: they are named after the join
    with the artifacts, which shuffles all pairs.
    """
    pairs = pair_files(pair_status(make_pairs(thumbs), artifacts))
    return pairs.select(*[c for c in pairs.columns if c != "pa_status"], "pa_status")


# ---- searches -----------------------------------------------------------------------


def path_matches(path: Column, criteria) -> Column:
    """The lower-cased path matches all criteria (text or number, one or many), in any order; '' matches all."""
    many = [criteria] if isinstance(criteria, (str, int)) else list(criteria)
    return F.lower(path).rlike("".join(f"(?=.*{str(c).lower()})" for c in many) or ".*")


def search_thumbs(thumbs: DataFrame, criteria="") -> DataFrame:
    return thumbs.filter(path_matches(F.col("th_path"), criteria))


def search_pairs(pairs: DataFrame, criteria="") -> DataFrame:
    return pairs.filter(path_matches(F.col("pa_path"), criteria))


def search_pzones(pzones: DataFrame, criteria="") -> DataFrame:
    """The first criterion, lower-cased, equals the zone's name as it is."""
    first = criteria if isinstance(criteria, (str, int)) else (list(criteria) or [""])[0]
    return pzones if first == "" else pzones.filter(F.col("pz_name") == str(first).lower())


def search_geomorphs(geomorphs: DataFrame, pzones: DataFrame, criteria) -> DataFrame:
    """Criteria that name a zone filter on the zone, others on the id; all must hold."""
    many = [criteria] if isinstance(criteria, str) else list(criteria)
    # no more rows than criteria
    known = {r[0] for r in pzones.filter(F.col("pz_name").isin(many)).select("pz_name").distinct().collect()} if many else set()
    for c in many:
        geomorphs = geomorphs.filter(F.col("ge_pz_name" if c in known else "ge_frogi_id") == c)
    return geomorphs


def pairs_on_period(pairs: DataFrame, first: int, last: int, relation: str = "within", left: str = "pa_left_year", right: str = "pa_right_year") -> DataFrame:
    """Pairs inside [first, last]; with relation 'after' those that end in ``last`` or later."""
    lo, hi = F.least(left, right), F.greatest(left, right)
    if relation not in ("within", "after"):
        raise ValueError(relation)
    return pairs.filter((lo >= first) & (hi <= last if relation == "within" else hi >= last))


def complete_pairs(pairs: DataFrame, zone: str | None = None) -> DataFrame:
    done = pairs.filter(F.col("pa_status") == "complete")
    return done if zone is None else done.filter(F.col("pa_pz_name") == zone)


def unique_key_check(rows: DataFrame, key: str, wanted: DataFrame | None = None) -> DataFrame:
    """Violations (key, n): keys that occur more than once, and keys of ``wanted`` that don't occur (n = 0)."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    found = counts.filter("n > 1")
    return found if wanted is None else found.unionByName(wanted.select(key).distinct().join(rows, key, "left_anti").withColumn("n", F.lit(0).cast("long")))


def zones_with_dem(zones: DataFrame, files: DataFrame) -> DataFrame:
    """Zones that have a file ``{zone}_dem.tif``."""
    return zones.join(files.select(F.regexp_extract(file_name(F.col("filepath")), r"^(.*)_dem\.tif$", 1).alias("pz_name")), "pz_name", "left_semi")


def first_thumb(thumbs: DataFrame, criteria="") -> DataFrame:
    """The first matching thumb of each zone, by path."""
    w = Window.partitionBy("th_pz_name").orderBy("th_path")
    return search_thumbs(thumbs, criteria).withColumn("mf_r", F.row_number().over(w)).filter("mf_r = 1").drop("mf_r")


def legend(pairs: DataFrame, by: str) -> DataFrame:
    """Sorted labels ``{left year}-{right year}`` of the pairs of each ``by``."""
    label = F.concat_ws("-", F.col("pa_left_year").cast("string"), F.col("pa_right_year").cast("string"))
    return pairs.groupBy(by).agg(F.array_sort(F.collect_set(label)).alias("labels"))


def batch_log(statuses: DataFrame, zone: str = "pa_pz_name", key: str = "pa_key", outcome: str = "outcome") -> DataFrame:
    """Per zone the sorted keys that ended COMPLETE, and ABORT."""
    keys = lambda o: F.sort_array(F.collect_list(F.when(F.col(outcome) == o, F.col(key))))
    return statuses.groupBy(zone).agg(keys("COMPLETE").alias("complete"), keys("ABORT").alias("abort"))


def lookup_zone(items: DataFrame, zone_col: str, rows: DataFrame, rows_zone: str) -> DataFrame:
    """Thumbs or pairs of the zone that each geomorph, cross zone or spine lies in."""
    return items.join(rows, items[zone_col] == rows[rows_zone])


def geomorph_spines(geomorphs: DataFrame, spines: DataFrame) -> DataFrame:
    return geomorphs.join(spines, geomorphs.ge_frogi_id == spines.sp_ge_id)


# ---- image bank ---------------------------------------------------------------------


def bank_features(files: DataFrame, headers: DataFrame, xml: DataFrame, data_type: str = "optical") -> DataFrame:
    """A row for each image: file name, sensor, resolution, size, date, extent.

    ``headers``: filepath, x0, y0, px, py, bands, n_rows, n_cols; ``xml``:
    filepath, xml.  Satellite images without metadata are left out.  Paths
    compress to far less than they take as rows, so no side is broadcast.
    """
    rows = files.join(headers.hint("merge"), "filepath").join(xml.hint("merge"), "filepath", "left").withColumn("mf_a", acquisition(F.col("filepath"), F.col("xml"), data_type)).filter("mf_a.listed")
    x1, y1 = F.col("x0") + F.col("px") * F.col("n_cols"), F.col("y0") + F.col("py") * F.col("n_rows")
    extent = F.struct(F.least("x0", x1).alias("xmin"), F.least("y0", y1).alias("ymin"), F.greatest("x0", x1).alias("xmax"), F.greatest("y0", y1).alias("ymax"))
    return rows.select(file_name(F.col("filepath")).alias("filename"), F.col("mf_a.sensor").alias("sensor"), F.abs("px").alias("xRes"), F.abs("py").alias("yRes"), "bands", F.col("n_rows").alias("rows"), F.col("n_cols").alias("cols"), F.col("mf_a.acq_date").alias("acq_date"), extent.alias("extent"), "filepath")


def images_on_zones(images: DataFrame, zones: DataFrame) -> DataFrame:
    """Images whose extent meets a zone's polygon (touching counts).

    First the rectangles, by a join over grids of several levels: a rectangle
    goes to the cells that it touches at the level of its own size and at the
    coarser levels in use, at most four of each, whatever the units of the
    map; a pair is taken at the coarser level of the two, in the one cell that
    holds the lower left corner of the common bounds, so no distinct is
    needed.  An image that holds a zone's bounds meets it.  Of the others the
    cells of the zone's index (``zones.polygon_cells``) within the image are
    tested, each with its own edges only.  ``zones``: zone_id, edges.
    """
    e, b = F.col("extent"), F.col("zb")
    sized = with_level(zones)
    left, right = images.withColumn("el", G.level(e)), sized.select("zone_id", "zb", G.level(b).alias("zl"), F.col("gl").alias("fine"))
    levels = left.select("el").union(right.select("zl")).agg(F.array_sort(F.collect_set("el"))).scalar()
    size = F.pow(F.lit(2.0), "gl")

    def placed(df, own, box):
        df = df.withColumn("gl", F.explode(levels)).filter(F.col("gl") >= F.col(own))
        return df.withColumn("gx", F.explode(G.cell_range(box["xmin"], box["xmax"], size))).withColumn("gy", F.explode(G.cell_range(box["ymin"], box["ymax"], size)))

    met = placed(left, "el", e).join(placed(right, "zl", b), ["gl", "gx", "gy"]).filter(F.col("gl") == F.greatest("el", "zl")).filter((b["xmin"] <= e["xmax"]) & (b["xmax"] >= e["xmin"]) & (b["ymin"] <= e["ymax"]) & (b["ymax"] >= e["ymin"]))
    met = met.filter((F.col("gx") == F.floor(F.greatest(b["xmin"], e["xmin"]) / size)) & (F.col("gy") == F.floor(F.greatest(b["ymin"], e["ymin"]) / size))).drop("gl", "gx", "gy", "el", "zl")
    whole = (b["xmin"] >= e["xmin"]) & (b["xmax"] <= e["xmax"]) & (b["ymin"] >= e["ymin"]) & (b["ymax"] <= e["ymax"])
    # the polygon and the rectangle are all that counts: one test for all images of one extent
    asked = met.filter(~whole).select("zone_id", "extent", "zb", F.col("fine").alias("gl")).distinct()
    asked = asked.withColumn("gy", F.explode(G.grid_range(F.greatest(b["ymin"], e["ymin"]), F.least(b["ymax"], e["ymax"]), size)))
    asked = asked.withColumn("gx", F.explode(G.grid_range(F.greatest(b["xmin"], e["xmin"]), F.least(b["xmax"], e["xmax"]), size)))
    touched = F.exists("edges", lambda s: G.edge_meets_box(s, e["xmin"], e["ymin"], e["xmax"], e["ymax"])) | inside_cell(e["xmin"], e["ymin"])
    cells = polygon_cells(sized)
    hits = asked.join(cells, ["zone_id", "gl", "gx", "gy"]).filter(touched | (F.size("edges") == 0)).select("zone_id", "extent", F.lit(True).alias("mf_hit")).distinct()
    return met.join(hits.hint("merge"), ["zone_id", "extent"], "left").filter(whole | F.coalesce("mf_hit", F.lit(False))).drop("zb", "fine", "mf_hit")


def group_scenes(images: DataFrame) -> DataFrame:
    """Files of each zone, date and sensor; images without a date drop out."""
    return images.filter("acq_date is not null").groupBy("zone_id", "acq_date", "sensor").agg(F.sort_array(F.collect_list("filepath")).alias("files"))


def dem_scenes(scenes: DataFrame) -> DataFrame:
    """The first scene of each zone by date and sensor: elevation mode has one file for each zone."""
    w = Window.partitionBy("zone_id").orderBy("acq_date", "sensor")
    return scenes.withColumn("mf_r", F.row_number().over(w)).filter("mf_r = 1").drop("mf_r")

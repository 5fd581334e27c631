"""The registered queries, one or more for each operator, with their SQL for DuckDB.

Doubles are rounded to 6 digits on both sides, counts are BIGINT.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import PX, PY, SIZE, X0, Y0, view, with_views
from .functions import displacement as D
from .functions import naming
from .operators import catalog, matching, profiles, raster, segment, zones
from .plans import flows
from .schemas import LAYERS
from .sources import layers
from .storage import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        name = fn.__name__.lstrip("_")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_views(sql)
        return fn

    return add


def r6(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in columns})


def thumbs(spark, d) -> DataFrame:
    return catalog.dedupe_thumbs(catalog.parse_thumbs(view(spark, d, "thumb_files")))


def polygons(spark, d) -> DataFrame:
    return zones.zones_from_edges(view(spark, d, "zone_edges"))


#: DuckDB: parsed, deduped thumbs.
T = """thumbs AS (SELECT th_path, max(th_valid) AS th_valid, any_value(th_pz_name) AS th_pz_name, any_value(th_date) AS th_date, any_value(th_sensor) AS th_sensor, any_value(CAST(string_split(th_date, '-')[1] AS INT)) AS th_year, any_value(k) AS th_key FROM (
  SELECT *, string_split(k, '_')[1] AS th_pz_name, string_split(k, '_')[2] AS th_date, string_split(k, '_')[3] AS th_sensor FROM (
    SELECT *, string_split(regexp_extract(th_path, '[^/]*$'), '.')[1] AS k FROM {thumb_files} WHERE regexp_matches(regexp_extract(th_path, '[^/]*$'), '^([a-z]|[A-Z]|-|[0-9])+_[0-9]{4}(-[0-9]{2}){2}_.*.(tif|TIF)$')) WHERE len(string_split(k, '_')) = 3) GROUP BY th_path)"""
P = """pairs AS (SELECT l.th_pz_name AS pz, l.th_path AS lpath, r.th_path AS rpath, l.th_date AS ldate, r.th_date AS rdate, l.th_sensor AS lsensor, r.th_sensor AS rsensor, l.th_year AS lyear, r.th_year AS ryear,
  concat(l.th_pz_name, '_', l.th_date, '-', l.th_sensor, '_', r.th_date, '-', r.th_sensor) AS k FROM thumbs l JOIN thumbs r ON l.th_pz_name = r.th_pz_name AND l.th_path <> r.th_path)"""
#: DuckDB: pixels inside polygons.
HITS = """hits AS (SELECT p.*, z.zone_id FROM {pix} p JOIN (SELECT zone_id, min(least(x1, x2)) AS a, max(greatest(x1, x2)) AS b, min(least(y1, y2)) AS c, max(greatest(y1, y2)) AS d FROM {zone_edges} GROUP BY 1) z
  ON p.x BETWEEN z.a AND z.b AND p.y BETWEEN z.c AND z.d
  WHERE (SELECT count(*) FROM {zone_edges} e WHERE e.zone_id = z.zone_id AND (e.y1 > p.y) <> (e.y2 > p.y) AND p.x < (e.x2 - e.x1) * (p.y - e.y1) / (e.y2 - e.y1) + e.x1) % 2 = 1)"""
YEARS = "abs(left_year - right_year)"

# ---- sources and sinks ---------------------------------------------------------------


@query("SELECT DISTINCT ge_pz_name AS pz_name FROM {zones}")
def _s1_zone_names(spark, d):
    root = fresh_path(spark, "project")
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (1, 0), (0, 1))])
    layers.write_layer(view(spark, d, "zones").select(F.col("ge_pz_name").alias("pz_name"), ring.alias("ring"), F.lit(2154).alias("epsg")), root, "pzones")
    return layers.zone_names(layers.read_layers(spark, root, 2154, ("pzones",))["pzones"])


@query("SELECT layer, pz_name, count(*)::BIGINT AS n FROM (SELECT unnest(['thumbs', 'pairs', 'pzones', 'geomorphs', 'xzones', 'spines']) AS layer, ge_pz_name AS pz_name FROM {zones}) GROUP BY 1, 2")
def _s1_read_layers(spark, d):
    root, rows = fresh_path(spark, "project"), view(spark, d, "zones")
    value = lambda f: F.col("ge_pz_name") if f.name.endswith("pz_name") else F.lit(2154 if f.name == "epsg" else None).cast(f.dataType)
    for name, schema in LAYERS.items():
        layers.write_layer(rows.select(*[value(f).alias(f.name) for f in spark.createDataFrame([], schema).schema]), root, name)
    found = layers.read_layers(spark, root, 2154)
    zone = lambda df: next(c for c in df.columns if c.endswith("pz_name"))
    counts = [df.groupBy(F.lit(name).alias("layer"), F.col(zone(df)).alias("pz_name")).agg(F.count("*").alias("n")) for name, df in found.items()]
    return functools.reduce(DataFrame.unionByName, counts)


@query("SELECT event_id, filepath FROM {bank_files} WHERE NOT ends_with(filepath, '.png')")
def _s2_list_bank(spark, d):
    return layers.list_bank(view(spark, d, "bank_files"))


@query("SELECT filepath, x0, y0, px, py, bands FROM {bank_headers}")
def _s3_bank_map(spark, d):
    root = fresh_path(spark, "project")
    layers.write_bank_map(view(spark, d, "bank_headers").select("filepath", "x0", "y0", "px", "py", "bands"), root, "optical", "all")
    return layers.read_bank_map(spark, root, "optical", "all")


@query(f"WITH {T} SELECT th_path, th_valid, th_pz_name, th_date FROM thumbs")
def _s4_write_thumbs(spark, d):
    root = fresh_path(spark, "project")
    return spark.read.parquet(layers.write_thumbs(thumbs(spark, d).select("th_path", "th_valid", "th_pz_name", "th_date"), root))


@query(f"WITH {T}, {P} SELECT k AS pa_key, pz AS pa_pz_name, lpath AS pa_left_path, rpath AS pa_right_path FROM pairs")
def _s4_write_pairs(spark, d):
    root = fresh_path(spark, "project")
    pairs = catalog.make_pairs(thumbs(spark, d)).select("pa_key", "pa_pz_name", "pa_left_path", "pa_right_path")
    return spark.read.parquet(layers.write_pairs(pairs, root))


@query("SELECT raster_id, label, count(*)::BIGINT AS n, 'areas_N2_min5' AS layer FROM {pix} GROUP BY 1, 2")
def _s6_write_areas(spark, d):
    root = fresh_path(spark, "project")
    return spark.read.parquet(layers.write_areas(view(spark, d, "pix").groupBy("raster_id", "label").agg(F.count("*").alias("n")), root, 2, 5))


# ---- names ----------------------------------------------------------------------------


@query(f"WITH {T} SELECT th_path, th_key, th_pz_name, th_date, th_sensor, th_year, th_valid FROM thumbs")
def _p1_parse_thumb_name(spark, d):
    return thumbs(spark, d).select("th_path", "th_key", "th_pz_name", "th_date", "th_sensor", "th_year", "th_valid")


@query(f"""WITH {T}, {P} SELECT lpath, rpath, k AS pa_key, concat('/bank/', pz, '/displacements/', k) AS pa_path, concat('/bank/', pz, '/displacements/', k, '/asp_outputs/', k, '_run-F.tif') AS pa_dispf_path,
  concat('/bank/', pz, '/displacements/', k, '/asp_outputs/', k, '_corr-eval-ncc.tif') AS pa_snr_path, concat('/bank/', pz, '/displacements/', k, '/', k, '_magn.tif') AS pa_magn_path, concat('/bank/', pz, '/displacements/', k, '/', k, '_vect.gpkg') AS pa_vect_path FROM pairs""")
def _p2_pair_key(spark, d):
    return catalog.pair_files(catalog.make_pairs(thumbs(spark, d))).select(F.col("pa_left_path").alias("lpath"), F.col("pa_right_path").alias("rpath"), "pa_key", "pa_path", "pa_dispf_path", "pa_snr_path", "pa_magn_path", "pa_vect_path")


@query(f"""WITH {T}, {P} SELECT concat('/bank/', pz, '/displacements/', k) AS pa_path, pz AS pz_name, ldate AS left_date, lsensor AS left_sensor, rdate AS right_date, rsensor AS right_sensor,
  concat(pz, '_', ldate, '_', lsensor) AS left_key, concat(pz, '_', rdate, '_', rsensor) AS right_key FROM pairs""")
def _p3_parse_pair_key(spark, d):
    return catalog.parse_pair_paths(catalog.pair_files(catalog.make_pairs(thumbs(spark, d))).select("pa_path"))


@query("SELECT filepath, CASE WHEN regexp_matches(filepath, 'aerial') THEN 'aerial' WHEN regexp_matches(filepath, 'spot6') THEN 'spot6' ELSE 'unknown' END AS sensor FROM {bank_files}")
def _p4_extract_sensor(spark, d):
    return view(spark, d, "bank_files").select("filepath", naming.extract_sensor(F.col("filepath")).alias("sensor"))


BANK = """bank AS (SELECT b.event_id, h.*, CASE WHEN event_id % 5 IN (0, 2) THEN 'aerial' WHEN event_id % 5 = 1 THEN 'spot6' ELSE 'unknown' END AS sensor,
  CASE event_id % 5 WHEN 0 THEN concat(CAST(2000 + event_id % 20 AS STRING), '-07-04') WHEN 1 THEN concat(CAST(2000 + event_id % 20 AS STRING), '-06-01') WHEN 2 THEN concat(CAST(2000 + event_id % 20 AS STRING), '-01-01') END AS acq_date
  FROM {bank_files} b JOIN {bank_headers} h USING (filepath) WHERE event_id % 5 <> 4 AND NOT (event_id % 5 = 1 AND event_id % 3 = 0))"""
EXT = "x0 AS xmin, y0 + py * n_rows AS ymin, x0 + px * n_cols AS xmax, y0 AS ymax"


def bank(spark, d):
    return catalog.bank_features(layers.list_bank(view(spark, d, "bank_files").drop("event_id")), view(spark, d, "bank_headers"), view(spark, d, "bank_xml"))


@query(f"WITH {BANK} SELECT filepath, sensor, acq_date FROM bank")
def _p5_extract_acq_date(spark, d):
    return bank(spark, d).select("filepath", "sensor", "acq_date")


@query("WITH f AS (SELECT replace(replace(filepath, '/swissimage_', '/dem_'), '/x/', '/dem/') AS filepath FROM {bank_files} WHERE event_id % 5 = 2) SELECT filepath, 'dem' AS sensor, string_split(regexp_extract(filepath, '[^/]*$'), '_')[2] AS acq_date FROM f")
def _p5_dem_date(spark, d):
    files = view(spark, d, "bank_files").filter("event_id % 5 = 2").select(F.replace(F.replace("filepath", F.lit("/swissimage_"), F.lit("/dem_")), F.lit("/x/"), F.lit("/dem/")).alias("filepath"))
    return files.withColumn("a", naming.acquisition(F.col("filepath"), F.lit(None).cast("string"), "dem")).select("filepath", "a.sensor", "a.acq_date")


@query(f"WITH {BANK} SELECT regexp_extract(filepath, '[^/]*$') AS filename, sensor, abs(px) AS xRes, abs(py) AS yRes, bands, n_rows AS rows, n_cols AS cols, acq_date, {EXT}, filepath FROM bank")
def _p6_bank_features(spark, d):
    return bank(spark, d).select("filename", "sensor", "xRes", "yRes", "bands", "rows", "cols", "acq_date", "extent.*", "filepath")


@query("SELECT raster_id, CASE WHEN raster_id % 5 = 4 THEN 'empty' WHEN raster_id % 2 = 0 THEN 'complete' WHEN raster_id % 3 = 0 THEN 'clipped' ELSE 'corrupt' END AS pa_status FROM {pair_meta}")
def _p7_pair_status(spark, d):
    return catalog.pair_status(view(spark, d, "pair_meta").select("raster_id"), view(spark, d, "artifacts"), "raster_id")


# ---- pixel maths ------------------------------------------------------------------------

XY = "raster_id, row, col"


@query(f"SELECT {XY}, round(sqrt(dx * dx + dy * dy) * 2, 6) AS magn FROM {{pix}}")
def _p8_magnitude(spark, d):
    return r6(view(spark, d, "pix").select("raster_id", "row", "col", D.magnitude(F.col("dx"), F.col("dy"), F.lit(PX)).alias("magn")), "magn")


P9_SQL = f"""WITH m AS (SELECT {XY}, dx, dy, dx * 2 * s AS mx, dy * -2 * s AS my, nullif(abs(left_year - right_year), 0) AS n FROM (SELECT p.*, left_year, right_year, CASE WHEN left_year > right_year THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM {{pix}} p JOIN {{pair_meta}} USING (raster_id)))
  SELECT {XY}, round(dx, 6) + 0.0 AS dx_in_pixels, round(dy, 6) + 0.0 AS dy_in_pixels, round(mx, 6) + 0.0 AS dx_in_meters, round(my, 6) + 0.0 AS dy_in_meters, round(sqrt(mx * mx + my * my), 6) AS d_in_meters,
  round(mx / n, 6) + 0.0 AS dx_in_meters_per_year, round(my / n, 6) + 0.0 AS dy_in_meters_per_year, round(sqrt(mx * mx + my * my) / n, 6) AS d_in_meters_per_year, round(degrees(atan2(dy + 0.0, dx + 0.0)), 6) AS direction FROM m"""


@query(P9_SQL)
def _p9_vector_attributes(spark, d):
    rows = view(spark, d, "pix").join(view(spark, d, "pair_meta"), "raster_id")
    a = D.vector_attributes(F.col("dx"), F.col("dy"), F.lit(PX), F.lit(PY), F.col("left_year"), F.col("right_year"))
    return r6(rows.select("raster_id", "row", "col", *[c.alias(n) for n, c in a.items()]), *a)


#: The same rows with zone, pair and layer.
S5_SQL = P9_SQL.replace("SELECT raster_id, row, col, dx, dy,", "SELECT raster_id, row, col, pz_name, dx, dy,").replace("SELECT p.*, left_year", "SELECT p.*, pz_name, left_year")
S5_SQL = S5_SQL.replace(" FROM m", ", pz_name AS pa_pz_name, concat('k', CAST(raster_id AS STRING)) AS pa_key, concat('20_k', CAST(raster_id AS STRING), 'shift') AS layer FROM m")


@query(S5_SQL)
def _s5_write_vectors(spark, d):
    root = fresh_path(spark, "project")
    rows = view(spark, d, "pix").join(view(spark, d, "pair_meta"), "raster_id")
    a = D.vector_attributes(F.col("dx"), F.col("dy"), F.lit(PX), F.lit(PY), F.col("left_year"), F.col("right_year"))
    fields = rows.select(F.col("pz_name").alias("pa_pz_name"), F.concat(F.lit("k"), F.col("raster_id").cast("string")).alias("pa_key"), "raster_id", "row", "col", *[c.alias(n) for n, c in a.items()])
    return r6(spark.read.parquet(layers.write_vectors(fields, root, 20)), *a)


@query(f"SELECT {XY}, round(dx / nullif({YEARS}, 0), 6) + 0.0 AS vx, round(dy / nullif({YEARS}, 0), 6) + 0.0 AS vy, round(sqrt(dx * dx + dy * dy) * 2 / nullif({YEARS}, 0), 6) AS vm FROM {{pix}} JOIN {{pair_meta}} USING (raster_id)")
def _p10_velocity(spark, d):
    rows = view(spark, d, "pix").join(view(spark, d, "pair_meta"), "raster_id")
    year = lambda v: D.per_year(v, F.col("left_year"), F.col("right_year"))
    return r6(rows.select("raster_id", "row", "col", year(F.col("dx")).alias("vx"), year(F.col("dy")).alias("vy"), year(D.magnitude(F.col("dx"), F.col("dy"), F.lit(PX))).alias("vm")), "vx", "vy", "vm")


@query(f"SELECT {XY}, round(sqrt(dx * dx + dy * dy) * 2, 6) AS m, round(dx, 6) + 0.0 AS x, round(dy, 6) + 0.0 AS y, round(sqrt(dx * dx + dy * dy) * 2 / nullif({YEARS}, 0), 6) AS vm, round(dx / nullif({YEARS}, 0), 6) + 0.0 AS vx, round(dy / nullif({YEARS}, 0), 6) + 0.0 AS vy FROM {{pix}} JOIN {{pair_meta}} USING (raster_id)")
def _p11_component(spark, d):
    rows = view(spark, d, "pix").join(view(spark, d, "pair_meta"), "raster_id")
    modes = ["m", "x", "y", "vm", "vx", "vy"]
    return r6(rows.select("raster_id", "row", "col", *[D.component(m.upper(), F.col("dx"), F.col("dy"), F.lit(PX), F.col("left_year"), F.col("right_year")).alias(m) for m in modes]), *modes)


@query(f"SELECT {XY}, CASE WHEN dx > -4 AND dx < 4 THEN round(dx, 6) + 0.0 END AS dx FROM {{pix}}")
def _p12_outlier_filter(spark, d):
    return r6(view(spark, d, "pix").select("raster_id", "row", "col", D.outlier_filter(F.col("dx"), -4, 4).alias("dx")), "dx")


@query(f"SELECT {XY}, CASE WHEN row % 3 <> 0 AND cc >= 0.5 THEN round(dx, 6) + 0.0 END AS dx FROM {{pix}}")
def _p13_cc_threshold_filter(spark, d):
    pix = view(spark, d, "pix")
    return r6(raster.cc_threshold_filter(pix.select("raster_id", "row", "col", "dx"), pix.filter("row % 3 <> 0").select("raster_id", "row", "col", "cc"), ["dx"]), "dx")


@query(f"SELECT {XY}, round(sqrt(dx * dx + dy * dy), 6) AS magn FROM {{pix}} WHERE row % 4 = 0 AND col % 4 = 0")
def _p14_stride_field(spark, d):
    return r6(raster.stride_field(view(spark, d, "pix"), 4).select("raster_id", "row", "col", "magn"), "magn")


@query("SELECT raster_id, CASE WHEN left_year > right_year THEN 'reversed' ELSE 'regular' END AS direction FROM {pair_meta}")
def _p15_direction_of_time(spark, d):
    return view(spark, d, "pair_meta").select("raster_id", D.time_direction(F.col("left_year"), F.col("right_year")).alias("direction"))


# ---- filters ----------------------------------------------------------------------------


@query(f"WITH {T} SELECT th_path FROM thumbs WHERE contains(lower(th_path), 'spot') AND contains(lower(th_path), 'pz1')")
def _f1_search_thumbs(spark, d):
    return catalog.search_thumbs(thumbs(spark, d), ["SPOT", "pz1"]).select("th_path")


@query(f"WITH {T}, {P} SELECT DISTINCT k AS pa_key FROM pairs WHERE contains(lower(k), '1995') AND contains(lower(k), 'aerial')")
def _f1_search_pairs(spark, d):
    return catalog.search_pairs(catalog.pair_files(catalog.make_pairs(thumbs(spark, d))), (1995, "aerial")).select("pa_key").distinct()


@query("SELECT DISTINCT ge_pz_name AS pz_name FROM {zones} WHERE ge_pz_name = 'pz3'")
def _f2_search_pzones(spark, d):
    return catalog.search_pzones(view(spark, d, "zones").select(F.col("ge_pz_name").alias("pz_name")).distinct(), ["PZ3", "x"])


@query("SELECT zone_id, ge_pz_name, ge_frogi_id FROM {zones} WHERE ge_pz_name = 'pz3' AND ge_frogi_id = 'GE15'")
def _f3_search_geomorphs(spark, d):
    z = view(spark, d, "zones")
    return catalog.search_geomorphs(z, z.select(F.col("ge_pz_name").alias("pz_name")), ["pz3", "GE15"])


@query("SELECT raster_id, left_year, right_year FROM {pair_meta} WHERE least(left_year, right_year) >= 2001 AND greatest(left_year, right_year) <= 2005")
def _f4_pairs_on_period(spark, d):
    return catalog.pairs_on_period(view(spark, d, "pair_meta"), 2001, 2005, left="left_year", right="right_year").select("raster_id", "left_year", "right_year")


@query("SELECT raster_id, left_year, right_year FROM {pair_meta} WHERE least(left_year, right_year) >= 2001 AND greatest(left_year, right_year) >= 2005")
def _f5_pairs_after(spark, d):
    return catalog.pairs_on_period(view(spark, d, "pair_meta"), 2001, 2005, "after", "left_year", "right_year").select("raster_id", "left_year", "right_year")


@query(f"WITH {T} SELECT th_path FROM thumbs WHERE th_valid = '1' AND th_pz_name = 'pz1'")
def _f6_valid_thumbs(spark, d):
    return catalog.valid_thumbs(thumbs(spark, d), "pz1").select("th_path")


@query("SELECT raster_id, pz_name FROM {pair_meta} WHERE pa_status = 'complete'")
def _f7_complete_pairs(spark, d):
    return catalog.complete_pairs(view(spark, d, "pair_meta")).select("raster_id", "pz_name")


@query("SELECT ge_frogi_id, count(*)::BIGINT AS n FROM {zones} GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT DISTINCT sp_ge_id, 0::BIGINT FROM {spines} WHERE sp_ge_id NOT IN (SELECT ge_frogi_id FROM {zones})")
def _f8_unique_key_check(spark, d):
    return catalog.unique_key_check(view(spark, d, "zones"), "ge_frogi_id", view(spark, d, "spines").select(F.col("sp_ge_id").alias("ge_frogi_id")))


@query("SELECT DISTINCT pz_name FROM {pair_meta} WHERE CAST(replace(pz_name, 'pz', '') AS INT) % 2 = 0")
def _f10_zones_with_dem(spark, d):
    zone = view(spark, d, "pair_meta").select("pz_name").distinct()
    files = zone.filter("cast(replace(pz_name, 'pz', '') as int) % 2 = 0").select(F.concat(F.lit("/bank/"), "pz_name", F.lit("/dems/"), "pz_name", F.lit("_dem.tif")).alias("filepath"))
    return catalog.zones_with_dem(zone, files)


@query(f"SELECT {XY} FROM {{pix}} WHERE x BETWEEN 10.5 AND 30 AND y BETWEEN 20 AND 41")
def _f11_crop_pixels(spark, d):
    return raster.crop_pixels(view(spark, d, "pix"), 10.5, 20, 30, 41, X0, Y0, PX, PY).select("raster_id", "row", "col")


@query(f"WITH {HITS} SELECT raster_id, row, col, CASE WHEN h.raster_id IS NOT NULL THEN round(p.dx, 6) + 0.0 END AS dx FROM {{pix}} p LEFT JOIN (SELECT DISTINCT raster_id, row, col FROM hits) h USING (raster_id, row, col)")
def _f11_mask_pixels(spark, d):
    pix = view(spark, d, "pix")
    hits = zones.zonal_join(pix.select("raster_id", "row", "col", "x", "y"), polygons(spark, d))
    return r6(raster.mask_pixels(pix.select("raster_id", "row", "col", "dx"), hits, ["dx"]), "dx")


# ---- joins ------------------------------------------------------------------------------

PAIR_COLUMNS = ["pa_key", "pa_left_path", "pa_right_path", "pa_left_year", "pa_right_year"]


@query(f"WITH {T}, {P} SELECT k AS pa_key, lpath AS pa_left_path, rpath AS pa_right_path, lyear AS pa_left_year, ryear AS pa_right_year FROM pairs")
def _j1_make_pairs(spark, d):
    return catalog.make_pairs(thumbs(spark, d)).select(*PAIR_COLUMNS)


@query(f"WITH {T}, v AS (SELECT * FROM thumbs WHERE th_valid = '1'), {P.replace('thumbs l JOIN thumbs r', 'v l JOIN v r')} SELECT k AS pa_key, lpath AS pa_left_path, rpath AS pa_right_path, lyear AS pa_left_year, ryear AS pa_right_year FROM pairs")
def _j2_make_valid_pairs(spark, d):
    return catalog.make_valid_pairs(thumbs(spark, d)).select(*PAIR_COLUMNS)


MET = """img AS (SELECT filepath, sensor, acq_date, x0 AS xmin, y0 + py * n_rows AS ymin, x0 + px * n_cols AS xmax, y0 AS ymax FROM bank),
zb AS (SELECT zone_id, min(least(x1, x2)) AS a, min(least(y1, y2)) AS b, max(greatest(x1, x2)) AS c, max(greatest(y1, y2)) AS d FROM {zone_edges} GROUP BY 1),
cand AS (SELECT * FROM img JOIN zb ON a <= xmax AND c >= xmin AND b <= ymax AND d >= ymin),
met AS (SELECT zone_id, filepath, any_value(sensor) AS sensor, any_value(acq_date) AS acq_date FROM (SELECT cand.*, e.x1, e.y1, e.x2, e.y2,
    (x2 - x1) * (ymin - y1) - (y2 - y1) * (xmin - x1) AS k1, (x2 - x1) * (ymax - y1) - (y2 - y1) * (xmin - x1) AS k2, (x2 - x1) * (ymin - y1) - (y2 - y1) * (xmax - x1) AS k3, (x2 - x1) * (ymax - y1) - (y2 - y1) * (xmax - x1) AS k4
  FROM cand JOIN {zone_edges} e USING (zone_id)) GROUP BY 1, 2
  HAVING bool_or(least(x1, x2) <= xmax AND greatest(x1, x2) >= xmin AND least(y1, y2) <= ymax AND greatest(y1, y2) >= ymin AND least(k1, k2, k3, k4) <= 0 AND greatest(k1, k2, k3, k4) >= 0)
    OR count(*) FILTER ((y1 > ymin) <> (y2 > ymin) AND xmin < (x2 - x1) * (ymin - y1) / (y2 - y1) + x1) % 2 = 1)"""


@query(f"WITH {BANK}, {MET} SELECT zone_id, filepath FROM met")
def _j3_images_on_zones(spark, d):
    return catalog.images_on_zones(bank(spark, d), polygons(spark, d)).select("zone_id", "filepath")


@query(f"WITH {T} SELECT th_path FROM thumbs WHERE th_valid <> '1'")
def _j4_pending_thumbs(spark, d):
    t = thumbs(spark, d).select("th_path", "th_valid")
    return catalog.pending_thumbs(t.select("th_path"), t.filter("th_valid = '1'"))


@query(f"""WITH {T}, stored AS (SELECT th_path, '7' AS th_valid, th_year FROM thumbs WHERE th_year % 2 = 0 UNION ALL SELECT concat(th_path, '.gone'), '7', th_year FROM thumbs WHERE th_year % 3 = 0)
  SELECT th_path, th_valid, th_year FROM stored WHERE th_path IN (SELECT th_path FROM thumbs WHERE ends_with(th_path, '.tif')) UNION ALL
  SELECT th_path, th_valid, th_year FROM thumbs WHERE ends_with(th_path, '.tif') AND th_path NOT IN (SELECT th_path FROM stored)""")
def _j5_refresh_thumbs(spark, d):
    t = thumbs(spark, d).select("th_path", "th_valid", "th_year")
    kept = t.filter("th_year % 2 = 0").withColumn("th_valid", F.lit("7"))
    gone = t.filter("th_year % 3 = 0").select(F.concat("th_path", F.lit(".gone")).alias("th_path"), F.lit("7").alias("th_valid"), "th_year")
    return catalog.refresh_thumbs(kept.unionByName(gone), view(spark, d, "thumb_files"))


@query(f"WITH {T}, {P} SELECT k AS pa_key, lpath AS pa_left_path, rpath AS pa_right_path, concat('/bank/', pz, '/displacements/', k) AS pa_path, CASE WHEN lyear % 4 = 0 THEN 'complete' WHEN lyear % 4 = 1 THEN 'clipped' WHEN lyear % 4 = 2 THEN 'corrupt' ELSE 'empty' END AS pa_status FROM pairs")
def _j6_refresh_pairs(spark, d):
    t = thumbs(spark, d)
    seen = catalog.make_pairs(t).select("pa_key", F.expr("filter(array(if(pa_left_year % 4 < 3, 'folder', null), if(pa_left_year % 4 < 2, 'inputs', null), if(pa_left_year % 4 = 0, 'dispf', null)), k -> k is not null)").alias("k"))
    return catalog.refresh_pairs(t, seen.select("pa_key", F.explode("k").alias("kind"))).select("pa_key", "pa_left_path", "pa_right_path", "pa_path", "pa_status")


@query("""WITH pr AS (SELECT raster_id AS pair_id, raster_id AS left_id, raster_id + 1 AS right_id FROM {pair_meta}),
  pl AS (SELECT raster_id, row + raster_id % 3 AS row, col + raster_id % 2 AS col, dx FROM {pix})
  SELECT pair_id, l.row, l.col, round(l.dx, 6) + 0.0 AS left, round(r.dx, 6) + 0.0 AS right FROM pr JOIN pl l ON l.raster_id = left_id JOIN pl r ON r.raster_id = right_id AND r.row = l.row AND r.col = l.col""")
def _j7_clip_pair(spark, d):
    meta = view(spark, d, "pair_meta")
    pairs = meta.select(F.col("raster_id").alias("pair_id"), F.col("raster_id").alias("left_id"), (F.col("raster_id") + 1).alias("right_id"))
    origin = meta.select("raster_id", (F.col("raster_id") % 3).alias("row0"), (F.col("raster_id") % 2).alias("col0"))
    return r6(raster.clip_pair(view(spark, d, "pix"), pairs, "dx", origin), "left", "right")


@query(f"WITH {BANK}, e AS (SELECT event_id, {EXT} FROM bank) SELECT l.event_id, greatest(l.xmin, r.xmin) AS xmin, greatest(l.ymin, r.ymin) AS ymin, least(l.xmax, r.xmax) AS xmax, least(l.ymax, r.ymax) AS ymax FROM e l JOIN e r ON r.event_id = l.event_id + 60 WHERE greatest(l.xmin, r.xmin) < least(l.xmax, r.xmax) AND greatest(l.ymin, r.ymin) < least(l.ymax, r.ymax)")
def _j7_clip_extents(spark, d):
    e = bank(spark, d).join(view(spark, d, "bank_files"), "filepath").select("event_id", "extent")
    both = e.join(e.select((F.col("event_id") - 60).alias("event_id"), F.col("extent").alias("other")), "event_id")
    return both.select("event_id", raster.clip_extents(F.col("extent"), F.col("other")).alias("c")).filter("c is not null").select("event_id", "c.*")


@query(f"WITH {T} SELECT zone_id, ge_frogi_id, th_path FROM {{zones}} JOIN thumbs ON ge_pz_name = th_pz_name")
def _j8_lookup_zone(spark, d):
    return catalog.lookup_zone(view(spark, d, "zones"), "ge_pz_name", thumbs(spark, d), "th_pz_name").select("zone_id", "ge_frogi_id", "th_path")


@query("SELECT ge_frogi_id, sp_id FROM {zones} JOIN {spines} ON sp_ge_id = ge_frogi_id")
def _j9_geomorph_spines(spark, d):
    return catalog.geomorph_spines(view(spark, d, "zones"), view(spark, d, "spines")).select("ge_frogi_id", "sp_id")


@query("SELECT point_id, raster_id, round(dx, 6) + 0.0 AS shift FROM (SELECT *, CAST(floor((y - 64) / -2.0::DOUBLE) AS INT) AS r, CAST(floor(x / 2.0::DOUBLE) AS INT) AS c FROM {points}) p LEFT JOIN {pix} q ON q.row = p.r AND q.col = p.c")
def _j10_sample_points(spark, d):
    # values are read as they are: rounded once for each pixel, not for each point
    return zones.sample_points(view(spark, d, "points"), r6(view(spark, d, "pix"), "dx"), "dx", "shift.v1.tif", X0, Y0, PX, PY).select("point_id", "raster_id", "shift")


@query("""WITH near AS (SELECT point_id, unnest(range(CAST(floor((64 - p.y - 3) / 2.0::DOUBLE) AS INT), CAST(ceil((64 - p.y + 3) / 2.0::DOUBLE) AS INT) + 1)) AS row, p.x, p.y FROM {points} p),
  cells AS (SELECT point_id, row, unnest(range(CAST(floor((x - 3) / 2.0::DOUBLE) AS INT), CAST(ceil((x + 3) / 2.0::DOUBLE) AS INT) + 1)) AS col, x, y FROM near),
  means AS (SELECT point_id, raster_id, avg(dx) AS m FROM cells c JOIN {pix} q USING (row, col) WHERE (q.x - c.x) * (q.x - c.x) + (q.y - c.y) * (q.y - c.y) <= 9 GROUP BY 1, 2)
  SELECT point_id, raster_id, round(m, 6) + 0.0 AS mean FROM {points} LEFT JOIN means USING (point_id)""")
def _j11_sample_points_buffer(spark, d):
    return r6(zones.sample_points_buffer(view(spark, d, "points"), view(spark, d, "pix"), "dx", 3.0, X0, Y0, PX, PY), "mean")


@query(f"WITH {HITS} SELECT zone_id, raster_id, row, col FROM hits")
def _j12_zonal_join(spark, d):
    return zones.zonal_join(view(spark, d, "pix").select("raster_id", "row", "col", "x", "y"), polygons(spark, d)).select("zone_id", "raster_id", "row", "col")


# ---- aggregations -----------------------------------------------------------------------


@query(f"WITH {BANK}, {MET} SELECT zone_id, acq_date, sensor, string_agg(filepath, ',' ORDER BY filepath) AS files FROM met WHERE acq_date IS NOT NULL GROUP BY 1, 2, 3")
def _a1_group_scenes(spark, d):
    return catalog.group_scenes(catalog.images_on_zones(bank(spark, d), polygons(spark, d))).withColumn("files", F.array_join("files", ","))


@query("SELECT raster_id // 3 AS thumb, row, col, round(arg_min(dx, raster_id) FILTER (dx > -3), 6) + 0.0 AS value FROM {pix} GROUP BY 1, 2, 3")
def _a2_mosaic(spark, d):
    rows = view(spark, d, "pix").selectExpr("raster_id div 3 as thumb", "row", "col", "lpad(cast(raster_id as string), 12, '0') as filepath", "case when dx > -3 then dx end as value")
    return r6(raster.mosaic(rows, ["thumb", "row", "col"]), "value")


@query("SELECT raster_id, CAST(floor(row * 2 / 5.0) AS INT) AS row, CAST(floor(col * 2 / 5.0) AS INT) AS col, round(avg(dx), 6) + 0.0 AS dx, round(avg(dy), 6) + 0.0 AS dy FROM {pix} GROUP BY ALL")
def _a3_resample_average(spark, d):
    return r6(raster.resample_average(view(spark, d, "pix"), ["dx", "dy"], PX, PY, 5.0), "dx", "dy")


@query("""WITH g AS (SELECT DISTINCT raster_id, r, c, CAST(floor((r + 0.5) * 3 / 2.0) AS INT) AS sr, CAST(floor((c + 0.5) * 3 / 2.0) AS INT) AS sc FROM (SELECT DISTINCT raster_id FROM {pix}), range(0, 22) a(r), range(0, 22) b(c))
  SELECT g.raster_id, CAST(r AS INT) AS row, CAST(c AS INT) AS col, round(dx, 6) + 0.0 AS dx FROM g JOIN {pix} p ON p.raster_id = g.raster_id AND p.row = sr AND p.col = sc""")
def _a3_resample_nearest(spark, d):
    return r6(raster.resample_nearest(view(spark, d, "pix"), ["dx"], PX, PY, 3.0), "dx")


@query(f"SELECT {XY}, round(dx - median(dx) OVER (PARTITION BY raster_id), 6) + 0.0 AS dx FROM {{pix}}")
def _a4_center_median(spark, d):
    return r6(raster.center_disp(view(spark, d, "pix").select("raster_id", "row", "col", "dx"), "dx"), "dx")


@query(f"SELECT {XY}, CASE WHEN raster_id % 2 = 0 THEN round(dx - avg(dx) OVER (PARTITION BY raster_id), 6) + 0.0 END AS dx FROM {{pix}}")
def _a4_center_mean(spark, d):
    rows = view(spark, d, "pix").selectExpr("raster_id", "row", "col", "case when raster_id % 2 = 1 and row = 3 then null else dx end as dx")
    return r6(raster.center_disp(rows, "dx", "mean"), "dx")


MEANS = f"{HITS}, means AS (SELECT zone_id, raster_id, avg(sqrt(dx * dx + dy * dy) * 2) AS d FROM hits GROUP BY 1, 2)"


def magn_hits(spark, d):
    pix = view(spark, d, "pix").withColumn("magn", D.magnitude(F.col("dx"), F.col("dy"), F.lit(PX)))
    return zones.zonal_join(pix.select("raster_id", "row", "col", "x", "y", "magn"), polygons(spark, d))


@query(f"WITH {MEANS} SELECT zone_id, raster_id, round(d, 6) AS d FROM means")
def _a5_zone_mean_displacement(spark, d):
    return r6(zones.zone_mean(magn_hits(spark, d)), "d")


OVERVIEW = f"WITH {MEANS} SELECT zone_id, raster_id, left_year AS L, right_year AS R, round(d, 6) AS D, round(d / nullif({YEARS}, 0), 6) AS V FROM means JOIN {{pair_meta}} USING (raster_id) WHERE pa_status = 'complete'"


@query(OVERVIEW)
def _a6_geomorph_overview(spark, d):
    return r6(zones.geomorph_overview(magn_hits(spark, d), view(spark, d, "pair_meta")), "D", "V")


@query(f"WITH {MEANS} SELECT zone_id, raster_id, left_year AS l, right_year AS r, round(d, 6) AS d, round(d / nullif(right_year - left_year, 0), 6) + 0.0 AS s, round(abs(d), 6) AS abs_s FROM means JOIN {{pair_meta}} USING (raster_id) WHERE pa_status = 'complete'")
def _a7_xzone_overview(spark, d):
    return r6(zones.xzone_overview(magn_hits(spark, d), view(spark, d, "pair_meta")), "d", "s", "abs_s")


SUMS = "sums AS (SELECT zone, row, col, sum(label) AS total, count(*) AS n FROM (SELECT p.*, pz_name AS zone FROM {pix} p JOIN {pair_meta} USING (raster_id) WHERE pa_status = 'complete') GROUP BY 1, 2, 3), want AS (SELECT pz_name AS zone, count(*) AS n FROM {pair_meta} WHERE pa_status = 'complete' GROUP BY 1)"


@query(f"WITH {SUMS} SELECT zone, row, col, total::BIGINT AS total, n::BIGINT AS n FROM sums JOIN want USING (zone, n)")
def _a8_add_moving_areas(spark, d):
    return segment.add_moving_areas(view(spark, d, "pix").select("raster_id", "row", "col", "label"), view(spark, d, "pair_meta"))


def kmeans_sql(source: str, key: str, value: str, rounds: int = 20, name: str = "c") -> str:
    """The same rounds, unrolled (k = 2)."""
    parts = [f"{name}v AS MATERIALIZED (SELECT {key} AS g, {value}::DOUBLE AS v, count(*) AS n FROM {source} GROUP BY 1, 2)", f"{name}0 AS MATERIALIZED (SELECT {key} AS g, quantile_cont({value}::DOUBLE, 0.25) AS a, quantile_cont({value}::DOUBLE, 0.75) AS b FROM {source} GROUP BY 1)"]
    for r in range(rounds):
        far = "abs(v - a) <= abs(v - b)"
        a, b = f"coalesce(sum(v * n) FILTER ({far}) / sum(n) FILTER ({far}), any_value(a))", f"coalesce(sum(v * n) FILTER (NOT {far}) / sum(n) FILTER (NOT {far}), any_value(b))"
        parts.append(f"{name}{r + 1} AS MATERIALIZED (SELECT g, least(p, q) AS a, greatest(p, q) AS b FROM (SELECT g, {a} AS p, {b} AS q FROM {name}v JOIN {name}{r} USING (g) GROUP BY 1))")
    return ", ".join(parts)


KM = kmeans_sql("(SELECT raster_id, round(dx, 3) AS v FROM {pix})", "raster_id", "v")


@query(f"WITH {KM} SELECT raster_id, row, col, CASE WHEN abs(round(dx, 3) - a) <= abs(round(dx, 3) - b) THEN 0 ELSE 1 END AS label FROM {{pix}} JOIN c20 ON g = raster_id")
def _a9_kmeans_labels(spark, d):
    return segment.kmeans_1d(view(spark, d, "pix").select("raster_id", "row", "col", F.round("dx", 3).alias("v")), "v")[0].select("raster_id", "row", "col", "label")


@query(f"WITH {KM} SELECT g AS raster_id, 0 AS label, round(a, 6) + 0.0 AS centroid FROM c20 UNION ALL SELECT g, 1, round(b, 6) + 0.0 FROM c20")
def _a9_kmeans_centroids(spark, d):
    return r6(segment.kmeans_1d(view(spark, d, "pix").select("raster_id", "row", "col", F.round("dx", 3).alias("v")), "v")[1], "centroid")


@query(f"WITH {SUMS}, good AS (SELECT sums.* FROM sums JOIN want USING (zone, n)), {kmeans_sql('good', 'zone', 'total')} SELECT zone, row, col, CASE WHEN abs(total - a) <= abs(total - b) THEN 0 ELSE 1 END AS label FROM good JOIN c20 ON g = zone")
def _a10_cluster_addition(spark, d):
    sums = segment.add_moving_areas(view(spark, d, "pix").select("raster_id", "row", "col", "label"), view(spark, d, "pair_meta"))
    return segment.cluster_addition(sums)[0].select("zone", "row", "col", "label")


@query("SELECT pz_name, coalesce(string_agg(CAST(raster_id AS STRING), ',' ORDER BY CAST(raster_id AS STRING)) FILTER (pa_status = 'complete'), '') AS complete, coalesce(string_agg(CAST(raster_id AS STRING), ',' ORDER BY CAST(raster_id AS STRING)) FILTER (pa_status <> 'complete'), '') AS abort FROM {pair_meta} GROUP BY 1")
def _a11_batch_log(spark, d):
    rows = view(spark, d, "pair_meta").select("pz_name", F.col("raster_id").cast("string").alias("k"), F.when(F.col("pa_status") == "complete", "COMPLETE").otherwise("ABORT").alias("outcome"))
    return catalog.batch_log(rows, "pz_name", "k").select("pz_name", F.array_join("complete", ",").alias("complete"), F.array_join("abort", ",").alias("abort"))


# ---- windows, morphology ------------------------------------------------------------------

DENSE = "dense AS (SELECT r.raster_id, CAST(a.r AS INT) AS row, CAST(b.c AS INT) AS col, label AS v FROM (SELECT DISTINCT raster_id FROM {pix}) r CROSS JOIN range(0, 32) a(r) CROSS JOIN range(0, 32) b(c) LEFT JOIN {pix} p ON p.raster_id = r.raster_id AND p.row = a.r AND p.col = b.c)"


def window_sql(name: str, source: str, fn: str, lo: int, hi: int) -> str:
    w = f"RANGE BETWEEN {lo} PRECEDING AND {hi} FOLLOWING"
    return f"{name}0 AS MATERIALIZED (SELECT raster_id, row, col, {fn}(v) OVER (PARTITION BY raster_id, row ORDER BY col {w}) AS v FROM {source}), {name} AS MATERIALIZED (SELECT raster_id, row, col, {fn}(v) OVER (PARTITION BY raster_id, col ORDER BY row {w}) AS v FROM {name}0)"


def dense(spark, d):
    meta = view(spark, d, "pair_meta").select("raster_id", F.lit(SIZE).alias("n_rows"), F.lit(SIZE).alias("n_cols"))
    return raster.densify(view(spark, d, "pix").select("raster_id", "row", "col", "label"), meta)


@query(f"WITH {DENSE}, {window_sql('e', 'dense', 'min', 2, 2)}, {window_sql('o', 'e', 'max', 2, 2)} SELECT raster_id, row, col, v AS label FROM o")
def _w1_morph_open(spark, d):
    return raster.morph_open(dense(spark, d), "label", 5)


@query(f"WITH {DENSE}, {window_sql('e', 'dense', 'max', 3, 2)}, {window_sql('o', 'e', 'min', 3, 2)} SELECT raster_id, row, col, v AS label FROM o")
def _w2_morph_close(spark, d):
    return raster.morph_close(dense(spark, d), "label", 6)


WIDE = "n AS (SELECT raster_id, max(row) AS h FROM {wide} GROUP BY 1), dense AS (SELECT n.raster_id, CAST(a.r AS INT) AS row, CAST(b.c AS INT) AS col, label AS v FROM n CROSS JOIN range(0, 320) a(r) CROSS JOIN range(0, 320) b(c) LEFT JOIN {wide} p ON p.raster_id = n.raster_id AND p.row = a.r AND p.col = b.c WHERE a.r <= h)"


def wide(spark, d):
    rows = view(spark, d, "wide")
    meta = rows.groupBy("raster_id").agg((F.max("row") + 1).alias("n_rows")).withColumn("n_cols", F.lit(320))
    return raster.densify(rows, meta)


@query(f"WITH {WIDE}, {window_sql('e', 'dense', 'min', 15, 14)}, {window_sql('o', 'e', 'max', 15, 14)} SELECT raster_id, row, col, v AS label FROM o")
def _w1_morph_open_wide(spark, d):
    return raster.morph_open(wide(spark, d), "label")


@query(f"WITH {WIDE}, {window_sql('e', 'dense', 'max', 15, 14)}, {window_sql('o', 'e', 'min', 15, 14)} SELECT raster_id, row, col, v AS label FROM o")
def _w2_morph_close_wide(spark, d):
    return raster.morph_close(wide(spark, d), "label")


@query(f"WITH {BANK}, {MET} SELECT zone_id, acq_date, sensor FROM (SELECT zone_id, acq_date, sensor, row_number() OVER (PARTITION BY zone_id ORDER BY acq_date, sensor) AS k FROM (SELECT DISTINCT zone_id, acq_date, sensor FROM met WHERE acq_date IS NOT NULL)) WHERE k = 1")
def _w3_dem_thumb(spark, d):
    return catalog.dem_scenes(catalog.group_scenes(catalog.images_on_zones(bank(spark, d), polygons(spark, d)))).select("zone_id", "acq_date", "sensor")


@query(f"WITH {T} SELECT th_pz_name, min(th_path) AS th_path FROM thumbs WHERE contains(th_path, 'aerial') GROUP BY 1")
def _w5_first_thumb(spark, d):
    return catalog.first_thumb(thumbs(spark, d), ["aerial"]).select("th_pz_name", "th_path")


@query("SELECT pz_name, string_agg(DISTINCT concat(CAST(left_year AS STRING), '-', CAST(right_year AS STRING)), ',' ORDER BY concat(CAST(left_year AS STRING), '-', CAST(right_year AS STRING))) AS labels FROM {pair_meta} GROUP BY 1")
def _w6_legend(spark, d):
    rows = view(spark, d, "pair_meta").withColumnsRenamed({"left_year": "pa_left_year", "right_year": "pa_right_year"})
    return catalog.legend(rows, "pz_name").select("pz_name", F.array_join("labels", ",").alias("labels"))


# ---- lines and profiles -------------------------------------------------------------------

RIBS = """ribs AS (SELECT sp_id, sp_pz_name, concat(sp_id, '_', CAST(i AS STRING)) AS rib_id, i, mx - vy * 4.5 AS x1, my + vx * 4.5 AS y1, mx + vy * 4.5 AS x2, my - vx * 4.5 AS y2 FROM (
  SELECT sp_id, sp_pz_name, i, ax + (bx - ax) * (i * 5 / len) AS mx, ay + (by2 - ay) * (i * 5 / len) AS my, -(bx - ax) / len AS vx, -(by2 - ay) / len AS vy FROM (
    SELECT *, unnest(range(0, CAST(floor(len / 5) AS INT) + 1)) AS i FROM (SELECT *, sqrt((bx - ax) * (bx - ax) + (by2 - ay) * (by2 - ay)) AS len FROM {spines}))))"""


def spines(spark, d):
    point = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return view(spark, d, "spines").withColumn("line", F.array(point("ax", "ay"), point("bx", "by2"))).drop("ax", "ay", "bx", "by2")


@query(f"WITH {RIBS} SELECT sp_id, rib_id, i::BIGINT AS i, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM ribs")
def _g1_make_ribs(spark, d):
    rows = profiles.make_ribs(spines(spark, d))
    return r6(rows.select("sp_id", "rib_id", "i", F.col("line")[0]["x"].alias("x1"), F.col("line")[0]["y"].alias("y1"), F.col("line")[1]["x"].alias("x2"), F.col("line")[1]["y"].alias("y2")), "x1", "y1", "x2", "y2")


SLICES = """samples AS (SELECT rib_id, zone, k, CAST(floor((y - 64) / -2.0::DOUBLE) AS INT) AS row, CAST(floor(x / 2.0::DOUBLE) AS INT) AS col FROM (
  SELECT rib_id, sp_pz_name AS zone, k, x1 + (x2 - x1) * (k * 2 / len) AS x, y1 + (y2 - y1) * (k * 2 / len) AS y FROM (
    SELECT *, unnest(range(0, CAST(floor(len / 2) AS INT) + 1)) AS k FROM (SELECT *, sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)) AS len FROM ribs))))"""


def pairs_of_zones(spark, d):
    return view(spark, d, "pair_meta").select("raster_id", "left_year", "right_year", F.col("pz_name").alias("zone"))


@query("""WITH s AS (SELECT sp_id, sp_pz_name AS zone, k, CAST(floor((y - 64) / -2.0::DOUBLE) AS INT) AS row, CAST(floor(x / 2.0::DOUBLE) AS INT) AS col FROM (
    SELECT sp_id, sp_pz_name, k, ax + (bx - ax) * (k * 2 / len) AS x, ay + (by2 - ay) * (k * 2 / len) AS y FROM (SELECT *, unnest(range(0, CAST(floor(len / 2) AS INT) + 1)) AS k FROM (SELECT *, sqrt((bx - ax) * (bx - ax) + (by2 - ay) * (by2 - ay)) AS len FROM {spines}))))
  SELECT sp_id, m.raster_id, k::BIGINT AS pos, round(dx / nullif(abs(left_year - right_year), 0), 6) + 0.0 AS vx FROM s JOIN {pair_meta} m ON pz_name = zone LEFT JOIN {pix} p ON p.raster_id = m.raster_id AND p.row = s.row AND p.col = s.col""")
def _g2_slice_line(spark, d):
    lines = spines(spark, d).withColumn("zone", F.col("sp_pz_name"))
    return r6(profiles.slice_lines(lines, "sp_id", view(spark, d, "pix"), pairs_of_zones(spark, d), ("vx",), X0, Y0, PX, PY), "vx")


@query(f"WITH {RIBS}, {SLICES} SELECT rib_id, m.raster_id, k::BIGINT AS pos, round(sqrt(dx * dx + dy * dy) * 2, 6) AS m FROM samples s JOIN {{pair_meta}} m ON pz_name = zone LEFT JOIN {{pix}} p ON p.raster_id = m.raster_id AND p.row = s.row AND p.col = s.col")
def _g3_slice_ribs(spark, d):
    lines = profiles.make_ribs(spines(spark, d)).join(spines(spark, d).select("sp_id", F.col("sp_pz_name").alias("zone")), "sp_id").drop("i")
    return r6(profiles.slice_lines(lines, "rib_id", view(spark, d, "pix"), pairs_of_zones(spark, d), ("m",), X0, Y0, PX, PY), "m")


@query(f"""WITH {RIBS}, {SLICES}, v AS (SELECT rib_id, m.raster_id, k, dx, dy FROM samples s JOIN {{pair_meta}} m ON pz_name = zone LEFT JOIN {{pix}} p ON p.raster_id = m.raster_id AND p.row = s.row AND p.col = s.col)
  SELECT rib_id, raster_id, 'm' AS component, k::BIGINT AS pos, round(sqrt(dx * dx + dy * dy) * 2, 6) AS value FROM v UNION ALL SELECT rib_id, raster_id, 'x', k, round(dx, 6) + 0.0 FROM v UNION ALL SELECT rib_id, raster_id, 'y', k, round(dy, 6) + 0.0 FROM v""")
def _g4_spine_profiles(spark, d):
    return r6(profiles.spine_profiles(spines(spark, d), view(spark, d, "pix"), pairs_of_zones(spark, d), X0, Y0, PX, PY), "value")


@query("SELECT raster_id, row, col, (row_number() OVER (PARTITION BY raster_id, row ORDER BY col) - 1)::BIGINT AS pos FROM {pix}")
def _w4_profile_position(spark, d):
    return segment.profile_position(view(spark, d, "pix").select("raster_id", "row", "col"), ["raster_id", "row"], "col").withColumn("pos", F.col("pos").cast("long"))


@query("SELECT vec_id, (p // 8)::INT AS row, (p % 8)::INT AS col, round(embedding[p + 1]::DOUBLE, 6) + 0.0 AS value FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS p FROM {tiles})")
def _r1_tiles_to_pixels(spark, d):
    tiles = raster.to_tiles(raster.to_pixels(view(spark, d, "tiles"), "embedding", 8), ["vec_id"], 8)
    return r6(raster.to_pixels(tiles, "data", 8), "value")


# ---- connected areas ------------------------------------------------------------------------

#: Areas of every label: the smallest cell from which a cell can be reached.
CC = """WITH RECURSIVE lab AS (SELECT raster_id, row, col, label, row * 32 + col AS cell FROM {pix}),
  reach AS (SELECT raster_id, row, col, label, cell AS seed FROM lab UNION SELECT n.raster_id, n.row, n.col, n.label, r.seed FROM reach r JOIN (SELECT *, unnest([[0, 1], [1, 0], [0, -1], [-1, 0]]) AS o FROM lab) n
    ON n.raster_id = r.raster_id AND n.label = r.label AND n.row + o[1] = r.row AND n.col + o[2] = r.col WHERE r.seed < n.cell),
  comp AS (SELECT raster_id, row, col, label, min(seed) AS component FROM reach GROUP BY 1, 2, 3, 4)"""


def areas(spark, d):
    return segment.connected_areas(view(spark, d, "pix").select("raster_id", "row", "col", "label"), SIZE, tile=16)


@query(f"{CC} SELECT raster_id::BIGINT AS raster_id, row, col, label::BIGINT AS label, component::BIGINT AS component FROM comp")
def _g5_connected_areas(spark, d):
    return areas(spark, d)


STATS = f"{CC}, stats AS (SELECT raster_id::BIGINT AS raster_id, component::BIGINT AS component, min(label)::BIGINT AS raster_val, count(*)::BIGINT AS n, count(*) * 4.0::DOUBLE AS area, min(col) * 2.0::DOUBLE AS xmin, 64 - (max(row) + 1) * 2.0::DOUBLE AS ymin, (max(col) + 1) * 2.0::DOUBLE AS xmax, 64 - min(row) * 2.0::DOUBLE AS ymax FROM comp GROUP BY 1, 2)"


@query(f"{STATS} SELECT raster_id, component, raster_val, n, area, xmin, ymin, xmax, ymax FROM stats")
def _a12_area_stats(spark, d):
    return segment.area_stats(areas(spark, d), PX, PY, X0, Y0).select("raster_id", "component", "raster_val", "n", "area", "extent.*")


@query(f"{STATS} SELECT raster_id, component, area FROM stats WHERE area / 1000 > 0.05 AND raster_val = 1")
def _f9_min_surface_filter(spark, d):
    return segment.min_surface_filter(segment.area_stats(areas(spark, d), PX, PY), 0.05, 1).select("raster_id", "component", "area")


@query(f"{CC}, sides AS (SELECT c.raster_id, c.component, count(*) AS n FROM (SELECT *, unnest([[0, 1], [1, 0], [0, -1], [-1, 0]]) AS o FROM comp) c LEFT JOIN comp m ON m.raster_id = c.raster_id AND m.row = c.row + o[1] AND m.col = c.col + o[2] AND m.component = c.component WHERE m.row IS NULL GROUP BY 1, 2) SELECT raster_id::BIGINT AS raster_id, component::BIGINT AS component, (n * 2)::DOUBLE AS perimeter, a AS area FROM sides JOIN (SELECT raster_id, component, count(*) * 4.0::DOUBLE AS a FROM comp GROUP BY 1, 2) USING (raster_id, component)")
def _g5_polygonize(spark, d):
    rings = segment.polygonize(areas(spark, d), PX, PY, X0, Y0)
    sides = F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p, i: F.struct(p.alias("a"), F.get(r, F.pmod(i + 1, F.size(r))).alias("b")))))
    length = lambda s: F.abs(s["a"]["x"] - s["b"]["x"]) + F.abs(s["a"]["y"] - s["b"]["y"])
    cross = lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]
    total = lambda f: F.aggregate(sides, F.lit(0.0), lambda acc, s: acc + f(s))
    return r6(rings.select("raster_id", "component", total(length).alias("perimeter"), (total(cross) / 2).alias("area")), "perimeter", "area")


# ---- matching ---------------------------------------------------------------------------------


def match_sql(k: int, s: int, source: str = "{match_pairs}", ctes: str = "") -> str:
    """Correlation of all offsets from window sums along rows, then along columns."""
    off, lo, hi = f"range(-{s}, {s + 1})", k // 2, k - 1 - k // 2
    sums = lambda of, by, at: ", ".join(f"sum({c}) OVER w AS {c}" for c in ("n", "a", "b", "aa", "bb", "ab")) + f" FROM {of} WINDOW w AS (PARTITION BY pair_id, dy, dx, {by} ORDER BY {at} RANGE BETWEEN {lo} PRECEDING AND {hi} FOLLOWING)"

    def best(n: str, left: str, right: str) -> str:
        return f"""{n}o AS MATERIALIZED (SELECT l.pair_id, l.row, l.col, dy, dx, 1 AS n, l.v AS a, r.v AS b, l.v * l.v AS aa, r.v * r.v AS bb, l.v * r.v AS ab FROM {left} l CROSS JOIN {off} y(dy) CROSS JOIN {off} x(dx) JOIN {right} r ON r.pair_id = l.pair_id AND r.row = l.row + dy AND r.col = l.col + dx),
        {n}r AS MATERIALIZED (SELECT pair_id, row, col, dy, dx, {sums(n + "o", "row", "col")}), {n}c AS MATERIALIZED (SELECT pair_id, row, col, dy, dx, {sums(n + "r", "col", "row")}),
        {n}s AS (SELECT pair_id, row, col, dy, dx, (n * ab - a * b) / sqrt((n * aa - a * a) * (n * bb - b * b)) AS s FROM {n}c WHERE n = {k * k} AND n * aa - a * a > 1e-9 * n * n AND n * bb - b * b > 1e-9 * n * n),
        {n} AS MATERIALIZED (SELECT pair_id, row, col, dy, dx FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, row, col ORDER BY round(s, 7) DESC, dy * dy + dx * dx, dy, dx) AS rk FROM {n}s) WHERE rk = 1)"""

    return f"""WITH {ctes}lf AS MATERIALIZED (SELECT pair_id, row, col, lv AS v FROM {source}), rt AS MATERIALIZED (SELECT pair_id, row, col, rv AS v FROM {source}), {best("fwd", "lf", "rt")}, {best("bwd", "rt", "lf")}
    SELECT m.pair_id::BIGINT AS pair_id, m.row, m.col, CASE WHEN ok THEN f.dx::DOUBLE + 0.0 END AS dx, CASE WHEN ok THEN f.dy::DOUBLE + 0.0 END AS dy, CASE WHEN ok THEN 1 ELSE 0 END AS good
    FROM {source} m LEFT JOIN fwd f ON f.pair_id = m.pair_id AND f.row = m.row AND f.col = m.col LEFT JOIN bwd b ON b.pair_id = m.pair_id AND b.row = m.row + f.dy AND b.col = m.col + f.dx
    CROSS JOIN LATERAL (SELECT coalesce(abs(f.dx + b.dx) <= 10 AND abs(f.dy + b.dy) <= 10, false) AS ok)"""


def matched(spark, d):
    return view(spark, d, "match_pairs").withColumnsRenamed({"lv": "left", "rv": "right"})


@query()
def _g6_match_pyramid(spark, d):
    """Held against a plain pyramid in the tests: its SQL would be three searches within each other."""
    return r6(matching.match_pyramid(matched(spark, d), search=4, levels=2), "dx", "dy")


@query(match_sql(7, 10))
def _g6_match_blocks(spark, d):
    return r6(matching.match_blocks(matched(spark, d)), "dx", "dy")


G7 = """WITH ev AS MATERIALIZED (SELECT a.raster_id AS pair_id, a.row, a.col, a.dx AS lv, b.dy + b.dx / 2 AS rv FROM {pix} a JOIN {pix} b ON b.raster_id = a.raster_id AND b.row = a.row + 1 AND b.col = a.col),
  o AS MATERIALIZED (SELECT pair_id, row, col, row + y AS lr, col + x AS lc FROM ev CROSS JOIN range(-2, 3) a(y) CROSS JOIN range(-2, 3) b(x)),
  l AS MATERIALIZED (SELECT o.*, ev.lv FROM o JOIN ev ON ev.pair_id = o.pair_id AND ev.row = lr AND ev.col = lc),
  s AS (SELECT l.pair_id, l.row, l.col, count(*) AS n, corr(l.lv, ev.rv) AS cc FROM l JOIN ev ON ev.pair_id = l.pair_id AND ev.row = lr - 1 AND ev.col = lc GROUP BY ALL)
  SELECT ev.pair_id::BIGINT AS pair_id, ev.row, ev.col, CASE WHEN n = 25 AND NOT isnan(cc) THEN round(cc, 6) + 0.0 END AS cc FROM ev LEFT JOIN s USING (pair_id, row, col)"""


def eval_pairs(spark, d):
    pix = view(spark, d, "pix")
    right = pix.select("raster_id", (F.col("row") - 1).alias("row"), "col", (F.col("dy") + F.col("dx") / 2).alias("right"))
    rows = pix.select("raster_id", "row", "col", F.col("dx").alias("left")).join(right, ["raster_id", "row", "col"]).withColumn("pair_id", F.col("raster_id").cast("long")).drop("raster_id")
    return rows, rows.select("pair_id", "row", "col", F.lit(0.2).alias("dx"), F.lit(-1.0).alias("dy"))


@query(G7)
def _g7_corr_eval(spark, d):
    return r6(matching.corr_eval(*eval_pairs(spark, d), kernel=5), "cc")


@query(G7)
def _g7_corr_eval_tiles(spark, d):
    return r6(matching.corr_eval_tiles(*eval_pairs(spark, d), kernel=5, reach=2, tile=16), "cc")


#: Weights of the filter, the same on both sides.
LOG = ", ".join(f"({y - 4}, {x - 4}, {w!r}::DOUBLE)" for (y, x), w in np.ndenumerate(matching.log_kernel(1.25).astype(float)) for w in [float(w)])


@query(f"""WITH raw AS MATERIALIZED (SELECT a.raster_id AS pair_id, a.row, a.col, a.dx AS lv, b.dy + b.dx / 2 AS rv FROM {{pix}} a JOIN {{pix}} b ON b.raster_id = a.raster_id AND b.row = a.row + 1 AND b.col = a.col),
  k(y, x, w) AS (VALUES {LOG}),
  ev AS MATERIALIZED (SELECT pair_id, row, col, CASE WHEN n = 81 THEN lv END AS lv, CASE WHEN n = 81 THEN rv END AS rv FROM (SELECT t.pair_id, t.row, t.col, count(*) AS n, sum(w * r.lv) AS lv, sum(w * r.rv) AS rv FROM (SELECT pair_id, row, col, y, x, w, row + y AS ry, col + x AS rx FROM raw CROSS JOIN k) t JOIN raw r ON r.pair_id = t.pair_id AND r.row = t.ry AND r.col = t.rx GROUP BY 1, 2, 3)),
  o AS MATERIALIZED (SELECT pair_id, row, col, row + y AS lr, col + x AS lc FROM ev CROSS JOIN range(-2, 3) a(y) CROSS JOIN range(-2, 3) b(x)),
  l AS MATERIALIZED (SELECT o.*, ev.lv FROM o JOIN ev ON ev.pair_id = o.pair_id AND ev.row = lr AND ev.col = lc WHERE ev.lv IS NOT NULL),
  s AS (SELECT l.pair_id, l.row, l.col, count(*) AS n, corr(l.lv, ev.rv) AS cc FROM l JOIN ev ON ev.pair_id = l.pair_id AND ev.row = lr - 1 AND ev.col = lc WHERE ev.rv IS NOT NULL GROUP BY ALL)
  SELECT ev.pair_id::BIGINT AS pair_id, ev.row, ev.col, CASE WHEN n = 25 AND NOT isnan(cc) THEN round(cc, 6) + 0.0 END AS cc FROM ev LEFT JOIN s USING (pair_id, row, col)""")
def _g7_corr_eval_prefilter(spark, d):
    return r6(matching.corr_eval_tiles(*eval_pairs(spark, d), kernel=5, reach=2, prefilter=1.25), "cc")


# ---- flows ------------------------------------------------------------------------------------


@query(OVERVIEW)
def _wl1_zone_velocities(spark, d):
    return r6(flows.zone_velocities(view(spark, d, "pix"), view(spark, d, "pair_meta"), polygons(spark, d), PX), "D", "V")


@query(f"""WITH {BANK}, {MET}, sc AS (SELECT zone_id, acq_date, sensor, string_agg(filepath, ',' ORDER BY filepath) AS files FROM met WHERE acq_date IS NOT NULL GROUP BY 1, 2, 3)
  SELECT concat('/thumbs/', CAST(zone_id AS STRING), '/opticals/', CAST(zone_id AS STRING), '_', acq_date, '_', sensor, '.tif') AS th_path, files FROM sc WHERE zone_id % 3 <> 0""")
def _d1_sieve(spark, d):
    images, zone = bank(spark, d), polygons(spark, d)
    done = flows.sieve(images, zone.filter("zone_id % 3 = 0"), spark.createDataFrame([], "th_path string"))
    return flows.sieve(images, zone, done).select("th_path", F.array_join("files", ",").alias("files"))


CUT = f"""WITH {BANK}, {MET}, sc AS (SELECT zone_id, filepath, concat('/thumbs/', CAST(zone_id AS STRING), '/opticals/', CAST(zone_id AS STRING), '_', acq_date, '_', sensor, '.tif') AS th_path FROM met WHERE acq_date IS NOT NULL),
  f AS (SELECT th_path, h.*, a, b, c, d FROM sc JOIN zb USING (zone_id) JOIN {{bank_headers}} h USING (filepath)),
  g AS (SELECT *, a + j + 0.5::DOUBLE AS x, d - i - 0.5::DOUBLE AS y FROM (SELECT *, unnest(range(0, CAST(ceil((c - a) - 0.5) AS INT))) AS j FROM (SELECT *, unnest(range(0, CAST(ceil((d - b) - 0.5) AS INT))) AS i FROM f)))"""
VALUE = "length(filepath) + r * 0.25::DOUBLE + k * 0.125::DOUBLE + (length(filepath) % 7) * 0.5::DOUBLE"


def cut(spark, d, how: str) -> DataFrame:
    """Scenes of files of 0.5 m and 1 m, each on a grid of its own, at 1 m."""
    headers, steps = view(spark, d, "bank_headers"), lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cells = headers.select("filepath", "n_cols", steps("n_rows").alias("row")).select("filepath", "row", steps("n_cols").alias("col"))
    size = F.length("filepath")
    pixels = cells.withColumn("value", size + F.col("row") * 0.25 + F.col("col") * 0.125 + (size % 7) * 0.5)
    zone = polygons(spark, d)
    scenes = flows.sieve(bank(spark, d), zone, spark.createDataFrame([], "th_path string"))
    return r6(flows.cut_scenes(scenes, pixels, headers, zone, 1.0, how), "value")


@query(f"""{CUT}, v AS (SELECT *, CAST(floor((y0 - y) / abs(py)) AS INT) AS r, CAST(floor((x - x0) / px) AS INT) AS k FROM g)
  SELECT th_path, i::INT AS row, j::INT AS col, round(arg_min({VALUE}, filepath), 6) + 0.0 AS value FROM v WHERE r BETWEEN 0 AND n_rows - 1 AND k BETWEEN 0 AND n_cols - 1 GROUP BY 1, 2, 3""")
def _d1_cut_scenes(spark, d):
    return cut(spark, d, "nearest")


@query(f"""{CUT}, src AS (SELECT *, unnest(range(0, n_cols)) AS k FROM (SELECT *, unnest(range(0, n_rows)) AS r FROM f)),
  fine AS (SELECT th_path, filepath, CAST(floor(d - y0 + (r + 0.5) * abs(py)) AS INT) AS i, CAST(floor(x0 + (k + 0.5) * px - a) AS INT) AS j, avg({VALUE}) AS value, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, any_value(d) AS d FROM src WHERE px < 1 GROUP BY 1, 2, 3, 4),
  v AS (SELECT *, CAST(floor((y0 - y) / abs(py)) AS INT) AS r, CAST(floor((x - x0) / px) AS INT) AS k FROM g WHERE px >= 1),
  laid AS (SELECT th_path, filepath, i, j, value FROM fine WHERE i >= 0 AND j >= 0 AND i < ceil((d - b) - 0.5) AND j < ceil((c - a) - 0.5) UNION ALL SELECT th_path, filepath, i, j, {VALUE} FROM v WHERE r BETWEEN 0 AND n_rows - 1 AND k BETWEEN 0 AND n_cols - 1)
  SELECT th_path, i::INT AS row, j::INT AS col, round(arg_min(value, filepath), 6) + 0.0 AS value FROM laid GROUP BY 1, 2, 3""")
def _d1_cut_scenes_average(spark, d):
    return cut(spark, d, "average")


CLIP = """pr AS (SELECT raster_id AS pair_id, raster_id AS left_id, raster_id + 1 AS right_id FROM {pair_meta}),
  pl AS (SELECT raster_id, row + raster_id % 3 AS row, col + raster_id % 2 AS col, dx FROM {pix}),
  clip AS MATERIALIZED (SELECT pair_id, l.row, l.col, l.dx AS lv, r.dx AS rv FROM pr JOIN pl l ON l.raster_id = left_id JOIN pl r ON r.raster_id = right_id AND r.row = l.row AND r.col = l.col), """
FIELD = match_sql(7, 10, "clip", CLIP)
D2 = f"""{FIELD[: FIELD.rindex("SELECT m.pair_id")].rstrip()}, disp AS MATERIALIZED ({FIELD[FIELD.rindex("SELECT m.pair_id") :]}),
  o AS MATERIALIZED (SELECT pair_id, row, col, row + y AS lr, col + x AS lc, row + y + dy::INT AS rr, col + x + dx::INT AS rc FROM disp CROSS JOIN range(-3, 4) a(y) CROSS JOIN range(-3, 4) b(x) WHERE dx IS NOT NULL),
  ol AS MATERIALIZED (SELECT o.*, lv FROM o JOIN clip c ON c.pair_id = o.pair_id AND c.row = lr AND c.col = lc),
  cc AS (SELECT o.pair_id, o.row, o.col, count(*) AS n, corr(o.lv, c.rv) AS s FROM ol o JOIN clip c ON c.pair_id = o.pair_id AND c.row = rr AND c.col = rc GROUP BY ALL),
  cells AS (SELECT pair_id, CAST(floor(row * 2 / 20.0) AS INT) AS row, CAST(floor(col * 2 / 20.0) AS INT) AS col, avg(dx) AS dx, avg(dy) AS dy, avg(CASE WHEN n = 49 AND NOT isnan(s) THEN s END) AS cc FROM disp LEFT JOIN cc USING (pair_id, row, col) GROUP BY 1, 2, 3)"""


def project_pairs(spark, d):
    meta = view(spark, d, "pair_meta")
    pairs = meta.select(F.col("raster_id").cast("long").alias("pair_id"), F.col("raster_id").alias("left_id"), (F.col("raster_id") + 1).alias("right_id"), "pz_name", "left_year", "right_year")
    origin = meta.select("raster_id", (F.col("raster_id") % 3).alias("row0"), (F.col("raster_id") % 2).alias("col0"))
    return flows.process_project(view(spark, d, "pix"), "dx", pairs, PX, PY, origin)


@query(f"""{D2}, m AS (SELECT c.*, dx * 2 * s AS mx, dy * -2 * s AS my, nullif(abs(left_year - right_year), 0) AS n FROM cells c JOIN (SELECT raster_id, left_year, right_year, CASE WHEN left_year > right_year THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM {{pair_meta}}) ON raster_id = pair_id WHERE dx IS NOT NULL AND dy IS NOT NULL)
  SELECT pair_id, row, col, round(cc, 6) + 0.0 AS cc, round(dx, 6) + 0.0 AS dx_in_pixels, round(dy, 6) + 0.0 AS dy_in_pixels, round(mx, 6) + 0.0 AS dx_in_meters, round(my, 6) + 0.0 AS dy_in_meters, round(sqrt(mx * mx + my * my), 6) AS d_in_meters,
  round(mx / n, 6) + 0.0 AS dx_in_meters_per_year, round(my / n, 6) + 0.0 AS dy_in_meters_per_year, round(sqrt(mx * mx + my * my) / n, 6) AS d_in_meters_per_year, round(degrees(atan2(dy + 0.0, dx + 0.0)), 6) AS direction FROM m""")
def _d2_process_pairs(spark, d):
    vectors = project_pairs(spark, d)[0]
    # averages may be zeros of either sign
    angle = F.degrees(F.atan2(F.col("dy_in_pixels") + F.lit(0.0), F.col("dx_in_pixels") + F.lit(0.0)))
    return r6(vectors.withColumn("direction", angle), *[c for c in vectors.columns if c not in ("pair_id", "row", "col")])


@query(f"""{D2}, outcome AS (SELECT pz_name, CAST(raster_id AS BIGINT) AS k, coalesce(g, 0) AS g FROM {{pair_meta}} LEFT JOIN (SELECT pair_id, max(good) AS g FROM disp GROUP BY 1) ON pair_id = raster_id)
  SELECT pz_name, coalesce(string_agg(CAST(k AS STRING), ',' ORDER BY k) FILTER (g = 1), '') AS complete, coalesce(string_agg(CAST(k AS STRING), ',' ORDER BY k) FILTER (g = 0), '') AS abort FROM outcome GROUP BY 1""")
def _d2_log(spark, d):
    log = project_pairs(spark, d)[1]
    return log.select("pz_name", F.array_join(F.col("complete").cast("array<string>"), ",").alias("complete"), F.array_join(F.col("abort").cast("array<string>"), ",").alias("abort"))


D3 = f"""WITH RECURSIVE done AS (SELECT p.*, pz_name AS zone FROM {{pix}} p JOIN {{pair_meta}} USING (raster_id) WHERE pa_status = 'complete'), {kmeans_sql('done', 'raster_id', 'dx', name='p')},
  lab AS (SELECT zone, row, col, CASE WHEN abs(dx - a) <= abs(dx - b) THEN 0 ELSE 1 END AS label FROM done JOIN p20 ON g = raster_id),
  want AS (SELECT pz_name AS zone, count(*) AS n FROM {{pair_meta}} WHERE pa_status = 'complete' GROUP BY 1),
  good AS MATERIALIZED (SELECT zone, row, col, total FROM (SELECT zone, row, col, sum(label) AS total, count(*) AS n FROM lab GROUP BY 1, 2, 3) JOIN want USING (zone, n)), {kmeans_sql('good', 'zone', 'total', name='z')},
  two AS MATERIALIZED (SELECT zone AS raster_id, row, col, CASE WHEN abs(total - a) <= abs(total - b) THEN 0 ELSE 1 END AS label FROM good JOIN z20 ON g = zone),
  dense AS (SELECT r.raster_id, CAST(i.r AS INT) AS row, CAST(j.c AS INT) AS col, label AS v FROM (SELECT DISTINCT raster_id FROM two) r CROSS JOIN range(0, 32) i(r) CROSS JOIN range(0, 32) j(c) LEFT JOIN two t ON t.raster_id = r.raster_id AND t.row = i.r AND t.col = j.c),
  {window_sql('e', 'dense', 'max', 15, 14)}, {window_sql('o', 'e', 'min', 15, 14)},
  one AS MATERIALIZED (SELECT o.raster_id, o.row, o.col, o.row * 32 + o.col AS cell FROM o JOIN two t USING (raster_id, row, col) WHERE v = 1),
  reach AS (SELECT raster_id, row, col, cell AS seed FROM one UNION SELECT n.raster_id, n.row, n.col, r.seed FROM reach r JOIN (SELECT *, unnest([[0, 1], [1, 0], [0, -1], [-1, 0]]) AS o FROM one) n
    ON n.raster_id = r.raster_id AND n.row + o[1] = r.row AND n.col + o[2] = r.col WHERE r.seed < n.cell)
  SELECT raster_id AS zone, component::BIGINT AS component, 1::BIGINT AS raster_val, count(*)::BIGINT AS n, count(*) * 4.0::DOUBLE AS area FROM (SELECT raster_id, row, col, min(seed) AS component FROM reach GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query(D3)
def _d3_moving_areas(spark, d):
    return flows.moving_areas(view(spark, d, "pix"), view(spark, d, "pair_meta"), "dx", SIZE, SIZE, PX, PY).select("zone", "component", "raster_val", "n", "area")

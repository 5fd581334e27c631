"""Cases that the given tables don't hold: nulls, ties, reversed and same-year pairs, malformed names."""

import math

import pytest
from pyspark.sql import functions as F

from motionfield.functions import displacement as D
from motionfield.functions import naming
from motionfield.operators import catalog, raster, zones
from motionfield.plans import flows
from motionfield.sources import layers


def test_thumb_names(spark):
    names = ["/b/pz1/opticals/pz1_2018-07-04_spot6.tif", "/b/pz_1_2018-07-04_spot6.tif", "/b/pz1_2018-07-04_spot6.jpg", "/b/pz1_2018-7-4_spot6.tif", "/b/pz-A_2018-07-04_a.b.TIF", "/b/é_2018-07-04_a.tif", None]
    got = [r.t for r in spark.createDataFrame([(n,) for n in names], "p string").select(naming.thumb_parts(F.col("p")).alias("t")).collect()]
    assert (got[0].pz_name, got[0].date, got[0].sensor, got[0].year) == ("pz1", "2018-07-04", "spot6", 2018)
    assert got[4].key == "pz-A_2018-07-04_a" and [g is None for g in got] == [False, True, True, True, False, True, True]


def test_pair_paths_round_trip(spark):
    df = spark.createDataFrame([("/p/x/displacements/pz1_2018-07-04-spot6_2019-01-01-aerial",), ("/p/x/DISPLACEMENTS/pz1_2018-07-04-s_2019-01-01-a",), ("/p/other/pz1_2018-07-04-s_2019-01-01-a",), ("pz1",), ("/displacements/pz1_2018-07-04_2019-01-01-a",)], "p string")
    got = [r.t for r in df.select(naming.parse_pair(F.col("p")).alias("t")).collect()]
    assert (got[0].left_key, got[0].right_sensor) == ("pz1_2018-07-04_spot6", "aerial")
    assert [g is None for g in got] == [False, False, True, True, True]


def test_dates(spark):
    rows = [("/b/aerial/img-20180704.tif", None), ("/b/SPOT7/a.tif", "<IMAGING_DATE>2019-02-03</IMAGING_DATE>"), ("/b/spot6/a.tif", None), ("/b/x/swissimage_2015_1.tif", None), ("/b/y/u.tif", None), ("/b/AERIAL/plain.tif", None)]
    got = [r.a for r in spark.createDataFrame(rows, "p string, x string").select(naming.acquisition(F.col("p"), F.col("x")).alias("a")).collect()]
    # an extension that is part of the date stays in it
    assert [(g.sensor, g.acq_date, g.listed) for g in got] == [("aerial", "2018-07-04.tif", True), ("SPOT7", "2019-02-03", True), ("spot6", None, False), ("aerial", "2015-01-01", True), ("unknown", None, True), ("AERIAL", None, True)]


def test_vectors_in_and_against_time(spark):
    df = spark.createDataFrame([(1.0, 2.0, 2018, 2010), (1.0, 2.0, 2010, 2018), (1.0, 2.0, 2010, 2010), (None, 1.0, 2010, 2012), (-1.0, -0.0, 2010, 2012)], "dx double, dy double, l int, r int")
    cols = D.vector_attributes(F.col("dx"), F.col("dy"), F.lit(2.0), F.lit(-2.0), F.col("l"), F.col("r"))
    a, b, c, d, e = df.select(*[v.alias(k) for k, v in cols.items()]).collect()
    assert (a.dx_in_meters, a.dy_in_meters, a.dx_in_pixels, a.d_in_meters_per_year) == (-2.0, 4.0, 1.0, math.sqrt(20) / 8)
    assert (b.dx_in_meters, b.dy_in_meters, b.dx_in_meters_per_year) == (2.0, -4.0, 0.25)
    assert c.dx_in_meters_per_year is None and c.d_in_meters == math.sqrt(20)
    assert d.d_in_meters is None and e.direction == 180.0


def test_filters_of_values(spark):
    df = spark.createDataFrame([(-10.0, 0.5), (10.0, 0.9), (0.0, float("nan")), (1.0, None), (2.0, 0.49), (3.0, 0.5)], "v double, cc double")
    got = df.select(D.outlier_filter(F.col("v")).alias("o"), D.cc_filter(F.col("v"), F.col("cc")).alias("c")).collect()
    assert [r.o for r in got] == [None, None, 0.0, 1.0, 2.0, 3.0]
    assert [r.c for r in got] == [-10.0, 10.0, None, None, None, 3.0]
    with pytest.raises(ValueError):
        D.component("q", F.col("v"), F.col("v"), F.lit(1), F.lit(1), F.lit(2))


def test_pairs_are_ordered_and_of_one_zone(spark):
    rows = [(z, f"/b/{z}/opticals/{z}_{2000 + k}-01-01_s.tif", "s", f"{2000 + k}-01-01", 2000 + k, str(k % 2)) for z, n in (("pz1", 4), ("pz10", 3), ("pz2", 1)) for k in range(n)]
    thumbs = spark.createDataFrame(rows, "th_pz_name string, th_path string, th_sensor string, th_date string, th_year int, th_valid string")
    pairs = catalog.make_pairs(thumbs)
    assert {r[0]: r[1] for r in pairs.groupBy("pa_pz_name").count().collect()} == {"pz1": 12, "pz10": 6}
    assert catalog.make_valid_pairs(thumbs).count() == 2
    assert catalog.make_pairs(thumbs.limit(0)).count() == 0


def test_thumbs_of_one_path_are_one(spark):
    rows = [("/x/opticals/a_2000-01-01_s.tif", "0"), ("/x/opticals/a_2000-01-01_s.tif", "1"), ("/x/opticals/a_2000-01-01_s.TIF", "0"), ("/x/a_2000-01-01_s.tif", "1")]
    listed = spark.createDataFrame(rows, "th_path string, th_valid string")
    stored = spark.createDataFrame([("/x/opticals/gone_2000-01-01_s.tif", "1")], "th_path string, th_valid string")
    assert [tuple(r) for r in catalog.refresh_thumbs(stored, listed).collect()] == [("/x/opticals/a_2000-01-01_s.tif", "1")]


def test_searches(spark):
    thumbs = spark.createDataFrame([("/b/pz1_2018_SPOT6",), ("/b/pz10_2014_x",), (None,)], "th_path string")
    assert catalog.search_thumbs(thumbs, ["spot", 2018]).count() == 1
    assert catalog.search_thumbs(thumbs, "pz1").count() == 2
    assert catalog.search_thumbs(thumbs, "").count() == 2
    zones_ = spark.createDataFrame([("Lou",), ("lou",)], "pz_name string")
    assert [r[0] for r in catalog.search_pzones(zones_, "LOU").collect()] == ["lou"]
    with pytest.raises(ValueError):
        catalog.pairs_on_period(thumbs, 1, 2, "before")


def test_centring(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, None), (2, 1.0), (2, 2.0), (3, None)], "raster_id int, v double")
    got = lambda how: sorted((r.raster_id, r.v) if r.v is not None else (r.raster_id, None) for r in raster.center_disp(df, "v", how).collect() if r.v is not None)
    assert got("median") == [(1, -1.0), (1, 1.0), (2, -0.5), (2, 0.5)]
    assert got("mean") == [(2, -0.5), (2, 0.5)]


def test_nearest_resampling_shrinks_and_grows(spark):
    df = spark.createDataFrame([(0, r, c, float(10 * r + c)) for r in range(4) for c in range(4)], "raster_id int, row int, col int, v double")
    small = {(r.row, r.col): r.v for r in raster.resample_nearest(df, ["v"], 2.0, -2.0, 4.0).collect()}
    assert small == {(0, 0): 11.0, (0, 1): 13.0, (1, 0): 31.0, (1, 1): 33.0}
    assert raster.resample_nearest(df, ["v"], 2.0, -2.0, 1.0).count() == 64


def test_mosaic_takes_the_first_file_with_a_value(spark):
    df = spark.createDataFrame([(0, 0, "b", 2.0), (0, 0, "a", None), (0, 1, "a", None), (0, 2, "b", 5.0), (0, 2, "a", 4.0)], "row int, col int, filepath string, value double")
    assert {(r.row, r.col): r.value for r in raster.mosaic(df, ["row", "col"]).collect()} == {(0, 0): 2.0, (0, 1): None, (0, 2): 4.0}


def test_boxes_and_polygons(spark):
    from motionfield.functions import geometry as G

    ring = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    boxes = [(1, 1, 2, 2), (-5, -5, 20, 20), (10, 10, 12, 12), (11, 0, 12, 5), (-1, 4, 11, 5), (-2, -2, -1, 3)]
    df = spark.createDataFrame([(list(map(float, b)), [{"x": x, "y": y} for x, y in ring]) for b in boxes], "b array<double>, ring array<struct<x: double, y: double>>")
    got = df.withColumn("e", G.ring_edges(F.col("ring"))).select(G.box_meets_polygon(*[F.col("b")[k] for k in range(4)], F.col("e")).alias("m")).collect()
    assert [r.m for r in got] == [True, True, True, False, True, False]


def test_points_off_the_raster(spark):
    points = spark.createDataFrame([(1, -0.5, 1.0), (2, 0.5, -0.5), (3, 99.0, 0.0)], "point_id int, x double, y double")
    pixels = spark.createDataFrame([(0, 0, 7.0)], "row int, col int, v double")
    assert {r.point_id: r.a for r in zones.sample_points(points, pixels.withColumn("raster_id", F.lit(0)), "v", "a.b.tif", 0.0, 0.0, 1.0, -1.0).collect()} == {1: None, 2: 7.0, 3: None}


def test_layers(spark, tmp_path):
    root = str(tmp_path)
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 1.0}]
    rows = spark.createDataFrame([("a", ring, 2154), ("b", ring, 2154)], "pz_name string, ring array<struct<x: double, y: double>>, epsg int")
    layers.write_layer(rows, root, "pzones")
    assert layers.read_layers(spark, root, 2154, ("pzones",))["pzones"].count() == 2
    with pytest.raises(ValueError):
        layers.read_layers(spark, root, 21781, ("pzones",))
    layers.write_layer(rows.limit(1), root, "pzones")
    assert layers.read_layer(spark, root, "pzones").count() == 1
    assert layers.read_bank_map(spark, root) is None
    assert layers.list_files(spark, f"{root}/pzones").filter(F.col("filepath").endswith(".parquet")).count() >= 1
    files = spark.createDataFrame([("/a/x.tif",), ("/a/x.TIF",), ("/a/x.Tif",), ("/a/x.JP2",), ("/a/tif",)], "filepath string")
    assert layers.list_bank(files).count() == 3


def test_joins_by_place_in_any_unit(spark):
    """Images of 60 km and zones of 40 m to 90 km in metres: at most four cells of a level for each, and the same pairs as by all pairs."""
    import random

    from motionfield.functions import geometry as G

    rng = random.Random(2)
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    images = [(f"i{k}", x, y, x + s, y + s) for k in range(12) for s in [rng.choice([60_000.0, 900.0, 15.0])] for x, y in [(rng.uniform(6e5, 7e5), rng.uniform(4.9e6, 5e6))]]
    zone = [(k, rng.uniform(6e5, 7e5), rng.uniform(4.9e6, 5e6), s, s / 2) for k in range(15) for s in [rng.choice([40.0, 3_000.0, 90_000.0])]]
    edges = lambda ring: [{"x1": a[0], "y1": a[1], "x2": b[0], "y2": b[1]} for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    zs = spark.createDataFrame([(k, edges(box(*z))) for k, *z in zone], "zone_id int, edges array<struct<x1: double, y1: double, x2: double, y2: double>>")
    ims = spark.createDataFrame([(n, dict(zip(("xmin", "ymin", "xmax", "ymax"), b, strict=True))) for n, *b in images], "filepath string, extent struct<xmin: double, ymin: double, xmax: double, ymax: double>")
    want = {(n, k) for n, x1, y1, x2, y2 in images for k, x, y, w, h in zone if x1 <= x + w and x2 >= x and y1 <= y + h and y2 >= y}
    got = [(r.filepath, r.zone_id) for r in catalog.images_on_zones(ims, zs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    points = [(k, rng.uniform(6e5, 8e5), rng.uniform(4.9e6, 5.1e6)) for k in range(300)]
    hits = {(r.k, r.zone_id) for r in zones.zonal_join(spark.createDataFrame(points, "k int, x double, y double"), zs).collect()}
    assert hits == {(p, k) for p, px, py in points for k, x, y, w, h in zone if x < px < x + w and y < py < y + h} and hits
    cells = ims.withColumn("s", F.pow(F.lit(2.0), G.level(F.col("extent"))))
    assert cells.select(F.max(F.size(G.cell_range(F.col("extent.xmin"), F.col("extent.xmax"), F.col("s"))))).first()[0] <= 2


def test_layer_versions(spark, tmp_path):
    """A reader keeps its snapshot through writes that fail or succeed, and replaced versions go after a time."""
    import threading

    root = str(tmp_path)
    table = lambda n: spark.range(n).select(F.col("id").alias("k"))
    with pytest.raises(FileNotFoundError):
        layers.read_layer(spark, root, "t")
    layers.write_layer(table(5), root, "t")
    old = layers.read_layer(spark, root, "t")
    with pytest.raises(Exception, match="no such number"):
        layers.write_layer(table(9).withColumn("k", F.when(F.col("k") == 8, F.raise_error(F.lit("no such number")).cast("long")).otherwise(F.col("k"))), root, "t")
    assert layers.read_layer(spark, root, "t").count() == 5
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append(layers.read_layer(spark, root, "t").count())

    reader = threading.Thread(target=read)
    reader.start()
    for n in (6, 7, 8):
        layers.write_layer(table(n), root, "t")
    stop.set()
    reader.join()
    assert seen and seen == sorted(seen) and set(seen) <= {5, 6, 7, 8}
    assert old.count() == 5 and layers.read_layer(spark, root, "t").count() == 8
    assert layers.clean_layer(spark, root, "t", 3600) == 0 and layers.clean_layer(spark, root, "t", -1) == 3
    assert len(layers.manifests(spark, root, "t")) == 1 and layers.read_layer(spark, root, "t").count() == 8


def test_files_follow_bytes_and_pairs(spark, tmp_path):
    """2,000 pairs of two zones are few files, and a pair's rows lie in one or two of them."""
    rows = spark.range(0, 40_000, 1, 8).select(F.concat(F.lit("k"), F.col("id") % 2000).alias("pa_key"), (F.col("id") / 2000).cast("int").alias("row"), F.lit(0).alias("col"), F.concat(F.lit("pz"), F.col("id") % 2).alias("pa_pz_name"))
    path = layers.write_vectors(rows, str(tmp_path), 20)
    assert len(spark.read.parquet(path).inputFiles()) <= 16
    one = spark.read.parquet(path).filter("pa_key = 'k77'").select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(one) <= 2 and sum(r[1] for r in one) == 20


@pytest.mark.parametrize("stored", [False, True])
def test_sampling_from_tiles(spark, tmp_path, stored):
    """Many points and rasters, nulls, gaps and cells on both sides of tile borders, from pixels or from stored tiles."""
    import random

    rng = random.Random(1)
    cells = {(k, r, c): rng.choice([None, rng.random()]) for k in range(5) for r in range(-3, 70) for c in (*range(60, 68), 130) if rng.random() < 0.7}
    pixels = spark.createDataFrame([(*at, v) for at, v in cells.items()], "raster_id int, row int, col int, v double")
    if stored:
        raster.tile_rasters(pixels, ["v"]).write.parquet(f"{tmp_path}/tiles")
        pixels = spark.read.parquet(f"{tmp_path}/tiles")
    points = [(k, rng.uniform(55, 135), -rng.uniform(-5, 75)) for k in range(400)] + [(7, 61.5, -3.5)] * 2
    df = spark.createDataFrame(points, "point_id int, x double, y double")
    got = sorted((r.point_id, r.raster_id if r.raster_id is not None else -1, r.s or 0) for r in zones.sample_points(df, pixels, "v", "s.tif", 0.0, 0.0, 1.0, -1.0).collect())
    want = []
    for i, x, y in points:
        hit = [(i, k, cells[k, math.floor(-y), math.floor(x)] or 0) for k in range(5) if (k, math.floor(-y), math.floor(x)) in cells]
        want += hit or [(i, -1, 0)]
    assert got == sorted(want) and sum(w[1] >= 0 for w in want) > 100
    means = {(r.point_id, r.raster_id): r["mean"] for r in zones.sample_points_buffer(df.filter("point_id < 50").distinct(), pixels, "v", 2.0, 0.0, 0.0, 1.0, -1.0).filter("mean is not null").collect()}
    near = {}
    for i, x, y in {p for p in points if p[0] < 50}:
        for (k, r, c), v in cells.items():
            if v is not None and (c + 0.5 - x) ** 2 + (-(r + 0.5) - y) ** 2 <= 4:
                near.setdefault((i, k), []).append(v)
    assert means.keys() == near.keys() and all(abs(means[k] - sum(v) / len(v)) < 1e-12 for k, v in near.items()) and near


def test_sampling_in_groups(spark, monkeypatch):
    """Points in classes, groups of tiles and of cells, keys of several rows, null keys and points off all rasters."""
    monkeypatch.setattr(raster, "HELD", 4)
    monkeypatch.setattr(raster, "PASSED", 32)
    monkeypatch.setattr(raster, "BLOCK", 8)
    cells = {(k, r, c): (None if (k + r) % 7 == 0 else float(k * 100 + r * 10 + c)) for k in range(30) for r in range(-2, 4) for c in range(62, 67) if (k + r * c) % 5}
    pixels = spark.createDataFrame([(*at, v) for at, v in cells.items()], "raster_id int, row int, col int, v double")
    points = [(k, 61.3 + (k % 4) * 1.2, 2.2 - (k % 3) * 1.1) for k in range(200)] + [(5, 64.5, -1.5), (5, 64.5, -1.5), (None, 64.5, -1.5), (1000, 500.0, 500.0), (1001, 70.0, 0.0)]
    df = spark.createDataFrame(points, "point_id int, x double, y double")
    near = {}
    for i, x, y in points:
        for (k, r, c), v in cells.items():
            if i is not None and (c + 0.5 - x) ** 2 + (-(r + 0.5) - y) ** 2 <= 2.25:
                near.setdefault(i, {}).setdefault(k, []).append(v)
    want = []
    for i, _, _ in points:
        for k, found in near.get(i, {None: [None]}).items():
            known = [v for v in found if v is not None]
            want.append((str(i), str(k), None if not known else round(sum(known) / len(known), 9)))
    means = zones.sample_points_buffer(df, pixels, "v", 1.5, 0.0, 0.0, 1.0, -1.0)
    got = [(str(r.point_id), str(r.raster_id), None if r["mean"] is None else round(r["mean"], 9)) for r in means.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(want) > 3000


def shuffled(spark, frame):
    """(rows, bytes) that a run of ``frame`` writes to its shuffles."""
    sc = spark.sparkContext
    known = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    before = {known().apply(k).stageId() for k in range(known().size())}
    frame.write.format("noop").mode("overwrite").save()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    after = [s for s in (known().apply(k) for k in range(known().size())) if s.stageId() not in before]
    return sum(s.shuffleWriteRecords() for s in after), sum(s.shuffleWriteBytes() for s in after)


def test_sampling_shuffles_no_product(spark):
    """Of 3,000 points and 200 rasters neither the 600,000 rows nor a copy of the points for each task are shuffled."""
    pixels = spark.range(1800).select((F.col("id") / 9).cast("int").alias("raster_id"), (F.col("id") / 3 % 3).cast("int").alias("row"), (F.col("id") % 3).cast("int").alias("col"), F.rand(1).alias("v"))
    points = spark.range(3000).select(F.col("id").alias("point_id"), (F.rand(2) * 3).alias("x"), (F.rand(3) * -3).alias("y"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "100")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert shuffled(spark, zones.sample_points_buffer(points, pixels, "v", 1.5, 0.0, 0.0, 1.0, -1.0))[0] < 200_000
        assert shuffled(spark, zones.sample_points(points, pixels, "v", "s.tif", 0.0, 0.0, 1.0, -1.0))[1] < 1_500_000
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_banks_are_not_broadcast(spark):
    """Tables with a row for each file or pixel, however small they are when compressed."""
    headers = spark.createDataFrame([("/b/aerial/img-20010704-1.tif", 0.0, 4.0, 1.0, -1.0, 1, 4, 4)], "filepath string, x0 double, y0 double, px double, py double, bands int, n_rows int, n_cols int")
    xml = headers.select("filepath", F.lit("").alias("xml"))
    zone = spark.createDataFrame([(1, 0.0, 0.0, 4.0, 0.0), (1, 4.0, 0.0, 4.0, 4.0), (1, 4.0, 4.0, 0.0, 0.0)], "zone_id int, x1 double, y1 double, x2 double, y2 double")
    features = catalog.bank_features(headers.select("filepath"), headers, xml)
    pixels = headers.select("filepath", F.lit(1).alias("row"), F.lit(2).alias("col"), F.lit(3.0).alias("value"))
    scenes = spark.createDataFrame([(1, "2001-07-04", "aerial", ["/b/aerial/img-20010704-1.tif"], "/t/1.tif")], "zone_id int, acq_date string, sensor string, files array<string>, th_path string")
    cut = flows.cut_scenes(scenes, pixels, headers, zones.zones_from_edges(zone), 1.0)
    joins = [line for df in (features, cut) for line in df._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in line and "filepath" in line]
    assert len(joins) == 4 and not [line for line in joins if "Broadcast" in line]
    assert features.count() == 1 and [tuple(r) for r in cut.collect()] == [("/t/1.tif", 1, 2, 3.0)]


def test_slicing_shuffles_no_product(spark):
    """Of 60 lines of 41 samples and 40 rasters of a zone the 98,400 rows are not shuffled; samples off a raster are null rows."""
    from motionfield.operators import profiles

    pixels = spark.range(40 * 64).select((F.col("id") / 64).cast("int").alias("raster_id"), (F.col("id") / 8 % 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"), F.col("id").cast("double").alias("dx"), F.lit(0.0).alias("dy"))
    pairs = spark.range(41).select(F.col("id").cast("int").alias("raster_id"), F.lit(2000).alias("left_year"), F.lit(2001).alias("right_year"), F.lit("z").alias("zone"))
    point = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    lines = spark.range(60).select(F.concat(F.lit("L"), F.col("id").cast("string")).alias("sp_id"), F.lit("z").alias("zone"), F.array(point(F.lit(-20.5), -(F.col("id") % 8) - 0.5), point(F.lit(19.5), -(F.col("id") % 8) - 0.5)).alias("line"))
    got = profiles.slice_lines(lines, "sp_id", pixels, pairs, ("x",), 0.0, 0.0, 1.0, -1.0)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert shuffled(spark, got)[0] < 5_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    want = {(f"L{i}", k, pos): (float(k * 64 + (i % 8) * 8 + pos - 21) if k < 40 and 21 <= pos < 29 else None) for i in range(60) for k in range(41) for pos in range(41)}
    assert {(r.sp_id, r.raster_id, r.pos): r.x for r in got.collect()} == want and got.count() == len(want)

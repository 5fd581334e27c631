"""Polygons by cells, pairs of large zones."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionfield.operators import catalog, zones

EDGES = "array<struct<x1: double, y1: double, x2: double, y2: double>>"


def ring(n, seed, cx=0.0, cy=0.0, r=100.0):
    """A star-shaped ring with long and short edges, concave in many places."""
    rng = np.random.default_rng(seed)
    angle = np.sort(rng.uniform(0, 2 * math.pi, n))
    far = r * rng.uniform(0.3, 1.0, n)
    return np.stack([cx + far * np.cos(angle), cy + far * np.sin(angle)], axis=1)


def edges_of(*rings):
    return [{"x1": float(a[0]), "y1": float(a[1]), "x2": float(b[0]), "y2": float(b[1])} for p in rings for a, b in zip(p, np.roll(p, -1, axis=0), strict=True)]


def inside(x, y, edges):
    hit = np.zeros(len(x), int)
    for e in edges:
        if e["y1"] != e["y2"]:
            at = e["x1"] + (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"])
            hit += ((e["y1"] > y) != (e["y2"] > y)) & (x < at)
    return hit % 2 == 1


def test_polygons_with_holes_and_many_edges(spark):
    hole = np.array([(-10.0, -10.0), (10.0, -10.0), (10.0, 10.0), (-10.0, 10.0)])
    shapes = {1: edges_of(ring(700, 1)), 2: edges_of(ring(60, 2, 50, 20, 40), hole), 3: edges_of(np.array([(0.0, 0.0), (200.0, 1.0), (0.0, 2.0)])), 4: edges_of(np.array([(-300.0, -300.0), (300.0, -300.0), (300.0, 300.0), (-300.0, 300.0)])), 5: edges_of(ring(5, 4, 1e6, 5e6, 3e4)), 6: edges_of(ring(30, 5, 3, 3, 1e-3)), 7: []}
    rng = np.random.default_rng(0)
    x, y = np.concatenate([rng.uniform(-120, 210, 3000), rng.uniform(9.7e5, 1.03e6, 300), rng.uniform(2.999, 3.001, 300)]), np.concatenate([rng.uniform(-120, 120, 3000), rng.uniform(4.97e6, 5.03e6, 300), rng.uniform(2.999, 3.001, 300)])
    zs = spark.createDataFrame([(k, v, f"n{k}") for k, v in shapes.items()], f"zone_id int, edges {EDGES}, name string")
    points = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "k int, x double, y double")
    got = {(r.zone_id, r.k) for r in zones.zonal_join(points, zs).filter("name = concat('n', zone_id)").collect()}
    want = {(z, k) for z, e in shapes.items() for k in np.flatnonzero(inside(x, y, e)).tolist()}
    assert got == want and len(want) > 3000
    boxes = [(f"b{k}", float(a), float(b), float(a + w), float(b + w)) for k, (a, b, w) in enumerate(zip(x[::30], y[::30], rng.choice([0.5, 3.0, 40.0, 500.0], len(x[::30])), strict=True))]
    images = spark.createDataFrame([(n, dict(zip(("xmin", "ymin", "xmax", "ymax"), v, strict=True))) for n, *v in boxes], "filepath string, extent struct<xmin: double, ymin: double, xmax: double, ymax: double>")

    def meets(e, x0, y0, x1, y1):
        if not e:
            return False
        a = np.array([[s["x1"], s["y1"], s["x2"], s["y2"]] for s in e])
        near = (np.minimum(a[:, 0], a[:, 2]) <= x1) & (np.maximum(a[:, 0], a[:, 2]) >= x0) & (np.minimum(a[:, 1], a[:, 3]) <= y1) & (np.maximum(a[:, 1], a[:, 3]) >= y0)
        side = np.stack([(a[:, 2] - a[:, 0]) * (v - a[:, 1]) - (a[:, 3] - a[:, 1]) * (u - a[:, 0]) for u in (x0, x1) for v in (y0, y1)])
        return bool((near & (side.min(axis=0) <= 0) & (side.max(axis=0) >= 0)).any() or inside(np.array([x0]), np.array([y0]), e)[0])

    want = sorted((z, n) for n, *v in boxes for z, e in shapes.items() if meets(e, *v))
    assert sorted((r.zone_id, r.filepath) for r in catalog.images_on_zones(images, zs).collect()) == want and len(want) > 50


def test_cost_doesnt_follow_the_edges(spark):
    """A polygon of 20,000 edges costs its pixels little more than one of 100, and no row carries more than its cell's edges."""
    points = spark.range(0, 400_000, 1, 8).select(F.col("id").alias("k"), (F.rand(1) * 200 - 100).alias("x"), (F.rand(2) * 200 - 100).alias("y"))
    took = {}
    for n in (100, 100, 20_000):
        angle = np.linspace(0, 2 * math.pi, n, endpoint=False)
        far = 80 + 10 * np.sin(9 * angle)
        zs = spark.createDataFrame([(1, edges_of(np.stack([far * np.cos(angle), far * np.sin(angle)], axis=1)))], f"zone_id int, edges {EDGES}")
        began = time.time()
        hits = zones.zonal_join(points, zs).count()
        took[n] = time.time() - began
        assert abs(hits / 400_000 - (math.pi * (80**2 + 50)) / 200**2) < 0.01
        cells = zones.polygon_cells(zones.with_level(zs))
        assert cells.agg(F.max(F.size("edges"))).first()[0] < 200
    assert took[20_000] < 3 * took[100] + 5


def test_a_large_zone_is_shared_by_all_tasks(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.shuffle.partitions", 32)
    try:
        rows = spark.range(3000).select(F.lit("pz1").alias("th_pz_name"), F.concat(F.lit("/p/"), "id").alias("th_path"), F.lit("s").alias("th_sensor"), F.lit("2000-01-01").alias("th_date"), F.lit(2000).alias("th_year"))
        rows = rows.union(spark.createDataFrame([("pz2", "/q/1", "s", "2000-01-01", 2000), ("pz2", "/q/2", "s", "2000-01-01", 2000)], rows.schema))
        pairs = catalog.make_pairs(rows, 128)
        sizes = sorted(r[1] for r in pairs.groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) == 3000 * 2999 + 2 and len(sizes) == 32 and sizes[-1] < 2 * sizes[16]
        assert pairs.filter("pa_pz_name = 'pz2'").count() == 2
        assert pairs.select("pa_left_path", "pa_right_path").distinct().count() == sum(sizes)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, n):
    zs = spark.createDataFrame([(1, edges_of(ring(9, 1)))][:n], f"zone_id int, edges {EDGES}")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, 1e9, 0.0)], "k int, x double, y double")
    assert [r.k for r in zones.zonal_join(points, zs).collect()] == [1][:n]
    assert zones.zonal_join(points.limit(0), zs).count() == 0

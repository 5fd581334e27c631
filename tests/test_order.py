"""Quantiles and clusters of rasters that are cut into many buckets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionfield.operators import order, raster, segment


def values(seed):
    rng = np.random.default_rng(seed)
    return {0: np.round(rng.normal(size=900), 2), 1: np.concatenate([rng.normal(0, 1, 700), rng.normal(30, 1, 500)]), 2: np.array([3.0]), 3: np.array([2.0, 2.0, 7.0, np.nan]), 4: rng.exponential(5, 2000), 5: np.zeros(50), 6: np.array([np.nan])}


def frame(spark, of):
    rows = [(k, j, None if j % 97 == 5 else float(v)) for k, vs in of.items() for j, v in enumerate(vs)]
    return spark.createDataFrame(rows, "raster_id int, col int, v double"), {k: np.array([v for j, v in enumerate(vs) if j % 97 != 5 and not np.isnan(v)]) for k, vs in of.items()}


@pytest.mark.parametrize("bucket", [7, 4096])
def test_quantiles(spark, bucket):
    df, of = frame(spark, values(1))
    buckets, names = order.value_buckets(df, "v", "raster_id", bucket)
    got = {r.raster_id: r.q for r in names.join(order.quantiles(buckets, [0.0, 0.25, 0.5, 0.9, 1.0]), "g").collect()}
    want = {k: np.quantile(v, [0.0, 0.25, 0.5, 0.9, 1.0]) for k, v in of.items() if len(v)}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
    assert buckets.agg(F.max(F.size("vs"))).first()[0] <= bucket
    # a raster's buckets follow each other and hold its distinct values once
    assert {r[0]: r[1] for r in buckets.groupBy("g").agg(F.sum(F.size("vs"))).collect()} == {k: len(np.unique(v)) for k, v in of.items() if len(v)}


def lloyd(v, k, rounds):
    c = np.quantile(v, [(2 * i + 1) / (2 * k) for i in range(k)])
    for _ in range(rounds):
        label = np.abs(v[:, None] - c[None, :]).argmin(axis=1)
        c = np.sort([v[label == i].mean() if (label == i).any() else c[i] for i in range(k)])
    return c


@pytest.mark.parametrize(("bucket", "k"), [(5, 2), (64, 4), (4096, 3)])
def test_centres(spark, monkeypatch, bucket, k):
    monkeypatch.setattr(order, "WHOLE", 1)
    df, of = frame(spark, values(k))
    buckets, _ = order.value_buckets(df, "v", "raster_id", bucket)
    got = {r.g: r.c for r in order.centres_1d(buckets, k, 20).collect()}
    want = {g: lloyd(v, k, 20) for g, v in of.items() if len(v)}
    assert got.keys() == want.keys() and all(np.allclose(got[g], want[g], atol=1e-9) for g in want)


def test_names_as_keys_and_empty_tables(spark):
    df, of = frame(spark, values(3))
    named = df.withColumn("zone", F.concat(F.lit("z_"), "raster_id"))
    labels, centres = segment.kmeans_1d(named, "v", key="zone")
    assert labels.count() == df.count() and centres.count() == 2 * sum(len(v) > 0 for v in of.values())
    label = {(r.zone, r.col): r.label for r in labels.collect()}
    for g, v in of.items():
        if len(v):
            a, b = lloyd(v, 2, 20)
            assert all(label[f"z_{r.raster_id}", r.col] == (0 if abs(r.v - a) <= abs(r.v - b) else 1) for r in df.filter(f"raster_id = {g} and v is not null and not isnan(v)").collect())
    centred = raster.center_disp(df, "v")
    assert centred.count() == df.count() and raster.center_disp(df.limit(0), "v").count() == 0
    got = np.array([r.v for r in centred.filter("raster_id = 4 and v is not null").orderBy("col").collect()])
    assert np.allclose(got, of[4] - np.median(of[4]))

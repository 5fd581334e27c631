"""Properties of segmentation, morphology and matching."""

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from motionfield.operators import matching, raster, segment


def frame(spark, a, name="label", kind="int", raster_id=0):
    return spark.createDataFrame([(raster_id, r, c, v.item()) for (r, c), v in np.ndenumerate(a)], f"raster_id int, row int, col int, {name} {kind}")


def array(df, shape, name="label"):
    out = np.full(shape, np.nan)
    for r in df.collect():
        if r[name] is not None:
            out[r.row, r.col] = r[name]
    return out


def box(a, n, fn):
    h, w = a.shape
    lo, hi = n // 2, n - 1 - n // 2
    return np.array([[fn(a[max(0, r - lo) : r + hi + 1, max(0, c - lo) : c + hi + 1]) for c in range(w)] for r in range(h)])


def straight(a, b, c):
    return (b[0] - a[0]) * (c[1] - b[1]) == (b[1] - a[1]) * (c[0] - b[0])


def chain_rings(sides: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Directed sides to closed rings; at a corner that two sides leave, the one that keeps the area's own cell on its inside is taken, so the rings of 4-connected areas are simple."""
    out = defaultdict(list)
    for r1, c1, r2, c2 in sorted(sides):
        out[(r1, c1)].append((r2, c2))
    rings = []
    for start in [c for c in sorted(out) for _ in out[c]]:
        if start not in out:
            continue
        ring, at, came = [start], start, None
        while True:
            nxt = out[at]
            if len(nxt) > 1 and came is not None:
                turn = lambda n: (n[1] - at[1]) * came[0] - (n[0] - at[0]) * came[1]  # noqa: E731, B023
                step = min(nxt, key=turn)
            else:
                step = nxt[0]
            nxt.remove(step)
            if not nxt:
                del out[at]
            came, at = (step[0] - at[0], step[1] - at[1]), step
            if at == start:
                break
            ring.append(at)
        rings.append([p for k, p in enumerate(ring) if not straight(ring[k - 1], p, ring[(k + 1) % len(ring)])])
    return rings


@pytest.mark.parametrize("n", [3, 5, 4])
def test_opening_and_closing(spark, n):
    a = np.random.default_rng(n).integers(0, 4, (14, 17))
    opened = array(raster.morph_open(frame(spark, a), "label", n), a.shape)
    closed = array(raster.morph_close(frame(spark, a), "label", n), a.shape)
    assert (opened == box(box(a, n, np.min), n, np.max)).all() and (closed == box(box(a, n, np.max), n, np.min)).all()
    if n % 2:
        assert (opened <= a).all() and (a <= closed).all()
        assert (array(raster.morph_open(frame(spark, opened.astype(int)), "label", n), a.shape) == opened).all()


def flood(a):
    out, h, w = np.full(a.shape, -1), *a.shape
    for r in range(h):
        for c in range(w):
            if out[r, c] < 0:
                todo = [(r, c)]
                out[r, c] = r * w + c
                while todo:
                    y, x = todo.pop()
                    for p, q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                        if 0 <= p < h and 0 <= q < w and out[p, q] < 0 and a[p, q] == a[y, x]:
                            out[p, q] = r * w + c
                            todo.append((p, q))
    return out


@pytest.mark.parametrize("tile", [3, 5, 64])
def test_areas_dont_depend_on_tiles(spark, tile):
    a = np.random.default_rng(1).integers(0, 2, (13, 16))
    a[:, 4] = 1
    got = array(segment.connected_areas(frame(spark, a), 16, tile), a.shape, "component")
    assert (got == flood(a)).all()


def test_outlines(spark):
    a = np.array([[1, 1, 1, 0], [1, 0, 1, 0], [1, 1, 1, 0], [0, 0, 0, 1]])
    areas = segment.connected_areas(frame(spark, a).filter("label = 1"), 4)
    rings = {r.component: r.rings for r in segment.polygonize(areas, 2.0, -2.0, 0.0, 8.0).collect()}
    outer, hole = rings[0]
    twice = lambda p: sum(s.x * t.y - t.x * s.y for s, t in zip(p, p[1:] + p[:1], strict=True))
    assert twice(outer) / 2 == 36 and twice(hole) / 2 == -4 and len(outer) == len(hole) == 4
    assert twice(rings[15][0]) / 2 == 4


def turned(ring):
    k = ring.index(min(ring))
    return tuple(ring[k:] + ring[:k])


@pytest.mark.parametrize("tile", [2, 5, 64])
def test_outlines_dont_depend_on_tiles(spark, tile):
    """Rings pass many tiles, touch themselves at corners and lie within each other; all labels are traced."""
    rng = np.random.default_rng(7)
    a = (rng.random((23, 19)) < 0.35).astype(int)
    a[2:20, 3], a[2:20, 15], a[2, 3:16], a[19, 3:16] = 1, 1, 1, 1
    labels = flood(a)
    want = {}
    for component in np.unique(labels):
        cells = {(int(r), int(c)) for r, c in zip(*np.where(labels == component), strict=True)}
        sides = [s for r, c in cells for (dr, dc), s in (((-1, 0), (r, c + 1, r, c)), ((1, 0), (r + 1, c, r + 1, c + 1)), ((0, -1), (r, c, r + 1, c)), ((0, 1), (r + 1, c + 1, r, c + 1))) if (r + dr, c + dc) not in cells]
        want[int(component)] = sorted(turned(ring) for ring in chain_rings(sides))
    areas = segment.connected_areas(frame(spark, a), 19, 8)
    got = {}
    for row in segment.ring_pieces(areas, tile).orderBy("component", "ring", "place").collect():
        got.setdefault(row.component, {}).setdefault(row.ring, []).extend(zip(row.pr, row.pc, strict=True))
    assert {c: sorted(turned(r) for r in rings.values()) for c, rings in got.items()} == want
    polygons = {r.component: r.rings for r in segment.polygonize(areas, 2.0, -2.0, 5.0, 46.0, tile).collect()}
    for c, rings in polygons.items():
        twice = [sum(s.x * t.y - t.x * s.y for s, t in zip(p, p[1:] + p[:1], strict=True)) for p in rings]
        assert twice[0] > 0 and all(t < 0 for t in twice[1:]) and sum(twice) / 2 == 4 * int((labels == c).sum())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**36 - 1))
def test_rings_close_and_hold_the_area(bits):
    a = np.array([(bits >> k) & 1 for k in range(36)]).reshape(6, 6)
    labels = flood(a)
    for component in np.unique(labels[a == 1]):
        cells = {(int(r), int(c)) for r, c in zip(*np.where(labels == component), strict=True)}
        sides = []
        for r, c in cells:
            for (dr, dc), s in (((-1, 0), (r, c + 1, r, c)), ((1, 0), (r + 1, c, r + 1, c + 1)), ((0, -1), (r, c, r + 1, c)), ((0, 1), (r + 1, c + 1, r, c + 1))):
                if (r + dr, c + dc) not in cells:
                    sides.append(s)
        rings = chain_rings(sides)
        area = sum(sum(p[1] * q[0] - q[1] * p[0] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) for ring in rings) / 2
        assert abs(area) == len(cells)
        assert all(len(set(ring)) == len(ring) for ring in rings)


def test_kmeans(spark):
    rows = [(0, 0, k, v) for k, v in enumerate([0.0, 0.1, 0.2, 9.0, 9.1, None, float("nan")])] + [(1, 0, k, 5.0) for k in range(3)]
    df = spark.createDataFrame(rows, "raster_id int, row int, col int, v double")
    labels, centres = segment.kmeans_1d(df, "v")
    got = {(r.raster_id, r.col): r.label for r in labels.collect()}
    assert [got[0, k] for k in range(7)] == [0, 0, 0, 1, 1, None, None] and [got[1, k] for k in range(3)] == [0, 0, 0]
    assert sorted((r.raster_id, r.label, round(r.centroid, 6)) for r in centres.collect()) == [(0, 0, 0.1), (0, 1, 9.05), (1, 0, 5.0), (1, 1, 5.0)]
    assert segment.kmeans_1d(df.limit(0), "v")[0].count() == 0


@pytest.mark.parametrize("tile", [8, 64])
def test_matching_finds_a_shift(spark, tile):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(24, 26))
    b = np.roll(a, (2, -1), axis=(0, 1))
    rows = [(0, r, c, a[r, c].item(), b[r, c].item()) for r in range(24) for c in range(26)]
    df = spark.createDataFrame(rows, "pair_id int, row int, col int, left double, right double")
    found = matching.match_blocks(df, kernel=5, search=3, tile=tile).collect()
    inner = [r for r in found if 5 <= r.row < 18 and 6 <= r.col < 20]
    assert len(found) == 24 * 26 and all((r.dy, r.dx, r.good) == (2.0, -1.0, 1) for r in inner)
    disp = spark.createDataFrame([(r.pair_id, r.row, r.col, r.dx, r.dy) for r in found], "pair_id long, row int, col int, dx double, dy double")
    by_join = {(r.row, r.col): r.cc for r in matching.corr_eval(df, disp, 5).collect()}
    by_tile = {(r.row, r.col): r.cc for r in matching.corr_eval_tiles(df, disp, 5, 3, tile).collect()}
    assert by_join.keys() == by_tile.keys()
    assert all((by_join[k] is None) == (by_tile[k] is None) and (by_join[k] is None or abs(by_join[k] - by_tile[k]) < 1e-6) for k in by_join)


def test_moving_areas_keep_zones_apart_and_gaps_empty(spark):
    """Zones whose names share their digits, or have none, stay apart; the closing fills no cell without data."""
    from motionfield.plans import flows

    rng, rows, pairs = np.random.default_rng(5), [], []
    for k, zone in enumerate(["pz1", "pz_1", "north"]):
        fast = np.zeros((8, 8), bool)
        fast[2 : 4 + k, 2:6] = True
        pairs.append((k, zone, "complete"))
        rows += [(k, r, c, float(fast[r, c] * 5 + rng.random() * 0.1)) for r in range(8) for c in range(8) if (r, c) != (2, 3)]
    pix = spark.createDataFrame(rows, "raster_id int, row int, col int, dx double")
    meta = spark.createDataFrame(pairs, "raster_id int, pz_name string, pa_status string")
    got = {(r.zone, r.component): r.n for r in flows.moving_areas(pix, meta, "dx", 8, 8, 1.0, -1.0, box=3).collect()}
    assert got == {("pz1", 18): 7, ("pz_1", 18): 11, ("north", 18): 15}

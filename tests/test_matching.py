"""Matching from coarse to fine, filters before correlation, matches that are dropped."""

import numpy as np
import pytest

from motionfield.operators import matching


def frame(spark, left, right, pair=0):
    return spark.createDataFrame([(pair, r, c, None if np.isnan(left[r, c]) else left[r, c].item(), None if np.isnan(right[r, c]) else right[r, c].item()) for r, c in np.ndindex(*left.shape)], "pair_id int, row int, col int, left double, right double")


def textured(rng, h, w):
    """Detail of several sizes, so that coarse levels have something to match."""
    a = rng.normal(size=(h, w))
    for k in (2, 4, 8):
        a += np.kron(rng.normal(size=(-(-h // k), -(-w // k))), np.ones((k, k)))[:h, :w] * k / 2
    return a


def plain(left, right, k, search, levels, step):
    """The pyramid on whole arrays, cell by cell: displacements (dy, dx) without the last peak."""
    half = lambda a: np.array([[a[2 * r : 2 * r + 2, 2 * c : 2 * c + 2].mean() if a[2 * r : 2 * r + 2, 2 * c : 2 * c + 2].shape == (2, 2) else np.nan for c in range(-(-a.shape[1] // 2))] for r in range(-(-a.shape[0] // 2))])
    images = [(left, right)]
    for _ in range(levels - 1):
        images.append((half(images[-1][0]), half(images[-1][1])))
    at = None
    for level in range(levels - 1, -1, -1):
        a, b = images[level]
        h, w = a.shape
        new, s = np.full((h, w, 2), np.nan), search if at is None else step
        steps = sorted(((y, x) for y in range(-s, s + 1) for x in range(-s, s + 1)), key=lambda o: (o[0] ** 2 + o[1] ** 2, *o))
        for r in range(k // 2, h - k // 2):
            for c in range(k // 2, w - k // 2):
                start = (0, 0) if at is None or np.isnan(at[r // 2, c // 2, 0]) else 2 * at[r // 2, c // 2]
                one, top = a[r - k // 2 : r + k // 2 + 1, c - k // 2 : c + k // 2 + 1], -np.inf
                for y, x in steps:
                    rr, cc = int(r + start[0] + y), int(c + start[1] + x)
                    if k // 2 <= rr < h - k // 2 and k // 2 <= cc < w - k // 2:
                        other = b[rr - k // 2 : rr + k // 2 + 1, cc - k // 2 : cc + k // 2 + 1]
                        score = np.corrcoef(one.ravel(), other.ravel())[0, 1] if not np.isnan(one).any() and not np.isnan(other).any() else -np.inf
                        if score > top + 1e-9:
                            top, new[r, c] = score, (rr - r, cc - c)
        at = new
    return at


@pytest.mark.parametrize("tile", [16, 64])
def test_pyramid_equals_the_plain_one(spark, tile):
    rng = np.random.default_rng(2)
    a = textured(rng, 34, 41)
    b = np.roll(a, (5, -4), axis=(0, 1)) + 0.05 * rng.normal(size=a.shape)
    found = matching.match_pyramid(frame(spark, a, b), 5, 3, 2, 1, threshold=1e9, subpixel=False, tile=tile).collect()
    want = plain(a, b, 5, 3, 2, 1)
    got = np.full((*a.shape, 2), np.nan)
    for r in found:
        if r.good:
            got[r.row, r.col] = r.dy, r.dx
    there = ~np.isnan(got[..., 0])
    assert there.sum() > 500 and (got[there] == want[there]).all() and len(found) == a.size


def test_a_shift_of_25_cells(spark):
    """Beyond the plain search of 10, with kernel 7, away from the edges, where the coarse images have whole windows."""
    rng = np.random.default_rng(3)
    big = textured(rng, 140, 150)
    a, b = big[30:130, 30:140], big[5:105, 22:132]
    found = [r for r in matching.match_pyramid(frame(spark, a, b), tile=64).collect() if 14 <= r.row < 56 and 14 <= r.col < 80]
    right = [r for r in found if r.good and abs(r.dy - 25) < 0.5 and abs(r.dx - 8) < 0.5]
    assert len(right) > 0.95 * len(found) > 1000
    plain_ = [r for r in matching.match_blocks(frame(spark, a[:30, :30], b[:30, :30])).collect() if r.good and (r.dy, r.dx) == (25, 8)]
    assert not plain_


def test_sub_pixel_peak(spark):
    y, x = np.mgrid[0:40, 0:44].astype(float)
    rng = np.random.default_rng(6)
    waves = [(2 * np.pi / rng.uniform(5, 14), rng.uniform(0, 2 * np.pi), rng.uniform(0, 2 * np.pi)) for _ in range(40)]
    image = lambda sy, sx: sum(np.cos(f * ((x - sx) * np.cos(t) + (y - sy) * np.sin(t)) + p) for f, t, p in waves)
    found = [r for r in matching.match_pyramid(frame(spark, image(0, 0), image(1.3, -0.4)), 7, 3, 1).collect() if 8 <= r.row < 30 and 8 <= r.col < 34]
    assert abs(np.median([r.dy for r in found if r.good]) - 1.3) < 0.1 and abs(np.median([r.dx for r in found if r.good]) + 0.4) < 0.1


def test_left_right_check_drops_a_match(spark):
    """A cell whose best match prefers another place, over 10 cells away, is dropped."""
    rng = np.random.default_rng(11)
    found = matching.match_blocks(frame(spark, rng.normal(size=(40, 40)), rng.normal(size=(40, 40)))).collect()
    inner = [r for r in found if 3 <= r.row < 37 and 3 <= r.col < 37]
    loose = matching.match_blocks(frame(spark, rng.normal(size=(40, 40)), rng.normal(size=(40, 40))), threshold=1e9).collect()
    assert 50 < sum(not r.good for r in inner) < len(inner) and all(r.dx is None for r in inner if not r.good)
    assert all(r.good for r in loose if 16 <= r.row < 24 and 16 <= r.col < 24)


def test_prefilter(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(26, 24)).cumsum(axis=0)
    b = np.roll(a, (1, 2), axis=(0, 1)) + 0.2 * rng.normal(size=a.shape)
    a[5, 5] = np.nan
    kernel = matching.log_kernel(1.0)
    assert kernel.shape == (7, 7) and abs(kernel.sum()) < 1e-12 and (kernel == kernel.T).all()
    df = frame(spark, a, b)
    filtered = {(r.row, r.col): (r.left, r.right) for r in matching.filter_pixels(df, ["left", "right"], kernel, tile=10).collect()}
    for r in range(26):
        for c in range(24):
            for k, v in enumerate((a, b)):
                window = v[max(0, r - 3) : r + 4, max(0, c - 3) : c + 4]
                want = (window * kernel).sum() if window.shape == (7, 7) else np.nan
                assert (filtered[r, c][k] is None) == bool(np.isnan(want)) and (filtered[r, c][k] is None or abs(filtered[r, c][k] - want) < 1e-9)
    disp = df.selectExpr("pair_id", "row", "col", "2.0D as dx", "1.0D as dy")
    by_join = {(r.row, r.col): r.cc for r in matching.corr_eval(df, disp, 5, prefilter=1.0).collect()}
    by_tile = {(r.row, r.col): r.cc for r in matching.corr_eval_tiles(df, disp, 5, 3, 10, prefilter=1.0).collect()}
    assert by_join.keys() == by_tile.keys() and sum(v is not None for v in by_join.values()) > 100
    assert all((by_join[k] is None) == (by_tile[k] is None) and (by_join[k] is None or abs(by_join[k] - by_tile[k]) < 1e-6) for k in by_join)


@pytest.mark.parametrize("h, w", [(8, 40), (40, 8), (7, 7), (9, 5)])
def test_images_smaller_than_the_search(spark, h, w):
    """The last raster of a table may have fewer rows or columns than the search reaches."""
    image = np.random.default_rng(h + w).random((h + 1, w + 1))
    cells = [(r, c, float(image[r, c]), float(image[r + 1, c])) for r in range(h) for c in range(w)]
    rows = spark.createDataFrame([(p, *c) for p in (1, 2) for c in cells], "pair_id int, row int, col int, left double, right double")
    got = {(r.row, r.col): (r.dx, r.dy, r.good) for r in matching.match_blocks(rows.filter("pair_id = 2"), kernel=7, search=10).collect()}
    left, right = np.array([c[2] for c in cells]).reshape(h, w), np.array([c[3] for c in cells]).reshape(h, w)

    def best(a, b):
        """Plain search: the best offset of each full window, by score, length, dy and dx."""
        out = {}
        for r in range(3, h - 3):
            for c in range(3, w - 3):
                found = []
                for y in range(-10, 11):
                    for x in range(-10, 11):
                        if 3 <= r + y < h - 3 and 3 <= c + x < w - 3:
                            s = np.corrcoef(a[r - 3 : r + 4, c - 3 : c + 4].ravel(), b[r + y - 3 : r + y + 4, c + x - 3 : c + x + 4].ravel())[0, 1]
                            found.append((-round(s, 7), y * y + x * x, y, x))
                out[r, c] = min(found)[2:]
        return out

    there, back = best(left, right), best(right, left)
    want = {}
    for r in range(h):
        for c in range(w):
            y, x = there.get((r, c), (None, None))
            ok = y is not None and abs(y + back[r + y, c + x][0]) <= 10 and abs(x + back[r + y, c + x][1]) <= 10
            want[r, c] = (float(x), float(y), 1) if ok else (None, None, 0)
    assert got == want and len(got) == h * w
    disp = matching.match_blocks(rows, kernel=7, search=10)
    assert matching.corr_eval_tiles(rows, disp, 7, 10).filter("cc is not null").count() == 2 * sum(g for _, _, g in want.values())


@pytest.mark.parametrize("name", ["d2_process_pairs", "d2_log"])
def test_flow_of_a_last_raster_of_eight_rows(spark, tmp_path, name):
    import duckdb

    from motionfield.registry import QUERIES, SQL

    duck = duckdb.connect()
    duck.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.01/events.parquet' WHERE event_id < 2 * 1024 + 256) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got, want = QUERIES[name](spark, str(tmp_path)), duck.sql(SQL[name])
    columns = sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    text = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(text, r)) for r in got.select(*columns).collect()) == sorted(tuple(text(r[k]) for k in at) for r in want.fetchall())

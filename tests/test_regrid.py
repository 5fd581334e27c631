"""Files of any origin and pixel size on one grid."""

import numpy as np
import pytest

from motionfield.operators import raster


def brute(files, grid, res, how):
    """{(file, row, col): value} by looking at every cell of the grid."""
    gx, gy, rows, cols = grid
    out = {}
    for name, (x0, y0, px, a) in files.items():
        for i in range(rows):
            for j in range(cols):
                x, y = gx + (j + 0.5) * res, gy - (i + 0.5) * res
                if how == "average" and px < res:
                    r, c = np.indices(a.shape)
                    cy, cx = y0 - (r + 0.5) * px, x0 + (c + 0.5) * px
                    v = a[(np.floor((gy - cy) / res) == i) & (np.floor((cx - gx) / res) == j)]
                    if len(v):
                        out[name, i, j] = float(v.mean())
                else:
                    r, c = int(np.floor((y0 - y) / px)), int(np.floor((x - x0) / px))
                    if 0 <= r < a.shape[0] and 0 <= c < a.shape[1]:
                        out[name, i, j] = float(a[r, c])
    return out


@pytest.mark.parametrize("how", ["nearest", "average"])
def test_against_brute_force(spark, how):
    rng = np.random.default_rng(4)
    files = {f"f{k}": (rng.uniform(-3, 6), rng.uniform(2, 12), px, rng.normal(size=(int(rng.integers(1, 14)), int(rng.integers(1, 14))))) for k, px in enumerate([0.5, 1.0, 0.3, 2.5, 1.0, 0.75])}
    grid = (0.13, 9.41, 7, 8)
    pixels = spark.createDataFrame([(n, r, c, v.item()) for n, (_, _, _, a) in files.items() for (r, c), v in np.ndenumerate(a)], "filepath string, row int, col int, value double")
    grids = spark.createDataFrame([(n, x0, y0, px, -px, *grid, "t") for n, (x0, y0, px, _) in files.items()], "filepath string, x0 double, y0 double, px double, py double, gx0 double, gy0 double, n_rows int, n_cols int, th_path string")
    got = {(r.filepath, r.row, r.col): r.value for r in raster.regrid(pixels, grids, 1.0, how).collect()}
    want = brute(files, grid, 1.0, how)
    assert got.keys() == want.keys() and len(want) > 20 and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert raster.regrid(pixels.limit(0), grids, 1.0, how).count() == 0
    with pytest.raises(ValueError):
        raster.regrid(pixels, grids, 1.0, "cubic")

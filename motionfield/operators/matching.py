"""Displacements by block matching, and the correlation of a given displacement."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

TILE = 256


def box_sums(a: np.ndarray, k: int) -> np.ndarray:
    """Sums over all full k x k windows."""
    c = np.zeros((a.shape[0] + 1, a.shape[1] + 1))
    np.cumsum(np.cumsum(a, axis=0), axis=1, out=c[1:, 1:])
    return c[k:, k:] - c[:-k, k:] - c[k:, :-k] + c[:-k, :-k]


def ncc(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Zero-mean normalised correlation of all full windows of two equal arrays; NaN where a value is missing or a window is flat."""
    bad = np.isnan(a) | np.isnan(b)
    a, b = np.where(bad, 0.0, a), np.where(bad, 0.0, b)
    shift_a, shift_b = a[~bad].mean() if (~bad).any() else 0.0, b[~bad].mean() if (~bad).any() else 0.0
    a, b = np.where(bad, 0.0, a - shift_a), np.where(bad, 0.0, b - shift_b)
    n = float(k * k)
    sa, sb = box_sums(a, k), box_sums(b, k)
    va, vb = n * box_sums(a * a, k) - sa * sa, n * box_sums(b * b, k) - sb * sb
    top = n * box_sums(a * b, k) - sa * sb
    flat = (va <= 1e-9 * n * n) | (vb <= 1e-9 * n * n) | (box_sums(bad.astype(float), k) > 0.5)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(flat, np.nan, top / np.sqrt(np.maximum(va, 1e-300) * np.maximum(vb, 1e-300)))


def moved_by(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The array whose cell (r, c) is ``a``'s (r + dy, c + dx), NaN outside."""
    h, w = a.shape
    out = np.full((h, w), np.nan)
    if abs(dy) < h and abs(dx) < w:
        out[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
    return out


def best_offsets(left: np.ndarray, right: np.ndarray, k: int, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dy, dx, score) for each cell of ``left``; ties go to the smaller offset, then dy, then dx; NaN without a full window."""
    h, w = left.shape
    half = k // 2
    dy_best, dx_best, top = np.full((h, w), np.nan), np.full((h, w), np.nan), np.full((h, w), -np.inf)
    for dy, dx in sorted(((y, x) for y in range(-s, s + 1) for x in range(-s, s + 1)), key=lambda o: (o[0] ** 2 + o[1] ** 2, *o)):
        if h < k or w < k:
            break
        score = np.full((h, w), -np.inf)
        # an image may be smaller than the offset
        found = ncc(left, moved_by(right, dy, dx), k)
        score[half : half + found.shape[0], half : half + found.shape[1]] = np.where(np.isnan(found), -np.inf, found)
        better = score > top + 1e-9
        dy_best[better], dx_best[better], top[better] = dy, dx, score[better]
    return dy_best, dx_best, np.where(np.isinf(top), np.nan, top)


def _grid(pdf: pd.DataFrame, columns: list[str]) -> tuple[int, int, list[np.ndarray]]:
    r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
    shape = (int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1)
    out = []
    for c in columns:
        a = np.full(shape, np.nan)
        a[pdf["row"] - r0, pdf["col"] - c0] = pdf[c].astype(float)
        out.append(a)
    return r0, c0, out


def with_halo(pixels: DataFrame, tile: int, halo: int) -> DataFrame:
    """Adds tr, tc: each pixel once for every tile whose border it is within ``halo`` of."""
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile)))
    return pixels.withColumn("tr", span("row")).withColumn("tc", span("col"))


def scores_at(left: np.ndarray, right: np.ndarray, k: int, dy: int, dx: int) -> np.ndarray:
    """Correlation of each cell's window with the one displaced by (dy, dx); -inf without a full window."""
    out = np.full(left.shape, -np.inf)
    if min(left.shape) >= k:
        found = ncc(left, moved_by(right, dy, dx), k)
        out[k // 2 : k // 2 + found.shape[0], k // 2 : k // 2 + found.shape[1]] = np.where(np.isnan(found), -np.inf, found)
    return out


def log_kernel(sigma: float) -> np.ndarray:
    """Laplacian of a Gaussian within three deviations, with a sum of zero."""
    half = int(np.ceil(3 * sigma))
    y, x = np.mgrid[-half : half + 1, -half : half + 1]
    r2 = (x * x + y * y).astype(float)
    w = (r2 - 2 * sigma**2) / sigma**4 * np.exp(-r2 / (2 * sigma**2))
    return w - w.mean()


def convolved(a: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Weighted sums over full windows, NaN where a value is missing."""
    half, out = kernel.shape[0] // 2, np.zeros(a.shape)
    for (i, j), w in np.ndenumerate(kernel):
        out += w * moved_by(a, i - half, j - half)
    return out


def filter_pixels(pixels: DataFrame, columns: list[str], kernel: np.ndarray, tile: int = TILE, key: str = "pair_id") -> DataFrame:
    """(key, row, col, columns): each column convolved with ``kernel``, over tiles with a halo; null without a full window."""
    half = kernel.shape[0] // 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = (pdf["row"] // tile == pdf["tr"]) & (pdf["col"] // tile == pdf["tc"])
        r0, c0, found = _grid(pdf, columns)
        rows, cols = pdf["row"][own].to_numpy(), pdf["col"][own].to_numpy()
        return pd.DataFrame({key: pdf[key].iloc[0], "row": rows, "col": cols, **{c: convolved(a, kernel)[rows - r0, cols - c0] for c, a in zip(columns, found, strict=True)}})

    rows = pixels.select(F.col(key).cast("long").alias(key), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), *columns)
    found = with_halo(rows, tile, half).groupBy(key, "tr", "tc").applyInPandas(run, f"{key} long, row int, col int, " + ", ".join(f"{c} double" for c in columns))
    return found.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in columns})


def match_blocks(clipped: DataFrame, kernel: int = 7, search: int = 10, threshold: float = 10.0, tile: int = TILE) -> DataFrame:
    """(pair_id, row, col, dx, dy, good): integer displacements of each cell of a pair's common area.

    ``clipped``: pair_id, row, col, left, right.  A match is dropped (nulls,
    good 0) if matching back from its place differs by more than ``threshold``
    cells.  Tiles carry a halo, so results don't depend on ``tile``.
    """
    halo = 2 * search + 2 * (kernel // 2) + 1

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = (pdf["row"] // tile == pdf["tr"]) & (pdf["col"] // tile == pdf["tc"])
        if not own.any():  # a tile outside the image, which has a halo's cells alone
            return pd.DataFrame({"pair_id": [], "row": [], "col": [], "dx": [], "dy": [], "good": []})
        r0, c0, (left, right) = _grid(pdf, ["left", "right"])
        dy, dx, _ = best_offsets(left, right, kernel, search)
        by, bx, _ = best_offsets(right, left, kernel, search)
        rows, cols = pdf["row"][own].to_numpy(), pdf["col"][own].to_numpy()
        y, x = dy[rows - r0, cols - c0], dx[rows - r0, cols - c0]
        there = ~np.isnan(y)
        at_r, at_c = (rows - r0 + np.nan_to_num(y)).astype(int), (cols - c0 + np.nan_to_num(x)).astype(int)
        back_y, back_x = by[at_r, at_c], bx[at_r, at_c]
        good = there & ~np.isnan(back_y) & (np.abs(y + back_y) <= threshold) & (np.abs(x + back_x) <= threshold)
        return pd.DataFrame({"pair_id": pdf["pair_id"].iloc[0], "row": rows, "col": cols, "dx": pd.Series(np.where(good, x, np.nan)), "dy": pd.Series(np.where(good, y, np.nan)), "good": good.astype(int)})

    schema = "pair_id long, row int, col int, dx double, dy double, good int"
    found = with_halo(clipped.withColumn("pair_id", F.col("pair_id").cast("long")), tile, halo).groupBy("pair_id", "tr", "tc").applyInPandas(run, schema)
    return found.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("dx", "dy")})


def corr_eval(clipped: DataFrame, disp: DataFrame, kernel: int = 7, prefilter: float | None = None) -> DataFrame:
    """(pair_id, row, col, cc): Pearson correlation of each left window with the right window at its rounded displacement.

    Equi-joins on cells: kernel offsets, left cells, displaced right cells.
    Full windows only; flat windows are null.  ``prefilter`` is the deviation
    of a Laplacian of Gaussian that both images go through first.
    """
    if prefilter:
        clipped = filter_pixels(clipped, ["left", "right"], log_kernel(prefilter))
    half = kernel // 2
    offsets = F.explode(F.sequence(F.lit(-half), F.lit(kernel - 1 - half)))
    step = lambda c: F.floor(F.col(c) + 0.5).cast("int")
    centres = disp.filter("dx is not null and dy is not null").select("pair_id", "row", "col", step("dx").alias("sx"), step("dy").alias("sy"))
    near = centres.withColumn("oy", offsets).withColumn("ox", offsets)
    near = near.select("pair_id", "row", "col", (F.col("row") + F.col("oy")).alias("lr"), (F.col("col") + F.col("ox")).alias("lc"), (F.col("row") + F.col("oy") + F.col("sy")).alias("rr"), (F.col("col") + F.col("ox") + F.col("sx")).alias("rc"))
    left = clipped.filter("left is not null").select("pair_id", F.col("row").alias("lr"), F.col("col").alias("lc"), "left")
    right = clipped.filter("right is not null").select("pair_id", F.col("row").alias("rr"), F.col("col").alias("rc"), "right")
    both = near.join(left, ["pair_id", "lr", "lc"]).join(right, ["pair_id", "rr", "rc"])
    c = both.groupBy("pair_id", "row", "col").agg(F.count("*").alias("n"), F.corr("left", "right").alias("cc"))
    full = F.when(F.col("n") == kernel * kernel, F.nanvl("cc", F.lit(None).cast("double")))
    return disp.select("pair_id", "row", "col").join(c, ["pair_id", "row", "col"], "left").select("pair_id", "row", "col", full.alias("cc"))


def corr_eval_tiles(clipped: DataFrame, disp: DataFrame, kernel: int = 7, reach: int = 10, tile: int = TILE, prefilter: float | None = None) -> DataFrame:
    """The same from tiles, without the kernel-squared join; displacements are at most ``reach`` cells."""
    half = kernel // 2
    log = log_kernel(prefilter) if prefilter else None
    halo = reach + half + 1 + (log.shape[0] // 2 if prefilter else 0)
    rows = clipped.join(disp.select("pair_id", "row", "col", "dx", "dy"), ["pair_id", "row", "col"], "left").withColumn("pair_id", F.col("pair_id").cast("long"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0, (left, right, dx, dy) = _grid(pdf, ["left", "right", "dx", "dy"])
        if log is not None:
            left, right = convolved(left, log), convolved(right, log)
        h, w = left.shape
        sx, sy = np.floor(dx + 0.5), np.floor(dy + 0.5)
        out = np.full((h, w), np.nan)
        if h >= kernel and w >= kernel:
            steps = np.unique(np.stack([sy, sx], axis=-1)[~np.isnan(sx) & ~np.isnan(sy)], axis=0).astype(int)
            for y, x in steps:
                moved = np.full((h, w), np.nan)
                if abs(y) < h and abs(x) < w:
                    moved[max(0, -y) : h - max(0, y), max(0, -x) : w - max(0, x)] = right[max(0, y) : h - max(0, -y), max(0, x) : w - max(0, -x)]
                full = np.full((h, w), np.nan)
                found = ncc(left, moved, kernel)
                full[half : half + found.shape[0], half : half + found.shape[1]] = found
                here = (sy == y) & (sx == x)
                out[here] = full[here]
        own = (pdf["row"] // tile == pdf["tr"]) & (pdf["col"] // tile == pdf["tc"])
        rr, cc = pdf["row"][own].to_numpy(), pdf["col"][own].to_numpy()
        return pd.DataFrame({"pair_id": pdf["pair_id"].iloc[0], "row": rr, "col": cc, "cc": out[rr - r0, cc - c0]})

    found = with_halo(rows, tile, halo).groupBy("pair_id", "tr", "tc").applyInPandas(run, "pair_id long, row int, col int, cc double")
    return found.withColumn("cc", F.nanvl("cc", F.lit(None).cast("double")))


def _level(joined: DataFrame, kernel: int, search: int, halo: int, tile: int, subpixel: bool) -> DataFrame:
    """(pair_id, row, col, dx, dy, score): the best displacement within ``search`` cells of each cell's own (px, py)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = (pdf["row"] // tile == pdf["tr"]) & (pdf["col"] // tile == pdf["tc"])
        if not own.any():
            return pd.DataFrame({c: [] for c in ("pair_id", "row", "col", "dx", "dy", "score")})
        r0, c0, (left, right, px, py) = _grid(pdf, ["left", "right", "px", "py"])
        rows, cols = pdf["row"][own].to_numpy() - r0, pdf["col"][own].to_numpy() - c0
        py, px = py[rows, cols], px[rows, cols]
        known = ~np.isnan(py) & ~np.isnan(px)
        steps = sorted(((y, x) for y in range(-search, search + 1) for x in range(-search, search + 1)), key=lambda o: (o[0] ** 2 + o[1] ** 2, *o))
        best, top = np.full((len(rows), 2), np.nan), np.full(len(rows), -np.inf)
        starts = np.unique(np.stack([py[known], px[known]], axis=1), axis=0).astype(int)
        held: dict[tuple[int, int], np.ndarray] = {}

        def score(dy: int, dx: int) -> np.ndarray:
            # cells that start from different displacements ask for the same ones
            if (dy, dx) not in held:
                held[dy, dx] = scores_at(left, right, kernel, dy, dx)[rows, cols]
            return held[dy, dx]

        for y0, x0 in starts.tolist():
            here = known & (py == y0) & (px == x0)
            for y, x in steps:
                s = score(y0 + y, x0 + x)
                better = here & (s > top + 1e-9)
                best[better], top[better] = (y0 + y, x0 + x), s[better]
        found = ~np.isnan(best[:, 0])
        exact = best.copy()
        if subpixel:
            for y, x in np.unique(best[found], axis=0).astype(int).tolist():
                here = np.flatnonzero(found & (best[:, 0] == y) & (best[:, 1] == x))
                for axis, (a, b) in enumerate((((y - 1, x), (y + 1, x)), ((y, x - 1), (y, x + 1)))):
                    low, high = score(*a)[here], score(*b)[here]
                    # the top of the parabola through the peak and its neighbours
                    with np.errstate(invalid="ignore", divide="ignore"):
                        shift = (low - high) / (2 * (low - 2 * top[here] + high))
                    ok = np.isfinite(low) & np.isfinite(high) & (np.abs(shift) <= 0.5)
                    exact[here, axis] += np.where(ok, shift, 0.0)
        return pd.DataFrame({"pair_id": pdf["pair_id"].iloc[0], "row": rows + r0, "col": cols + c0, "dx": exact[:, 1], "dy": exact[:, 0], "score": np.where(found, top, np.nan)})

    found = with_halo(joined, tile, halo).groupBy("pair_id", "tr", "tc").applyInPandas(run, "pair_id long, row int, col int, dx double, dy double, score double")
    return found.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in ("dx", "dy", "score")})


def _pyramid(images: list[DataFrame], kernel: int, search: int, step: int, tile: int, subpixel: bool) -> DataFrame:
    """Displacements from the coarsest image to the finest; a cell starts from twice its parent's."""
    at, reach = None, 0
    for k in range(len(images) - 1, -1, -1):
        cells, last = images[k], k == 0
        if at is None:
            joined, reach = cells.withColumns({"px": F.lit(0.0), "py": F.lit(0.0)}), search
        else:
            parent = at.select("pair_id", F.col("row").alias("mf_r"), F.col("col").alias("mf_c"), (F.round("dx") * 2).alias("px"), (F.round("dy") * 2).alias("py"))
            # a cell whose parent has no match starts from no displacement
            joined = cells.withColumns({"mf_r": F.floor(F.col("row") / 2).cast("int"), "mf_c": F.floor(F.col("col") / 2).cast("int")}).join(parent, ["pair_id", "mf_r", "mf_c"], "left").drop("mf_r", "mf_c")
            joined = joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("px", "py")})
            reach = 2 * reach + step
        own = search if at is None else step
        at = materialize(_level(joined, kernel, own, reach + kernel // 2 + 2, tile, subpixel and last), "pyramid")
    return at


def match_pyramid(clipped: DataFrame, kernel: int = 7, search: int = 10, levels: int = 3, step: int = 2, threshold: float = 10.0, subpixel: bool = True, tile: int = TILE) -> DataFrame:
    """(pair_id, row, col, dx, dy, good): displacements from coarse to fine.

    Each level halves the images (means of 2 x 2 cells).  The coarsest is
    searched within ``search`` of its cells, so displacements reach about
    ``search * 2 ** (levels - 1)`` cells; each finer level within ``step``
    cells of twice the displacement of the cell above.  The finest gets the
    top of the parabola through the best score and its neighbours.  Matches
    are dropped as by ``match_blocks``.  Work grows with the reach's logarithm
    and tiles carry a halo, so results don't depend on ``tile``.
    """
    cells = clipped.select(F.col("pair_id").cast("long").alias("pair_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("left").cast("double").alias("left"), F.col("right").cast("double").alias("right"))
    half = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    images = [cells]
    for k in range(1, levels):
        # a cell of which one value is missing is missing
        mean = lambda c: F.when(F.count(c) == 4, F.avg(c)).alias(c)
        images.append(materialize(images[-1].groupBy("pair_id", half("row"), half("col")).agg(mean("left"), mean("right")), f"level{k}"))
    there = _pyramid(images, kernel, search, step, tile, subpixel)
    swapped = [i.withColumnsRenamed({"left": "mf_l", "right": "left"}).withColumnRenamed("mf_l", "right") for i in images]
    back = _pyramid(swapped, kernel, search, step, tile, False).select("pair_id", F.col("row").alias("mf_r"), F.col("col").alias("mf_c"), F.col("dx").alias("bx"), F.col("dy").alias("by"))
    placed = there.withColumns({"mf_r": (F.col("row") + F.round("dy")).cast("int"), "mf_c": (F.col("col") + F.round("dx")).cast("int")}).join(back, ["pair_id", "mf_r", "mf_c"], "left")
    good = F.coalesce((F.abs(F.round("dx") + F.col("bx")) <= threshold) & (F.abs(F.round("dy") + F.col("by")) <= threshold), F.lit(False))
    return placed.select("pair_id", "row", "col", F.when(good, F.col("dx")).alias("dx"), F.when(good, F.col("dy")).alias("dy"), good.cast("int").alias("good"))

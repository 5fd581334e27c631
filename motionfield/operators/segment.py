"""Moving areas: clusters, label sums, connected areas and their outlines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from . import order
from .graph import components

TILE = 512


def kmeans_1d(pixels: DataFrame, value: str, k: int = 2, rounds: int = 20, key: str = "raster_id") -> tuple[DataFrame, DataFrame]:
    """(labels, centroids) of the values of each raster.

    Starts at the quantiles (2i + 1) / 2k; a fixed number of rounds; ties go to
    the lower label; an empty cluster keeps its centre; label 0 is the lowest
    centre.  Null and NaN values stay without a label.  The pixels are read
    for their value counts and for their labels, whatever the rounds; a round
    is a look-up of k - 1 bounds in the prefix sums of the sorted counts.
    """
    v = F.col(value).cast("double")
    buckets, names = order.value_buckets(pixels, value, key)
    centres = materialize(names.join(order.centres_1d(buckets, k, rounds), "g").select(key, "c"), "kmeans-centres")
    labels = pixels.join(centres, key, "left").withColumn("label", F.when(v.isNotNull() & ~F.isnan(v), nearest(v, F.col("c")))).drop("c")
    table = centres.select(key, F.posexplode("c").alias("label", "centroid"))
    return labels, table


def nearest(v, centres):
    """Index of the first nearest of ascending centres."""
    far = F.transform(centres, lambda c: F.abs(v - c))
    return (F.array_position(far, F.array_min(far)) - 1).cast("int")


def add_moving_areas(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(zone, row, col, total, n): cell-wise sum of the labels of a zone's complete pairs, where all of them have a value."""
    done = pairs.filter("pa_status = 'complete'").select("raster_id", F.col("pz_name").alias("zone"))
    wanted = done.groupBy("zone").agg(F.count("*").alias("n"))
    sums = labels.filter("label is not null").join(done, "raster_id").groupBy("zone", "row", "col").agg(F.sum("label").alias("total"), F.count("*").alias("n"))
    return sums.join(wanted, ["zone", "n"]).select("zone", "row", "col", "total", "n")


def cluster_addition(sums: DataFrame, k: int = 2, rounds: int = 20) -> tuple[DataFrame, DataFrame]:
    """K-means of a zone's label sums; few distinct values, so a round is cheap."""
    return kmeans_1d(sums, "total", k, rounds, key="zone")


# ---- connected areas ---------------------------------------------------------------


def _tile_areas(pdf: pd.DataFrame) -> pd.DataFrame:
    """Local areas of a tile: each cell gets the smallest cell number of its area in the tile."""
    r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
    r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
    h, w = int(r.max()) + 1, int(c.max()) + 1
    big = np.iinfo(np.int64).max
    value = np.full((h, w), -(2**62), np.int64)
    area = np.full((h, w), big)
    value[r, c], area[r, c] = pdf["label"].to_numpy(), pdf["cell"].to_numpy()
    there = np.zeros((h, w), bool)
    there[r, c] = True
    down = there[1:] & there[:-1] & (value[1:] == value[:-1])
    right = there[:, 1:] & there[:, :-1] & (value[:, 1:] == value[:, :-1])
    # smallest number over the links, with jumps through the representative
    at = np.cumsum(there.ravel()).reshape(h, w) - 1
    a = np.concatenate([at[1:][down], at[:, 1:][right]])
    b = np.concatenate([at[:-1][down], at[:, :-1][right]])
    cells = area[there]
    parent = np.arange(len(cells))
    while len(a):
        pa, pb = parent[a], parent[b]
        hi, lo = np.maximum(pa, pb), np.minimum(pa, pb)
        if (hi == lo).all():
            break
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    least = np.full(len(cells), big)
    np.minimum.at(least, parent, cells)
    order = at[r, c]
    return pd.DataFrame({"raster_id": pdf["raster_id"], "row": pdf["row"], "col": pdf["col"], "label": pdf["label"], "cell": pdf["cell"], "local": least[parent[order]]})


def connected_areas(labels: DataFrame, n_cols: int, tile: int = TILE) -> DataFrame:
    """(raster_id, row, col, label, component): 4-connected areas of equal label.

    ``component`` is the smallest row * n_cols + col of the area.  Areas are
    found tile by tile (a bounded group), then joined over tile borders.
    ``raster_id`` is a number below 2^31, a raster has fewer than 2^32 cells:
    others raise.
    """
    schema = "raster_id long, row int, col int, label long, cell long, local long"
    cells = labels.filter("label is not null").select(F.col("raster_id").cast("long").alias("raster_id"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("label").cast("long").alias("label"))
    cells = cells.withColumns({"cell": F.col("row").cast("long") * n_cols + F.col("col"), "tr": F.floor(F.col("row") / tile), "tc": F.floor(F.col("col") / tile)})
    fits = (F.col("cell") < F.lit(2**32)) & F.col("raster_id").between(0, 2**31 - 1)
    cells = cells.withColumn("cell", F.when(fits, F.col("cell")).otherwise(F.raise_error(F.lit("a raster of 2^32 cells or more, or a raster_id out of range")).cast("long")))
    found = materialize(cells.groupBy("raster_id", "tr", "tc").applyInPandas(lambda pdf: _tile_areas(pdf), schema), "areas")
    edge = lambda c: (F.col(c) % tile == 0) | (F.col(c) % tile == tile - 1)
    border = found.filter(edge("row") | edge("col")).select("raster_id", "row", "col", "label", "local")
    moved = border.filter(F.col("row") % tile == tile - 1).withColumn("row", F.col("row") + 1).unionByName(border.filter(F.col("col") % tile == tile - 1).withColumn("col", F.col("col") + 1))
    other = moved.withColumnRenamed("local", "local2")
    name = lambda c: F.col("raster_id") * F.lit(2**32) + F.col(c)
    links = border.join(other, ["raster_id", "row", "col", "label"]).select(name("local").alias("a"), name("local2").alias("b"))
    merged = components(links, "areas").select(F.col("id").alias("mf_id"), F.col("component").alias("mf_c"))
    joined = found.withColumn("mf_id", name("local")).join(merged, "mf_id", "left")
    whole = F.coalesce("mf_c", "mf_id") - F.col("raster_id") * F.lit(2**32)
    return joined.select("raster_id", "row", "col", "label", whole.alias("component"))


def area_stats(areas: DataFrame, px: float, py: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(raster_id, component, raster_val, n, area, extent) of each area."""
    stats = areas.groupBy("raster_id", "component").agg(F.min("label").alias("raster_val"), F.count("*").alias("n"), *[f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("row", "col")])
    x1, x2 = F.lit(x0) + F.col("lo_col") * px, F.lit(x0) + (F.col("hi_col") + 1) * px
    y1, y2 = F.lit(y0) + F.col("lo_row") * py, F.lit(y0) + (F.col("hi_row") + 1) * py
    extent = F.struct(F.least(x1, x2).alias("xmin"), F.least(y1, y2).alias("ymin"), F.greatest(x1, x2).alias("xmax"), F.greatest(y1, y2).alias("ymax"))
    return stats.select("raster_id", "component", "raster_val", "n", (F.col("n") * abs(px * py)).alias("area"), extent.alias("extent"))


def min_surface_filter(stats: DataFrame, least: float, value: int | None = None) -> DataFrame:
    """Areas of more than ``least`` thousand square metres; of label ``value`` only, where given."""
    big = stats.filter(F.col("area") / 1000 > least)
    return big if value is None else big.filter(F.col("raster_val") == value)


def outline_edges(areas: DataFrame) -> DataFrame:
    """(raster_id, component, r, c, d): cell sides whose neighbour is in another area, from their start, with the area on the left; d is 0 east, 1 south, 2 west, 3 north."""
    sides = [(-1, 0, 0, 1, 2), (1, 0, 1, 0, 0), (0, -1, 0, 0, 1), (0, 1, 1, 1, 3)]
    steps = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dr", "dc", "r", "c", "d"), s, strict=True)]) for s in sides]))
    rows = areas.select("raster_id", "row", "col", "component", steps.alias("e")).select("raster_id", "component", (F.col("row") + F.col("e.r")).alias("r"), (F.col("col") + F.col("e.c")).alias("c"), "e.d", (F.col("row") + F.col("e.dr")).alias("nr"), (F.col("col") + F.col("e.dc")).alias("nc"))
    other = areas.select("raster_id", F.col("row").alias("nr"), F.col("col").alias("nc"), F.col("component").alias("mf_o"))
    return rows.join(other, ["raster_id", "nr", "nc"], "left").filter("mf_o is null or mf_o <> component").select("raster_id", "component", "r", "c", "d")


#: Corners of a raster have numbers below 2^29 for rows and columns, so that a side is one long.
CORNERS = 2**29


def linked_sides(sides: DataFrame) -> DataFrame:
    """Adds id, the end (r2, c2) and next, the id of the side that follows on the ring.

    Where two sides of an area leave a corner, the one to the right is taken,
    which keeps the area's own cell on its inside: rings of 4-connected areas
    are simple.
    """
    step = lambda plus, minus: F.when(F.col("d") == plus, 1).when(F.col("d") == minus, -1).otherwise(0)
    rows = sides.withColumns({"r2": F.col("r") + step(1, 3), "c2": F.col("c") + step(0, 2)})
    leaving = sides.groupBy("raster_id", "component", F.col("r").alias("r2"), F.col("c").alias("c2")).agg(F.count("*").alias("n"), F.min("d").alias("only"))
    rows = rows.join(leaving, ["raster_id", "component", "r2", "c2"]).withColumn("d2", F.when(F.col("n") == 1, F.col("only")).otherwise((F.col("d") + 1) % 4))
    name = lambda r, c, d: (F.col(r).cast("long") * CORNERS + F.col(c)) * 4 + F.col(d)
    return rows.select("raster_id", "component", "r", "c", "d", "r2", "c2", "d2", name("r", "c", "d").alias("id"), name("r2", "c2", "d2").alias("next"))


def _chained(nxt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last of the chain, steps to it, in a closed ring) for links to other places or -1; rings are opened before their least place."""
    def walk(link):
        jump, steps = link.copy(), (link >= 0).astype(np.int64)
        least = np.arange(len(link))
        for _ in range(max(1, len(link)).bit_length() + 1):
            on = jump >= 0
            steps[on] += steps[jump[on]]
            least[on] = np.minimum(least[on], least[jump[on]])
            jump[on] = jump[jump[on]]
        return jump, steps, least

    jump, _, least = walk(nxt)
    ring = jump >= 0
    link = np.where(ring & (nxt >= 0) & (nxt == least), -1, nxt)
    _, steps, _ = walk(link)
    # the last of each chain, found by following the links once more with the ends held in place
    last = np.where(link < 0, np.arange(len(link)), link)
    for _ in range(max(1, len(link)).bit_length() + 1):
        last = last[last]
    return last, steps, ring


def _tile_pieces(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sides of a tile in pieces of rings: (raster_id, component, piece, next, closed, twice, pr, pc), next the piece in another tile that follows."""
    ids = pdf["id"].to_numpy()
    order = np.argsort(ids)
    at = np.searchsorted(ids, pdf["next"].to_numpy(), sorter=order)
    found = order[np.minimum(at, len(ids) - 1)]
    same = (ids[found] == pdf["next"].to_numpy()) & (pdf["component"].to_numpy()[found] == pdf["component"].to_numpy())
    last, steps, ring = _chained(np.where(same, found, -1))
    pdf = pdf.assign(last=last, steps=steps, closed=ring, twice=pdf["c"] * pdf["r2"] - pdf["c2"] * pdf["r"], turn=pdf["d"] != pdf["d2"]).sort_values(["last", "steps"], ascending=[True, False], kind="stable")
    cut = np.flatnonzero(np.concatenate([[True], pdf["last"].to_numpy()[1:] != pdf["last"].to_numpy()[:-1]]))
    ends = np.append(cut[1:], len(pdf))
    turn, r2, c2 = (pdf[c].to_numpy() for c in ("turn", "r2", "c2"))
    kept = lambda v: [v[s:e][turn[s:e]].tolist() for s, e in zip(cut, ends, strict=True)]
    first = pdf.iloc[cut]
    return pd.DataFrame({"raster_id": first["raster_id"].to_numpy(), "component": first["component"].to_numpy(), "piece": first["id"].to_numpy(), "next": pdf["next"].to_numpy()[ends - 1], "closed": first["closed"].to_numpy(), "twice": np.add.reduceat(pdf["twice"].to_numpy(), cut), "pr": kept(r2), "pc": kept(c2)})


def ring_pieces(areas: DataFrame, tile: int = TILE) -> DataFrame:
    """(raster_id, component, ring, place, twice, pr, pc): the outlines of areas in pieces, one for each tile that a ring passes, ``place`` in order along the ring.

    Sides are linked at their corners, chained within tiles, and the pieces
    over tile borders by pointer doubling: no group is larger than a tile.
    ``twice`` is the piece's share of twice the ring's area; pr, pc are its
    corners where the ring turns.
    """
    sides = linked_sides(outline_edges(areas)).withColumns({"tr": F.floor(F.col("r") / tile), "tc": F.floor(F.col("c") / tile)})
    schema = "raster_id long, component long, piece long, next long, closed boolean, twice long, pr array<long>, pc array<long>"
    columns = ["raster_id", "component", "id", "next", "r", "c", "d", "r2", "c2", "d2"]
    pieces = materialize(sides.withColumns({c: F.col(c).cast("long") for c in columns}).groupBy("raster_id", "tr", "tc").applyInPandas(lambda pdf: _tile_pieces(pdf[columns]), schema), "pieces")
    key = ["raster_id", "component"]
    # the least piece ahead within the span, and how far ahead it is; the span doubles
    state = pieces.filter("not closed").select(*key, "piece", F.col("next").alias("jump"), F.col("piece").alias("least"), F.lit(0).cast("long").alias("ahead"))
    span = 1
    while True:
        then = state.select(*key, F.col("piece").alias("jump"), F.col("jump").alias("jump2"), F.col("least").alias("least2"), F.col("ahead").alias("ahead2"))
        lower = F.col("least2") < F.col("least")
        new = state.join(then, [*key, "jump"]).select(*key, "piece", F.col("jump2").alias("jump"), F.least("least", "least2").alias("least"), F.when(lower, F.col("ahead2") + span).otherwise(F.col("ahead")).alias("ahead"), lower.alias("moved"))
        state, span = materialize(new, "rings"), 2 * span
        if state.filter("moved").isEmpty():
            break
    ring = state.select(*key, "piece", F.col("least").alias("ring"), (-F.col("ahead")).alias("place"))
    joined = pieces.join(ring, [*key, "piece"], "left")
    # the least piece comes first, then those that are farthest ahead of it
    place = F.when(F.col("place") == 0, F.lit(-(2**62))).otherwise(F.coalesce("place", F.lit(0)))
    return joined.select(*key, F.coalesce("ring", "piece").alias("ring"), place.alias("place"), "twice", "pr", "pc")


def polygonize(areas: DataFrame, px: float, py: float, x0: float = 0.0, y0: float = 0.0, tile: int = TILE) -> DataFrame:
    """(raster_id, component, rings): outlines in map units; the first ring is the outer one, counter-clockwise, holes are clockwise.

    An area's row holds its corners by definition; ``ring_pieces`` has them in rows of bounded size.
    """
    corner = F.zip_with("pr", "pc", lambda r, c: F.struct((F.lit(float(x0)) + c * float(px)).alias("x"), (F.lit(float(y0)) + r * float(py)).alias("y")))
    pieces = ring_pieces(areas, tile).select("raster_id", "component", "ring", "place", "twice", corner.alias("p"))
    rings = pieces.groupBy("raster_id", "component", "ring").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "p"))), lambda s: s["p"])).alias("p"), (F.sum("twice") * (1 if px * py > 0 else -1)).alias("twice"))
    sized = F.array_sort(F.collect_list(F.struct((-F.abs("twice")).alias("size"), "ring", "twice", "p")))
    turned = lambda s, k: F.when((s["twice"] > 0) == (k == 0), s["p"]).otherwise(F.reverse(s["p"]))
    return rings.groupBy("raster_id", "component").agg(sized.alias("s")).select("raster_id", "component", F.transform("s", turned).alias("rings"))


def profile_position(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)

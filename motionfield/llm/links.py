"""Linking rows that share a cell, and connected components of the links.

Cells are read as sorted streams, so a cell may hold any number of rows: it is
cut into chunks of at most ``BLOCK`` rows, and chunks of one cell are compared
pair by pair in tasks of their own.  What a comparison returns is a star for
each local component, so rows out stay in proportion to rows in.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .common import materialize, partitions

__all__ = ["cell_units", "components", "first_reached", "local_labels", "units_of", "with_payload"]

BLOCK = 1024
#: Tasks that share the pairs of chunks of a cell with over BLOCK rows.
SALTS = 16


def first_reached(n: int, near) -> np.ndarray:
    """The smallest index reachable from each of ``n`` indexes; ``near(i, left)`` says which of ``left`` are linked to ``i``."""
    label, left = np.arange(n), np.arange(n)
    while len(left):
        root, left = left[0], left[1:]
        todo = [root]
        while todo and len(left):
            hit = near(todo.pop(), left)
            label[left[hit]] = root
            todo += left[hit].tolist()
            left = left[~hit]
    return label


def alike(k: np.ndarray, g: np.ndarray, w: np.ndarray, radius: int) -> np.ndarray:
    """For each row of runs of ``k`` the first row of its run that it reaches by words ``w`` of ``radius`` or fewer differing bits.

    Runs whose ``g`` are all one value aren't compared.
    """
    part = np.arange(len(k))
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size, some = np.diff(np.append(cut, len(k))), np.minimum.reduceat(g, cut) < np.maximum.reduceat(g, cut)
    two = cut[some & (size == 2)]
    two = two[np.bitwise_count(w[two] ^ w[two + 1]) <= radius]
    part[two + 1] = two
    more = some & (size > 2)
    for s, n in zip(cut[more].tolist(), size[more].tolist(), strict=True):
        word = w[s : s + n]
        part[s : s + n] = s + first_reached(n, lambda i, left, word=word: np.bitwise_count(word[left] ^ word[i]) <= radius)
    return part


def _gather(block: int, bits: int = 0, radius: int = 0):
    def run(batches):
        key, val, group, chunk = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), 0
        word = np.empty(0, np.int64)

        def out(k, v, g, w, first_chunk, always):
            same = k
            if bits and not always:
                # the rest of a cell of several chunks stays whole
                rest = int(np.searchsorted(k != k[0], True)) if first_chunk else 0
                part = np.zeros(len(k), np.int64)
                if rest < len(k):
                    part[rest:] = rest + alike(k[rest:], g[rest:], w[rest:], radius)
                order = np.argsort(part, kind="stable")
                k, v, g, same = k[order], v[order], g[order], part[order]
            cut = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
            size = np.diff(np.append(cut, len(k)))
            chunks = np.zeros(len(cut), np.int32)
            chunks[0] = first_chunk
            low, high = np.minimum.reduceat(g, cut), np.maximum.reduceat(g, cut)
            keep = low < high
            keep[0] |= first_chunk > 0 or always
            offsets = np.zeros(int(keep.sum()) + 1, np.int32)
            np.cumsum(size[keep], out=offsets[1:])
            many = chunks[keep] > 0
            if always:
                many[:] = True
            return pa.RecordBatch.from_arrays(
                [pa.array(k[cut][keep]), pa.array(chunks[keep]), pa.array(many), pa.array(low[keep]), pa.array(high[keep]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(v[np.repeat(keep, size)]))],
                ["cell", "chunk", "many", "low", "high", "ids"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            key = np.concatenate([key, cell >> bits])
            word = np.concatenate([word, cell & ((1 << bits) - 1)])
            val = np.concatenate([val, batch.column("id").to_numpy(zero_copy_only=False)])
            group = np.concatenate([group, batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)])
            cut = int(np.flatnonzero(key == key[-1])[0])
            if cut:
                # the carried cell ended: a long one may still be over the block size
                yield out(key[:cut], val[:cut], group[:cut], word[:cut], chunk, False)
                key, val, group, word, chunk = key[cut:], val[cut:], group[cut:], word[cut:], 0
            while len(key) > block:
                yield out(key[:block], val[:block], group[:block], word[:block], chunk, True)
                key, val, group, word, chunk = key[block:], val[block:], group[block:], word[block:], chunk + 1
        if len(key):
            yield out(key, val, group, word, chunk, False)

    return run


def cell_units(cells: DataFrame, tag: str, block: int = BLOCK, bits: int = 0, radius: int = 0) -> DataFrame:
    """(cell, id) rows to units (unit, left ids, right ids) that hold every pair of a cell exactly once.

    ``right`` is null where the pairs are those within ``left``.  Ids of a cell
    must be distinct.  Cells of one row give nothing.  With a column ``known``
    units whose rows all have one value of it are left out.  The low ``bits``
    of ``cell`` are not the cell's but a word of the row's: a cell that fits a
    block falls into the groups that ``radius`` or fewer differing bits of
    their words hold together.
    """
    spark = cells.sparkSession
    place = F.shiftright("cell", bits) if bits else F.col("cell")
    grouped = materialize(
        cells.select("cell", "id", *["known"] * ("known" in cells.columns)).repartition(partitions(spark), place).sortWithinPartitions(place, "id").mapInArrow(_gather(block, bits, radius), "cell long, chunk int, many boolean, low long, high long, ids array<long>"),
        f"{tag}-cells",
    )
    within = grouped.filter("low < high").select("cell", F.col("ids").alias("left"), F.lit(None).cast("array<long>").alias("right"))
    big = grouped.filter("many").select("cell", "chunk", "low", "high", "ids")
    # the pairs of a cell's chunks are dealt to SALTS tasks by the right chunk
    other = big.select("cell", (F.col("chunk") % SALTS).alias("salt"), F.col("chunk").alias("chunk2"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.col("ids").alias("right"))
    left = big.withColumnRenamed("ids", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    across = left.join(other, ["cell", "salt"]).filter("chunk < chunk2 and least(low, low2) < greatest(high, high2)").select("cell", "left", "right")
    return within.unionByName(across)


def with_payload(units: DataFrame, payload: DataFrame, tag: str) -> DataFrame:
    """Adds what the comparison reads: (cell, members array<struct<side, id, load>>).

    ``payload`` has (id, load), a row for each id.
    """
    named = materialize(units.withColumn("unit", F.monotonically_increasing_id()), f"{tag}-units")
    rows = named.select("unit", "cell", F.lit(0).alias("side"), F.explode("left").alias("id")).unionByName(named.filter("right is not null").select("unit", "cell", F.lit(1).alias("side"), F.explode("right").alias("id")))
    return rows.join(payload, "id").groupBy("unit", "cell").agg(F.collect_list(F.struct("side", "id", "load")).alias("members")).select("cell", "members")


def units_of(batch):
    """(cell, side, ids, load) of each unit of a batch, one at a time; load is an Arrow array."""
    cells, column = batch.column("cell").to_pylist(), batch.column("members")
    offsets = column.offsets.to_numpy() - column.offsets[0].as_py()
    flat = column.flatten()
    side, ids, load = flat.field("side").to_numpy(), flat.field("id").to_numpy(), flat.field("load")
    for k, cell in enumerate(cells):
        s, e = int(offsets[k]), int(offsets[k + 1])
        order = np.lexsort((ids[s:e], side[s:e]))
        yield cell, side[s:e][order], ids[s:e][order], load.slice(s, e - s).take(pa.array(order))


def local_labels(adjacent: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each index of a symmetric boolean matrix."""
    n = len(adjacent)
    label = np.arange(n)
    while True:
        best = np.where(adjacent, label[None, :], n).min(axis=1)
        new = np.minimum(label, best)
        new = new[new]
        if (new == label).all():
            return label
        label = new

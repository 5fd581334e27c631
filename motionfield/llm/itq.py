"""Embedding near-duplicates by iterative quantisation.

Rotations of the principal axes are learned so that vectors lie close to the
corners of the binary cube, with a threshold at the median of each bit so that
codes are balanced.  The codes are cut into tables of ``table_bits`` bits
(multi-index hashing).  A table is probed within a Hamming radius of 1: its
bits are cut into ``GROUPS`` groups, and codes that differ in one bit, or in
any bits of one group, agree in a key made of the other groups.  Candidates
are ranked again by the cosine of the original vectors.

How far apart the codes of a pair at the threshold lie depends on the vectors:
the more they have in common, the more a pair of a given cosine differs in what
is left.  So the tables are calibrated: vectors of the sample are moved to a
cosine of exactly the threshold, and the number and width of tables are the
cheapest that still find the wanted share of these pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .links import cell_units, components, local_labels, units_of, with_payload
from .simhash import mixed


#: Groups of a table's bits, of which one is left out of each key.
GROUPS = 4
#: Widths of tables to choose from, the most bits of a code, and the least vectors of one length that codes are learned from (fewer are all compared).
WIDTHS = (32, 28, 24, 20, 16, 12, 8)
MOST_BITS = 1024
LEARNED_FROM = 256
#: Work for a row of a table, and for the vector that is sent along where its cell has others, in units of one comparison of two vectors.
ROW_COST, SEND_COST = 100.0, 2500.0


class Itq:
    """Learned codes: ``fit`` on a sample of unit vectors, ``codes`` for any; a code has ``tables`` times ``table_bits`` bits."""

    def __init__(self, tables: int, table_bits: int):
        self.tables, self.table_bits = tables, table_bits

    def fit(self, x: np.ndarray, rounds: int = 20, seed: int = 11, turned: int = 4096) -> Itq:
        """Mean and thresholds of all of ``x``, rotations of at most ``turned`` of its vectors."""
        d = x.shape[1]
        self.mean = x.mean(axis=0)
        v = (x - self.mean)[np.random.default_rng(seed + 1).permutation(len(x))[:turned]]
        axes = np.linalg.eigh(v.T @ v)[1][:, ::-1]
        v, rng, maps = v @ axes, np.random.default_rng(seed), []
        for _ in range(-(-self.tables * self.table_bits // d)):
            r = np.linalg.qr(rng.normal(size=(d, d)))[0]
            for _ in range(rounds):
                u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (u @ w).T
            maps.append(axes @ r)
        self.maps = np.concatenate(maps, axis=1)[:, : self.tables * self.table_bits]
        # between two projections, so that no fitted vector lies on a threshold
        self.cut, low = np.empty(self.maps.shape[1]), (len(x) - 1) // 2
        for at in range(0, self.maps.shape[1], 64):  # a few bits at a time, for memory
            ranked = np.sort((x - self.mean) @ self.maps[:, at : at + 64], axis=0)
            self.cut[at : at + 64] = (ranked[low] + ranked[min(len(x) - 1, low + 1)]) / 2
        return self

    def calibrated(self, x: np.ndarray, rows: float, least: float, recall: float, most: int = 2000, seed: int = 5) -> Itq:
        """The model with the cheapest tables for ``rows`` vectors that find ``recall`` of the pairs at a cosine of ``least``.

        Half of the pairs differ in any direction, half as vectors of the
        sample differ from each other; each half has to be found.
        """
        rng = np.random.default_rng(seed)
        x = x[rng.permutation(len(x))[:most]]
        moved = [rng.normal(size=x.shape), x[rng.permutation(len(x))] - x[rng.permutation(len(x))] + 1e-9 * rng.normal(size=x.shape)]
        bit = ((x - self.mean) @ self.maps > self.cut)
        differ = []
        for side in moved:
            side = side - (side * x).sum(axis=1)[:, None] * x
            y = least * x + np.sqrt(max(0.0, 1 - least * least)) * side / np.maximum(np.linalg.norm(side, axis=1), 1e-300)[:, None]
            differ.append(bit != ((y - self.mean) @ self.maps > self.cut))
        best = (np.inf, 0, 0)
        for width in WIDTHS:
            tables = self.maps.shape[1] // width
            cut = lambda b: b[:, : tables * width].reshape(len(x), tables, width)  # noqa: E731, B023
            edge = np.linspace(0, width, GROUPS + 1).astype(np.int64)
            off = [np.add.reduceat(cut(d), edge[:-1], axis=2) > 0 for d in differ]
            # a pair meets in a table if at most one group differs
            met = np.stack([np.maximum.accumulate(o.sum(axis=2) <= 1, axis=1).mean(axis=0) for o in off]).min(axis=0)
            enough = np.flatnonzero(met >= recall)
            tables = int(enough[0]) + 1 if len(enough) else tables
            words = cut(bit)[:, :tables] @ (np.uint64(1) << np.arange(width, dtype=np.uint64))
            keys = table_keys(words, width)
            # the share of other vectors that a vector meets in a key
            share = np.mean([(np.square(np.unique(keys[:, k], return_counts=True)[1].astype(float)).sum() - len(x)) / (len(x) * max(1, len(x) - 1)) for k in range(keys.shape[1])])
            cost = keys.shape[1] * (ROW_COST + SEND_COST * min(1.0, rows * share) + rows * share) * (1.0 if len(enough) else 1e6 * (2 - met[-1]))
            best = min(best, (cost, width, tables))
        self.table_bits, self.tables = best[1:]
        self.maps, self.cut = self.maps[:, : self.tables * self.table_bits], self.cut[: self.tables * self.table_bits]
        return self

    def codes(self, x: np.ndarray) -> np.ndarray:
        """The code of each vector: a 64-bit word for each table."""
        bit = ((x - self.mean) @ self.maps > self.cut).reshape(len(x), self.tables, self.table_bits)
        return bit @ (np.uint64(1) << np.arange(self.table_bits, dtype=np.uint64))


def table_keys(codes: np.ndarray, table_bits: int) -> np.ndarray:
    """The keys of codes: for each table the words with one group of bits left out, not yet mixed."""
    edge = np.linspace(0, table_bits, GROUPS + 1).astype(np.int64)
    masks = np.array([(1 << table_bits) - 1 ^ ((1 << int(hi)) - (1 << int(lo))) for lo, hi in zip(edge[:-1], edge[1:], strict=True)], np.uint64)
    keys = codes[:, :, None] & masks
    number = np.arange(1, codes.shape[1] * GROUPS + 1, dtype=np.uint64).reshape(codes.shape[1], GROUPS)
    return (keys | number << np.uint64(table_bits)).reshape(len(codes), -1)


def cell_of(key: np.ndarray, size) -> np.ndarray:
    """A 64-bit cell for each key: one to one among vectors of one size."""
    return mixed(mixed(key, 1) + np.asarray(size, np.uint64), 1).view(np.int64)


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    # scaled first: squares of very large or small components stay within range
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _clean(kind):
    def run(batches):
        """(id, raw, size): the vector's bytes, null where it can link with nothing."""
        for b in batches:
            raw, sizes = [], []
            for v in b.column("v").to_pylist():
                ok = v and all(c is not None for c in v)
                x = np.array(v, kind) + 0.0 if ok else None  # one zero
                ok = ok and bool(np.isfinite(x).all()) and bool(x.any())
                raw.append(x.tobytes() if ok else None)
                sizes.append(len(v) if ok else None)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(raw, pa.binary()), pa.array(sizes, pa.int32())], ["id", "raw", "size"])

    return run


def _code(models, kind):
    """Adds each vector's code, in words of 64 bits; rows of a batch may differ in size."""

    def run(batches):
        for b in batches:
            sizes, raw, out = b.column("size").to_numpy(zero_copy_only=False), b.column("raw").to_pylist(), [b""] * b.num_rows
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size).tolist()
                if size in models:
                    for k, code in zip(rows, models[size].codes(unit_rows([raw[k] for k in rows], kind)), strict=True):
                        out[k] = code.astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "code"])

    return run


def _cells(widths):
    def run(batches):
        for b in batches:
            code, sizes, ids = b.column("code").to_pylist(), b.column("size").to_numpy(zero_copy_only=False), b.column("id").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                if size in widths:
                    key = table_keys(np.frombuffer(b"".join(code[k] for k in at.tolist()), np.uint64).reshape(len(at), -1), widths[size])
                    cell = cell_of(key, size)
                else:
                    # too few of this size for codes: all in one cell
                    cell = mixed(np.full((len(at), 1), size, np.uint64), 2).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), pa.array(np.repeat(ids[at], cell.shape[1]))], ["cell", "id"])

    return run


def _compare(widths, least, kind):
    def run(batches):
        for b in batches:
            out = [[], [], []]
            for cell, side, ids, load in units_of(b):
                raw, many = load.field("raw").to_pylist(), load.field("n").to_numpy()
                code, sizes = load.field("code").to_pylist(), np.array([len(x) for x in raw])
                # different cells may have one hash: only vectors of one size are compared
                for size in np.unique(sizes).tolist():
                    at = np.flatnonzero(sizes == size)
                    x = unit_rows([raw[k] for k in at.tolist()], kind)
                    near = x @ x.T >= least
                    np.fill_diagonal(near, False)
                    if side.any():
                        near &= side[at][:, None] != side[at][None, :]
                    hot = np.flatnonzero(near.any(axis=1))
                    if not len(hot):
                        continue
                    near, who = near[np.ix_(hot, hot)], at[hot]
                    out[0].append(ids[who]), out[1].append(ids[who][local_labels(near)])
                    if code[who[0]]:
                        # a pair counts in the first cell that both share; words and cells of one size correspond
                        key = table_keys(np.frombuffer(b"".join(code[k] for k in who.tolist()), np.uint64).reshape(len(who), -1), widths[size // np.dtype(kind).itemsize])
                        t = int(np.flatnonzero((cell_of(key, size // np.dtype(kind).itemsize) == cell).all(axis=0))[0])
                        for u in range(t):
                            near &= key[:, u][:, None] != key[:, u][None, :]
                    out[2].append(near @ many[who])
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["a", "b", "links"])

    return run


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, least: float = 0.95, recall: float = 0.985, fit_rows: int = 20_000) -> DataFrame:
    """(id, n_links, component): a row for each row of ``vectors``.

    Links are found pairs with a cosine of ``least`` or more, in double
    precision.  Equal vectors are one class: they link with each other and
    enter the tables once.  Codes are learned, and their tables calibrated to
    find ``recall`` of the pairs at ``least``, on at most ``fit_rows`` vectors
    (``LEARNED_FROM`` of each length, if there are many lengths); all vectors
    are indexed and looked up.  A code is formed once and travels with its
    vector.  Of a length with fewer vectors than codes are learned from all
    are compared.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing; vectors of different lengths don't link; a null id
    takes part in no minimum; rows that repeat link with each other; other
    columns are not read; an empty table gives an empty result.
    """
    kind = "<f8" if "double" in vectors.schema[vector_col].dataType.simpleString() else "<f4"
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(_clean(kind), "id long, raw binary, size int")
    rows = materialize(rows, "itq-rows", "snappy")
    classes = rows.filter("size is not null").groupBy("size", "raw").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = materialize(classes.withColumn("id", F.monotonically_increasing_id()), "itq-classes", "snappy")
    counts = classes.groupBy("size").count().filter(F.col("count") >= LEARNED_FROM).orderBy("size").collect()
    models = {}
    for size, rows_of in counts:
        of = classes.filter(F.col("size") == size).select("raw", F.xxhash64("raw").alias("h")).orderBy("h", "raw").limit(max(LEARNED_FROM, fit_rows // len(counts)))
        sample = unit_rows([bytes(r.raw) for r in of.select("raw").collect()], kind)
        models[size] = Itq(1, MOST_BITS).fit(sample).calibrated(sample, rows_of, least, recall)
    widths = {size: m.table_bits for size, m in models.items()}
    coded = materialize(classes.mapInArrow(_code(models, kind), "size int, raw binary, least long, n long, id long, code binary"), "itq-codes", "snappy")
    units = cell_units(coded.select("id", "size", "code").mapInArrow(_cells(widths), "cell long, id long"), "itq")
    load = coded.select("id", F.struct("raw", "n", "code").alias("load"))
    found = materialize(with_payload(units, load, "itq").mapInArrow(_compare(widths, least, kind), "a long, b long, links long"), "itq-links")
    linked = components(found.select("a", "b"), "itq")
    links = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "id")
    named = coded.select("raw", "id", "least", "n").join(linked, "id", "left").join(links, "id", "left").select("raw", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("c"))
    top = named.groupBy("c").agg(F.min("least").alias("component"))
    of_class = named.join(top, "c").select("raw", "n_links", "component")
    there = rows.filter("size is not null").join(of_class, "raw").select("id", "n_links", "component")
    return there.unionByName(rows.filter("size is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))

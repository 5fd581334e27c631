"""The values of rasters in order: buckets with prefix sums, quantiles and clusters by look-up.

The distinct values of each raster and their counts are range-partitioned by
raster and value, and cut into buckets of at most ``BUCKET`` values.  A bucket
is a row with its values and their cumulative counts and sums; a raster of any
size is known by its buckets' bounds, counts and sums, and what is asked of the
values themselves is looked up in the few buckets that hold the answer.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

BUCKET = 4096
#: Rasters of so few buckets are handed over whole.
WHOLE = 4


def _buckets(size: int, key: str):
    def run(batches):
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, None

        def out(k, v, n):
            nonlocal number
            cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(k)], strict=True):
                for s in range(lo, hi, size):
                    x, c = v[s : min(hi, s + size)], n[s : min(hi, s + size)]
                    counts, sums = np.cumsum(c), np.cumsum(x * c)
                    yield {"g": int(k[s]), "bucket": number, "lo": x[0], "hi": x[-1], "n": counts[-1], "s": sums[-1], "vs": x, "counts": counts, "sums": sums}
                    number += 1

        def batch(rows):
            names = ["g", "bucket", "lo", "hi", "n", "s", "vs", "counts", "sums"]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds, strict=True)], names)

        for b in batches:
            new = [b.column(c).to_numpy(zero_copy_only=False) for c in ("g", "v", "n")]
            k, v, n = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new, strict=True)]
            # whole buckets of the last raster go out, the rest waits for the next batch
            last = int(np.searchsorted(k, k[-1])) if len(k) else 0
            done = last + (len(k) - last) // size * size
            if rows := list(out(k[:done], v[:done], n[:done])) if done else []:
                yield batch(rows)
            held = [x[done:] for x in (k, v, n)]
        if held is not None and (rows := list(out(*held)) if len(held[0]) else []):
            yield batch(rows)

    return run


def value_buckets(pixels: DataFrame, value: str, key: str, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame]:
    """(buckets, names): (g, bucket, lo, hi, n, s, vs, counts, sums) of the values that aren't null or NaN, and (key, g), a number for each key."""
    v = F.col(value).cast("double")
    named = pixels.filter(v.isNotNull() & ~F.isnan(v)).select(F.col(key).alias("k"), (v + F.lit(0.0)).alias("v"))
    counts = named.groupBy("k", "v").agg(F.count("*").alias("n"))
    # whole numbers are their own; other keys are hashed, and the pairs kept
    whole = dict(named.dtypes)["k"] in ("tinyint", "smallint", "int", "bigint")
    counts = counts.select("k", (F.col("k").cast("long") if whole else F.xxhash64("k")).alias("g"), "v", "n")
    tasks = int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = counts.select("g", "v", "n").repartitionByRange(tasks, "g", "v").sortWithinPartitions("g", "v")
    schema = "g long, bucket long, lo double, hi double, n long, s double, vs array<double>, counts array<long>, sums array<double>"
    buckets = materialize(ranged.mapInArrow(_buckets(bucket, key), schema), "buckets")
    keys = pixels.select(F.col(key)).distinct()
    return buckets, keys.withColumn("g", F.col(key).cast("long") if whole else F.xxhash64(key))


def quantiles(buckets: DataFrame, shares: list[float]) -> DataFrame:
    """(g, q): the quantiles of each raster, interpolated between neighbours."""
    in_order = Window.partitionBy("g").orderBy("lo")
    # a row for each bucket, without its values
    known = buckets.select("g", "bucket", "lo", "n", (F.sum("n").over(in_order) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("g")).alias("total"))
    place = lambda q: F.lit(float(q)) * (F.col("total") - 1)
    asked = F.array(*[F.struct(F.lit(i).alias("i"), r.cast("long").alias("rank"), w.alias("w")) for i, q in enumerate(shares) for r, w in ((F.floor(place(q)), 1 - (place(q) - F.floor(place(q)))), (F.floor(place(q)) + 1, place(q) - F.floor(place(q))))])
    # buckets that hold an asked rank; a rank of no weight needs none
    found = known.select("g", "bucket", "before", "n", F.explode(asked).alias("a")).filter((F.col("a.w") > 0) & (F.col("a.rank") >= F.col("before")) & (F.col("a.rank") < F.col("before") + F.col("n")))
    found = found.join(buckets.select("bucket", "vs", "counts"), "bucket")
    value = F.get("vs", F.size(F.filter("counts", lambda c: c <= F.col("a.rank") - F.col("before"))))
    each = found.groupBy("g", F.col("a.i").alias("i")).agg(F.sum(value * F.col("a.w")).alias("q"))
    return each.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))


class _Unknown(Exception):
    """A bucket's values are needed."""


class Looked:
    """A raster by its buckets, of which some have their values."""

    def __init__(self, rows: pd.DataFrame):
        rows = rows.sort_values("lo")
        self.bucket, self.lo, self.hi = (rows[c].to_numpy() for c in ("bucket", "lo", "hi"))
        self.n, self.s = np.concatenate([[0], np.cumsum(rows["n"])]), np.concatenate([[0.0], np.cumsum(rows["s"])])
        self.values = [None if v is None else (np.asarray(v), np.asarray(c), np.asarray(s)) for v, c, s in zip(rows["vs"], rows["counts"], rows["sums"], strict=True)]
        self.needed: set[int] = set()

    def _of(self, k: int):
        if self.values[k] is None:
            # neighbours too: bounds move little from round to round
            self.needed = {int(b) for b in self.bucket[max(0, k - 1) : k + 2]}
            raise _Unknown
        return self.values[k]

    def at(self, rank: int) -> float:
        k = int(np.searchsorted(self.n, rank, side="right")) - 1
        v, c, _ = self._of(k)
        return float(v[np.searchsorted(c, rank - self.n[k], side="right")])

    def quantile(self, q: float) -> float:
        place = q * (self.n[-1] - 1)
        low = int(np.floor(place))
        w = place - low
        return self.at(low) if w == 0 else self.at(low) * (1 - w) + self.at(low + 1) * w

    def lower(self, a: float, b: float) -> tuple[int, float]:
        """Count and sum of the values no farther from ``a`` than from ``b`` (a <= b)."""
        k = int((np.abs(self.hi - a) <= np.abs(self.hi - b)).sum())
        if k == len(self.hi) or np.abs(self.lo[k] - a) > np.abs(self.lo[k] - b):
            return self.n[k], self.s[k]
        v, c, s = self._of(k)
        i = int((np.abs(v - a) <= np.abs(v - b)).sum())
        return self.n[k] + c[i - 1], self.s[k] + s[i - 1]

    def centres(self, k: int, rounds: int) -> list[float]:
        c = [self.quantile((2 * i + 1) / (2 * k)) for i in range(k)]
        for _ in range(rounds):
            # of equal centres the first takes all
            higher = [next((b for b in c if b > a), None) for a in c[:-1]]
            n, s = zip((0, 0.0), *[(self.n[-1], self.s[-1]) if b is None else self.lower(a, b) for a, b in zip(c, higher)], (self.n[-1], self.s[-1]), strict=True)
            new = sorted((s[i + 1] - s[i]) / (n[i + 1] - n[i]) if n[i + 1] > n[i] else c[i] for i in range(k))
            if new == c:
                break
            c = new
        return c


def centres_1d(buckets: DataFrame, k: int, rounds: int) -> DataFrame:
    """(g, c): the ascending centres of each raster's values after Lloyd's rounds.

    All rounds of a raster run where its buckets' bounds, counts and sums are,
    one row for each ``BUCKET`` values.  A round that needs the values of
    buckets it doesn't have asks for them; those rasters are taken again with
    these buckets' values as well.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        known = Looked(pdf)
        try:
            c = known.centres(k, rounds)
        except _Unknown:
            c = None
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "c": [c], "needed": [sorted(known.needed)]})

    spark, done = buckets.sparkSession, []
    few = buckets.groupBy("g").agg(F.count("*").alias("n_buckets"))
    rows = buckets.join(few, "g")
    have = F.col("n_buckets") <= WHOLE
    asked = spark.createDataFrame([], "bucket long")
    while True:
        marked = rows.join(asked.withColumn("asked", F.lit(True)), "bucket", "left").withColumn("have", have | F.coalesce("asked", F.lit(False)))
        handed = marked.select("g", "bucket", "lo", "hi", "n", "s", *[F.when(F.col("have"), F.col(c)).alias(c) for c in ("vs", "counts", "sums")])
        got = materialize(handed.groupBy("g").applyInPandas(run, "g long, c array<double>, needed array<long>"), "centres")
        done.append(got.filter("c is not null").select("g", "c"))
        open_ = got.filter("c is null")
        if open_.isEmpty():
            break
        asked = materialize(asked.unionByName(open_.select(F.explode("needed").alias("bucket"))).distinct(), "asked")
        rows = rows.join(open_.select("g"), "g", "left_semi")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out

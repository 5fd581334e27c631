"""Language-model scoring: a gated recurrent network with a class-factored softmax, over corpus-wide word counts.

Counts of every token of the training documents are gathered by Spark.  The
most frequent words, up to ``VOCABULARY``, are the network's symbols; all
others are spread over ``BUCKETS`` symbols by their ending, and share a
bucket's probability in proportion to their counts plus one.  The network is
trained by truncated backpropagation in numpy, once over all training
documents: in a few rounds of growing parts of them, each dealt to shards of a
fixed size whose parameters are averaged after the round.  Documents are
scored from end to end, the state being carried from window to window.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import fresh_path
from .common import LAST_ID, bounds, crc_mod, materialize, slices, with_row_key
from .simhash import mixed
from .substring import powers

VOCABULARY = 1984
BUCKETS = 63
CLASSES = 32
HIDDEN = 16
WINDOW = 32
#: Counts looked up inside the tasks: the most frequent words, a bounded table.
HEAD = 131_072
END = 0  # symbol and hash of the end token; no word hashes to 0 for practical purposes
#: Documents scored side by side.
SIDE = 8192
#: Lanes of symbols trained side by side: one for each ``PER_LANE`` symbols that training has seen, so that small corpora get many updates.
LANES, PER_LANE = (16, 256), 8192
#: Symbols of a lane between two cuts, and of a shard (about).
LANE, SHARD = 4096, 4_000_000
#: Rounds of training: the first takes 1/32 of the documents, the second as many, each further one twice as many.
ROUNDS = 6


ODD = np.uint64(0x9E3779B97F4A7C15)


def ending(byte: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """0 .. BUCKETS - 1 for each word, by its last three bytes."""
    key = np.zeros(len(end), np.uint64)
    for k in (1, 2, 3):
        there = end - k >= begin
        key = key * np.uint64(257) + np.where(there, byte[np.maximum(end - k, 0)] + np.uint64(1), np.uint64(0))
    return (mixed(key, 1) % np.uint64(BUCKETS)).astype(np.int8)


def word_hashes(distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash, bucket) of each word of a string array without nulls: a polynomial of its bytes modulo 2^64, mixed."""
    edge = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset : distinct.offset + len(distinct) + 1].astype(np.int64)
    byte = np.frombuffer(distinct.buffers()[2], np.uint8)[edge[0] : edge[-1]].astype(np.uint64) if len(distinct) and edge[-1] > edge[0] else np.zeros(1, np.uint64)
    begin, end = edge[:-1] - edge[0], edge[1:] - edge[0]
    power, back = powers(ODD, len(byte) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((byte + np.uint64(1)) * power[: len(byte)], dtype=np.uint64)])
        return mixed((total[end] - total[begin]) * back[begin], 1), ending(byte, begin, end)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word among them, words of each text); words as by ``ascii_words``."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    encoded, at = split.flatten().dictionary_encode(), bounds(np.diff(split.offsets.to_numpy()))
    distinct, number = encoded.dictionary, encoded.indices.to_numpy()
    # blanks at an end of a text give empty words
    none = pc.index(distinct, "").as_py()
    if none >= 0:
        full = number != none
        at, number = bounds(full)[at], number[full]
    return distinct, number, np.diff(at)


# ---- counts ----------------------------------------------------------------------


def _count(batches):
    held, size = [], 0

    def merged():
        h, c, b = (np.concatenate(x) for x in zip(*held, strict=True))
        h, first, back = np.unique(h, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.bincount(back, c).astype(np.int64)), pa.array(b[first])], ["h", "c", "bucket"])

    for batch in slices(batches, 8 << 20):
        distinct, number, sizes = split_words(batch.column("text"))
        h, bucket = word_hashes(distinct)
        count = np.bincount(number, minlength=len(h))
        there = count > 0
        held += [(h[there], count[there], bucket[there]), (np.zeros(1, np.uint64), np.array([len(sizes)]), np.array([-1], np.int8))]
        size += len(h)
        if size > 2_000_000:
            yield merged()
            held, size = [], 0
    if held:
        yield merged()


def token_counts(texts: DataFrame) -> DataFrame:
    """(h, bucket, c): how often each word occurs in ``text``, by its hash; bucket -1 is the end token, once a row."""
    return texts.select("text").mapInArrow(_count, "h long, c long, bucket byte").groupBy("h", "bucket").agg(F.sum("c").alias("c"))


class Symbols:
    """What tasks need of the counts: symbols of the network, counts of the head, totals of the buckets' tails."""

    def __init__(self, head: pd.DataFrame, tail: dict[int, tuple[int, int]], tokens: int, distinct: int):
        h = head["h"].to_numpy(np.int64).view(np.uint64)
        c, b = head["c"].to_numpy(np.int64), head["bucket"].to_numpy(np.int8)
        rank = np.lexsort((h, -c))
        words = rank[b[rank] >= 0][:VOCABULARY]
        symbol = np.full(len(h), -1, np.int32)
        symbol[words] = np.arange(1, len(words) + 1)
        symbol[b < 0] = END
        order = np.argsort(h)
        self.h, self.c, self.symbol = h[order], c[order], symbol[order]
        self.words, self.tokens, self.distinct = len(words), tokens, distinct
        # counts and kinds of all words that are not symbols, by bucket
        rest = (symbol < 0) & (b >= 0)
        self.bucket_tokens = np.bincount(b[rest], c[rest], BUCKETS)[:BUCKETS] + np.array([tail.get(k, (0, 0))[0] for k in range(BUCKETS)])
        self.bucket_kinds = np.bincount(b[rest], minlength=BUCKETS)[:BUCKETS] + np.array([tail.get(k, (0, 0))[1] for k in range(BUCKETS)])
        mass = np.zeros(self.size)
        mass[symbol[symbol >= 0]] = c[symbol >= 0]
        mass[1 + self.words :] = self.bucket_tokens
        # symbols in order of frequency, dealt to classes of about equal mass but equal size
        self.mass = mass
        by = np.argsort(-mass, kind="stable")
        per = -(-self.size // CLASSES)
        self.place = np.empty(self.size, np.int64)
        self.place[by] = np.arange(self.size)
        self.per = per

    @property
    def size(self) -> int:
        return 1 + self.words + BUCKETS

    def look_up(self, h: np.ndarray, bucket: np.ndarray):
        """(symbol, count, known): count 0 where the head doesn't have the word, known False there."""
        at = np.minimum(np.searchsorted(self.h, h), max(0, len(self.h) - 1))
        found = self.h[at] == h if len(self.h) else np.zeros(len(h), bool)
        symbol = np.where(found, self.symbol[at] if len(self.h) else -1, -1)
        symbol = np.where(symbol < 0, 1 + self.words + bucket.astype(np.int64), symbol)
        return symbol, np.where(found, self.c[at] if len(self.h) else 0, 0), found


# ---- network ---------------------------------------------------------------------


def _sigmoid(x):
    """In place."""
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


class Gru:
    """Predicts each symbol from those before it: P(class | state) * P(symbol | class, state)."""

    def __init__(self, size: int, place: np.ndarray, per: int, mass: np.ndarray | None = None, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.size, self.per, self.classes = size, per, -(-size // per)
        self.cls, self.within = (place // per).astype(np.int16), (place % per).astype(np.int64)
        k = HIDDEN
        init = lambda *s: (rng.normal(size=s) * 0.1).astype(np.float32)
        #: X: a symbol's part of update gate, reset gate and new state; U, H: the state's; C, W: class and symbol.
        self.p = {"X": init(3, size, k), "U": init(2, k, k), "H": init(k, k), "C": init(k, self.classes), "c": np.zeros(self.classes, np.float32), "W": init(self.classes, k, per), "w": np.zeros((self.classes, per), np.float32)}
        self.m2 = {n: np.full_like(v, 1e-4) for n, v in self.p.items()}
        # places of the last class that no symbol has
        self.void = np.ones((self.classes, per), bool)
        self.void[self.cls, self.within] = False
        if mass is not None:
            share = np.zeros((self.classes, per))
            share[self.cls, self.within] = mass + 1
            share /= share.sum()
            self.p["c"][:] = np.log(share.sum(axis=1))
            self.p["w"][:] = np.log(np.maximum(share / share.sum(axis=1, keepdims=True), 1e-30))
        self.p["w"][self.void] = -1e9

    def step(self, a: np.ndarray, h: np.ndarray):
        """The next state; ``a``: rows of X for the symbols, overwritten by the gates and the new state's proposal."""
        zr, n = a[:2], a[2]
        zr += np.matmul(h, self.p["U"])
        _sigmoid(zr)
        rh = zr[1] * h
        n += rh @ self.p["H"]
        np.tanh(n, out=n)
        new = n - h
        new *= zr[0]
        new += h
        return new, rh

    def by_class(self, h: np.ndarray, symbol: np.ndarray):
        """(order, class edges, states in order, places within a class in order)."""
        cls = self.cls[symbol]
        order = np.argsort(cls, kind="stable")
        edge = np.zeros(self.classes + 1, np.int64)
        np.cumsum(np.bincount(cls, minlength=self.classes), out=edge[1:])
        return order, edge, h[order], self.within[symbol[order]]

    def log_probs(self, h: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Natural log probability of each symbol after each state."""
        p = self.p
        order, edge, f, within = self.by_class(h, symbol)
        a = f @ p["C"]
        a += p["c"]
        out = a[np.arange(len(f)), np.repeat(np.arange(self.classes), np.diff(edge))]
        np.exp(a, out=a)
        total = a.sum(axis=1)
        for c in np.flatnonzero(edge[1:] > edge[:-1]):
            s, e = edge[c], edge[c + 1]
            b = f[s:e] @ p["W"][c]
            b += p["w"][c]
            out[s:e] += b[np.arange(e - s), within[s:e]]
            np.exp(b, out=b)
            total[s:e] *= b.sum(axis=1)
        back = np.empty(len(f), np.float32)
        back[order] = out - np.log(total)
        return back

    def score(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Natural log probability of each document; every document ends with the end symbol, which also begins it.

        Documents run side by side, longest first, at most ``SIDE`` at once; the state goes from window to window.
        """
        sizes = np.diff(starts)
        order = np.argsort(-sizes, kind="stable")
        back = np.empty(len(order))
        for at in range(0, len(order), SIDE):
            some = order[at : at + SIDE]
            back[some] = self._score_block(symbols, starts[:-1][some], sizes[some])
        return back

    def _score_block(self, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.zeros(len(size))
        h = np.zeros((len(size), HIDDEN), np.float32)
        before = np.full(len(size), END, np.int64)
        longest = int(size[0]) if len(size) else 0
        left = np.searchsorted(-size, -np.arange(longest), "left")  # documents longer than t
        for t0 in range(0, longest, WINDOW):
            states, targets = [], []
            for n in left[t0 : t0 + WINDOW].tolist():
                h, begin = h[:n], begin[:n]
                h = self.step(self.p["X"].take(before[:n], axis=1), h)[0]
                before = symbols[begin]
                states.append(h), targets.append(before)
                begin = begin + 1
            lp, at = self.log_probs(np.concatenate(states), np.concatenate(targets)), 0
            for s in states:
                out[: len(s)] += lp[at : at + len(s)]
                at += len(s)
        return out

    def train(self, symbols: np.ndarray, lanes: int, rate: float) -> int:
        """One pass of truncated backpropagation over a stream of symbols cut into ``lanes`` side by side; symbols that fill no lane are left over."""
        k, p, m2 = HIDDEN, self.p, self.m2
        length = len(symbols) // lanes
        if length < 2:
            return 0
        x = np.ascontiguousarray(symbols[: lanes * length].reshape(lanes, length).T)
        h = np.zeros((lanes, k), np.float32)
        for t0 in range(0, length - 1, WINDOW):
            ins, target = x[t0 : t0 + WINDOW][: length - 1 - t0], x[t0 + 1 : t0 + 1 + WINDOW].ravel()
            steps, total = len(ins), len(target)
            # a document doesn't see the one before it
            open_ = (ins != END).astype(np.float32)[:, :, None]
            gates = p["X"].take(ins.ravel(), axis=1).reshape(3, steps, lanes, k)
            old, new, rhs = (np.empty((steps, lanes, k), np.float32) for _ in range(3))
            for t in range(steps):
                np.multiply(h, open_[t], out=old[t])
                new[t], rhs[t] = self.step(gates[:, t], old[t])
                h = new[t]
            z, r, n = gates
            # outputs
            order, edge, f, within = self.by_class(new.reshape(total, k), target)
            grad = {}
            a = f @ p["C"]
            a += p["c"]
            np.exp(a, out=a)
            a /= a.sum(axis=1, keepdims=True)
            a[np.arange(total), np.repeat(np.arange(self.classes), np.diff(edge))] -= 1
            grad["C"], grad["c"] = f.T @ a, a.sum(axis=0)
            df = a @ p["C"].T
            grad["W"], grad["w"] = np.zeros_like(p["W"]), np.zeros_like(p["w"])
            for c in np.flatnonzero(edge[1:] > edge[:-1]):
                s, e = edge[c], edge[c + 1]
                b = f[s:e] @ p["W"][c]
                b += p["w"][c]
                np.exp(b, out=b)
                b /= b.sum(axis=1, keepdims=True)
                b[np.arange(e - s), within[s:e]] -= 1
                grad["W"][c], grad["w"][c] = f[s:e].T @ b, b.sum(axis=0)
                df[s:e] += b @ p["W"][c].T
            dnew = np.empty((total, k), np.float32)
            dnew[order] = df
            dnew = dnew.reshape(steps, lanes, k)
            # back through the steps; what doesn't depend on later steps is formed at once
            by_n, by_z, by_r, stay = z * (1 - n * n), (n - old) * z * (1 - z), old * r * (1 - r), 1 - z
            d = np.empty((3, steps, lanes, k), np.float32)
            back_u, back_h = np.ascontiguousarray(p["U"].transpose(0, 2, 1)), np.ascontiguousarray(p["H"].T)
            dh = np.zeros((lanes, k), np.float32)
            for t in range(steps - 1, -1, -1):
                dh += dnew[t]
                np.multiply(dh, by_n[t], out=d[2, t])
                drh = d[2, t] @ back_h
                np.multiply(dh, by_z[t], out=d[0, t])
                np.multiply(drh, by_r[t], out=d[1, t])
                dh *= stay[t]
                drh *= r[t]
                dh += drh
                both = np.matmul(d[:2, t], back_u)
                dh += both[0]
                dh += both[1]
                dh *= open_[t]
            flat = d.reshape(3, total, k)
            grad["H"] = rhs.reshape(total, k).T @ flat[2]
            grad["U"] = np.matmul(old.reshape(total, k).T, flat[:2])
            seen = ins.ravel()
            order = np.argsort(seen, kind="stable")
            ranked = seen[order]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
            used = ranked[first]
            gx = np.add.reduceat(flat.take(order, axis=1), first, axis=1)
            norm = math.sqrt(sum(float(np.vdot(g, g)) for g in [*grad.values(), gx]))
            scale = np.float32(min(1.0, 5.0 * total / max(norm, 1e-12)) / lanes)
            for name, g in grad.items():
                g *= scale
                m2[name] += g * g
                p[name] -= rate * g / np.sqrt(m2[name])
            gx *= scale
            moved = m2["X"][:, used] + gx * gx
            m2["X"][:, used] = moved
            p["X"][:, used] -= rate * gx / np.sqrt(moved)
            # so that no exponential overflows
            for name in ("C", "W"):
                np.clip(p[name], -4, 4, out=p[name])
            p["w"][self.void] = -1e9
        return lanes * length

    def flat(self) -> np.ndarray:
        """Parameters and the sums of squared gradients that their steps follow from."""
        return np.concatenate([x[n].ravel() for x in (self.p, self.m2) for n in sorted(self.p)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for x in (self.p, self.m2):
            for n in sorted(self.p):
                x[n] = flat[at : at + x[n].size].reshape(x[n].shape).astype(np.float32)
                at += x[n].size


def _symbol_rows(symbols):
    def run(batches):
        for b in slices(batches, 8 << 20):
            distinct, number, sizes = split_words(b.column("text"))
            s, at = symbols.look_up(*word_hashes(distinct))[0].astype("<u2")[number], bounds(sizes)
            raw = [np.append(s[i:j], np.uint16(END)).tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("turn"), pa.array(raw, pa.binary())], ["key", "turn", "symbols"])

    return run


def _train_shard(args, flat, before, rate):
    """Trains on a shard's documents as they come, block by block; ``before``: symbols seen in earlier rounds."""

    def run(batches):
        model = Gru(*args)
        model.load(flat)
        held, size, seen, shard = [], 0, 0, None

        def block(n):
            nonlocal held, size, seen
            x = np.concatenate(held).astype(np.int64)
            did = model.train(x, n, rate)
            held, size, seen = [x[did:]], len(x) - did, seen + did

        def lanes():
            return int(np.clip(2 ** int(math.log2(max(1, (before + seen) // PER_LANE))), *LANES))

        for b in batches:
            for raw, shard in zip(b.column("symbols").to_pylist(), b.column("shard").to_pylist(), strict=True):
                held.append(np.frombuffer(raw, "<u2"))
                size += len(held[-1])
                if size >= lanes() * LANE:
                    block(lanes())
        if size:
            block(max(1, min(lanes(), size // (8 * WINDOW))))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([seen], pa.int64()), pa.array([model.flat().tobytes()], pa.binary())], ["shard", "n", "params"])

    return run


def _average(batches):
    total, n, shard = None, 0, None
    for b in batches:
        for shard, k, raw in zip(b.column("shard").to_pylist(), b.column("n").to_pylist(), b.column("params").to_pylist(), strict=True):
            x = np.frombuffer(raw, np.float32).astype(np.float64) * k
            total, n = x if total is None else total + x, n + k
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32).tobytes()], pa.binary())], ["shard", "n", "params"])


TRAINED = "shard long, n long, params binary"


def fit_gru(texts: DataFrame, symbols: Symbols, *, rounds: int = ROUNDS, rate: float = 0.15, shard: int = SHARD) -> Gru:
    """Trains once on all of ``texts`` (key, text), in ``rounds`` rounds; parameters are averaged after each.

    The documents of a round and a shard follow from ``key``, and so does
    their order; the number of shards follows from the number of tokens alone.
    Averages are formed level by level, 32 to one, so the driver gets at most
    8 parameter sets a round.
    """
    args = (symbols.size, symbols.place, symbols.per, symbols.mass)
    model = Gru(*args)
    if not rounds:
        return model
    part = F.pmod(F.xxhash64("key", F.lit(9)), F.lit(2 ** (rounds - 1)))
    turn = F.when(part == 0, 0).otherwise(F.floor(F.log2(part)) + 1).cast("int")
    rows = texts.select("key", turn.alias("turn"), "text").mapInArrow(_symbol_rows(symbols), "key long, turn int, symbols binary")
    path = fresh_path(texts.sparkSession, "gru-text")
    rows.write.partitionBy("turn").option("compression", "zstd").parquet(path)
    rows = texts.sparkSession.read.schema("key long, symbols binary, turn int").parquet(path)
    before = 0
    for k in range(rounds):
        n = max(1, math.ceil(symbols.tokens * (0.5 ** (rounds - max(k, 1))) / shard))
        dealt = rows.filter(F.col("turn") == k).withColumn("shard", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(n)))
        dealt = dealt.repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions("shard", "key", "symbols").select("shard", "symbols")
        means = materialize(dealt.mapInArrow(_train_shard(args, model.flat(), before, rate), TRAINED), "gru-shards")
        while n > 8:
            n = -(-n // 32)
            means = means.withColumn("shard", F.pmod("shard", F.lit(n)))
            means = materialize(means.repartitionById(n, F.col("shard").cast("int")).sortWithinPartitions("shard", "n", "params").mapInArrow(_average, TRAINED), "gru-means")
        got = sorted(means.collect(), key=lambda r: r.shard)
        if got:
            total = sum(r.n for r in got)
            before += total
            model.load((sum(np.frombuffer(r.params, np.float32).astype(np.float64) * r.n for r in got) / total).astype(np.float32))
    return model


# ---- scoring ---------------------------------------------------------------------


def _score(model, symbols):
    """A row for each document (h null) and one for each of its words that the head doesn't have."""
    n, v = symbols.tokens, symbols.distinct

    def run(batches):
        for b in slices(batches, 16 << 20):
            distinct, number, sizes = split_words(b.column("text"))
            h, bucket = word_hashes(distinct)
            h, bucket, symbol, count, found = (x[number] for x in (h, bucket, *symbols.look_up(h, bucket)))
            starts, docs = bounds(sizes), len(sizes)
            of = np.repeat(np.arange(docs), sizes)
            ends = np.insert(symbol, starts[1:], END)
            log10 = model.score(ends, starts + np.arange(docs + 1)) / math.log(10)
            end_count = int(symbols.c[np.searchsorted(symbols.h, np.uint64(0))]) if len(symbols.h) and symbols.h[0] == 0 else 0
            base = np.bincount(of[found], np.log10(count[found] + 1.0), docs) + math.log10(end_count + 1)
            base -= (sizes + 1) * math.log10(n + v + 1)
            # words within a bucket share its probability
            shared = symbol > symbols.words
            k = bucket[shared].astype(np.int64)
            log10 += np.bincount(of[shared], np.log10(np.where(found[shared], count[shared] + 1.0, 1.0)) - np.log10(symbols.bucket_tokens[k] + symbols.bucket_kinds[k] + 1.0), docs)
            known = np.bincount(of[found], minlength=docs) + (end_count > 0)
            ids, keys = b.column("mf_id").to_numpy(zero_copy_only=False), b.column("mf_key").to_numpy(zero_copy_only=False)
            row = pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(keys), pa.nulls(docs, pa.int64()), pa.nulls(docs, pa.int64()), pa.array(sizes + 1), pa.array(known), pa.array(base), pa.array(log10)],
                ["mf_id", "mf_key", "h", "tf", "n_tokens", "n_known", "base", "score"],
            )
            yield row
            pair = np.stack([of[~found].astype(np.uint64), h[~found]])
            if pair.shape[1]:
                order = np.lexsort((pair[1], pair[0]))
                o, w = pair[0][order], pair[1][order]
                first = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (w[1:] != w[:-1])]))
                tf = np.diff(np.append(first, len(o)))
                d = o[first].astype(np.int64)
                m = len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[d]), pa.array(keys[d]), pa.array(w[first].view(np.int64)), pa.array(tf), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, pa.float64())],
                    ["mf_id", "mf_key", "h", "tf", "n_tokens", "n_known", "base", "score"],
                )

    return run


SCORED = "mf_id long, mf_key long, h long, tf long, n_tokens long, n_known long, base double, score double"


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, fold: int = 7, held: int = 2, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row for each row of ``docs``.

    Learns from rows whose crc32(id as text) modulo ``fold`` is not ``held``:
    the counts and the network, both from all of them.  ``base_score`` is the
    add-one unigram log10 probability, ``score`` the network's; an unseen
    word's share of its bucket is that of a count of 0.  Equal inputs give
    equal scores, but for the last digits, whatever the cluster.

    Null and empty texts have the end token alone; a row with a null id is
    not held out; rows that repeat get equal results, and each counts in
    training; other columns are not read; an empty table gives an empty
    result.  With nothing to learn from all words are unseen.
    """
    base = with_row_key(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    held_out = F.coalesce(crc_mod("doc_id", fold) == held, F.lit(False))
    train = base.filter(~held_out)
    counts = materialize(token_counts(train), "gru-counts")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    level = F.floor(F.log2("c") * 16).cast("int")
    least, held_rows = 0, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():  # a few hundred levels
        held_rows += r["count"]
        if held_rows > HEAD:
            least = r.level + 1
            break
    head_rows = counts.filter(level >= least).toPandas()
    if len(head_rows) and not (head_rows["bucket"] == -1).any():
        # more words than the head holds are as frequent as documents
        head_rows = pd.concat([head_rows, counts.filter("bucket = -1").toPandas()], ignore_index=True)
    # bounded by HEAD: an index of the head's hashes, to tell the tail
    spark = docs.sparkSession
    in_head = F.broadcast(spark.createDataFrame(head_rows[["h"]].astype("int64"), "h long"))
    tail = materialize(counts.join(in_head, "h", "left_anti"), "gru-tail")
    sums = {r.bucket: (int(r.c), int(r.n)) for r in tail.groupBy("bucket").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()}
    symbols = Symbols(head_rows, sums, int(tokens), int(distinct))
    model = fit_gru(train.select(F.xxhash64("mf_id", "mf_key").alias("key"), "text"), symbols, rounds=rounds)
    rows = materialize(base.select("mf_id", "mf_key", "text").mapInArrow(_score(model, symbols), SCORED), "gru-scored")
    seen = rows.filter("h is not null").select("mf_id", "mf_key", "h", "tf").join(tail.select("h", "c"), "h")
    more = seen.groupBy("mf_id", "mf_key").agg(F.sum("tf").alias("known"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("gain"))
    # rows that repeat bring their tails as often
    whole = rows.filter("h is null").groupBy("mf_id", "mf_key").agg(F.count("*").alias("copies"), F.first("n_tokens").alias("n_tokens"), F.first("n_known").alias("n_known"), F.first("base").alias("base"), F.first("score").alias("score"))
    per = whole.join(more, ["mf_id", "mf_key"], "left")
    known = F.coalesce((F.col("known") / F.col("copies")).cast("long"), F.lit(0))
    gain = F.coalesce(F.col("gain") / F.col("copies"), F.lit(0.0))
    one = per.select(
        F.when(F.col("mf_id") != F.lit(LAST_ID), F.col("mf_id")).alias("doc_id"), "copies", "n_tokens", (F.col("n_known") + known).alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("base") + gain).alias("base_score"), (F.col("score") + gain).alias("score"),
    )
    again = one.filter("copies > 1").withColumn("copy", F.explode(F.sequence(F.lit(2), F.col("copies")))).drop("copy")
    return one.unionByName(again).withColumn("held_out", held_out).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

"""Substring dedup by relative Lempel-Ziv parsing.

The reference is the corpus itself, cut into blocks by its content: the anchor
of a window of ``window`` words is the smallest hash of the ``seed``-word runs
in it, and the words of neighbouring windows with one anchor are a block.
Blocks are indexed by anchor, each with the first document and place where it
stands.  A document is parsed against the blocks that share an anchor with it,
which is every block that can hold one of its windows:

* a block that equals a reference block matches it whole;
* where an anchor has several blocks, their windows are indexed, so that
  matches also begin and end inside blocks.

Matches that continue each other in one reference are one match.  The parse
goes from left to right and always takes the match that reaches furthest from
where it stands; every match is at least ``window`` words long, and those
over the end of a factor are among the candidates for the next, so none is
lost at a factor's boundary.  Factors that touch make a duplicate span.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, bounds, materialize, slices, with_row_key

ODD = [np.uint64(0xD6E8FEB86659FD95 | 1), np.uint64(0xA0761D6478BD642F | 1)]


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` in UTF-8, unchanged."""
    return text.encode().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def run_hashes(h: np.ndarray, n: int, odd: np.uint64) -> np.ndarray:
    """Polynomial hash (mod 2^64) of every run of ``n`` values, by doubling."""
    out, done, power, at = np.zeros(len(h) - n + 1, np.uint64), 0, odd, h
    size, times = 1, np.uint64(1)
    with np.errstate(over="ignore"):
        while size <= n:
            if n & size:
                out += at[done : done + len(out)] * times
                times, done = times * power, done + size
            if size * 2 <= n:
                at = at[:-size] + at[size:] * power
            power, size = power * power, size * 2
    return out


_powers: dict = {}


def powers(odd: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """odd^(i+1) and its inverse, for at least ``n`` places; kept by each worker."""
    if int(odd) not in _powers or len(_powers[int(odd)][0]) < n:
        size = max(4096, 2 * n)
        inverse = np.uint64(pow(int(odd), -1, 1 << 64))
        _powers[int(odd)] = (np.cumprod(np.full(size, odd, np.uint64)), np.cumprod(np.full(size, inverse, np.uint64)))
    return _powers[int(odd)]


def sliding_min(v: np.ndarray, n: int) -> np.ndarray:
    size, at = 1, v
    while size * 2 <= n:
        at = np.minimum(at[:-size], at[size:])
        size *= 2
    return np.minimum(at[: len(v) - n + 1], at[n - size : n - size + len(v) - n + 1])


def blocks(h: np.ndarray, window: int, seed: int):
    """(anchor, hash 1, hash 2, start, length) arrays of the content-cut blocks of one document's word hashes."""
    n = len(h)
    if n < window:
        return None
    g = run_hashes(h, seed, ODD[0])
    v = (scramble(g) & np.uint64(0xFFFFFFFF00000000)) | (np.arange(len(g), dtype=np.uint64) & np.uint64(0xFFFFFFFF))
    anchor = (sliding_min(v, window - seed + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], len(anchor)) - 1
    length = last - first + window
    out = [g[anchor[first]]]
    for odd in ODD:
        with np.errstate(over="ignore"):
            power, back = powers(odd, n)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:n], dtype=np.uint64)])
            out.append(scramble((total[first + length] - total[first]) * back[first] + length.astype(np.uint64)))
    return *out, first, length


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _index(window, seed):
    def run(batches):
        for b in slices(batches, 4 << 20):
            parts = []
            ids, keys = b.column("mf_id").to_numpy(zero_copy_only=False), b.column("mf_key").to_numpy(zero_copy_only=False)
            for i, text in enumerate(b.column("text").to_pylist()):
                found = blocks(word_hashes(words_of(text)), window, seed)
                if found:
                    parts.append((np.full(len(found[0]), i), *found))
            if not parts:
                continue
            row, anchor, h1, h2, start, length = (np.concatenate(x) for x in zip(*parts, strict=True))
            # equal blocks of a document are one row: text that repeats itself has few of them
            order = np.lexsort((start, h2, h1, row))
            row, h1, h2 = row[order], h1[order], h2[order]
            first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
            places = start[order].astype("<i4")
            edge = np.append(first, len(order)).tolist()
            more = pa.array([places[a + 1 : b].tobytes() if b > a + 1 else None for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [_signed(anchor[order][first]), _signed(h1[first]), _signed(h2[first]), pa.array(ids[row[first]]), pa.array(keys[row[first]]), pa.array(places[first]), more, pa.array(length[order][first].astype(np.int32))],
                ["anchor", "h1", "h2", "mf_id", "mf_key", "start", "more", "length"],
            )

    return run


def _windows(window):
    def run(batches):
        for b in slices(batches, 4 << 20):
            ids, keys = b.column("mf_id").to_numpy(zero_copy_only=False), b.column("mf_key").to_numpy(zero_copy_only=False)
            asked = b.column("asked").to_pylist()
            parts = []
            for i, text in enumerate(b.column("text").to_pylist()):
                h = word_hashes(words_of(text))
                mark = np.zeros(len(h) + 1, np.int64)
                for a in asked[i]:
                    at = places_of(a)
                    np.add.at(mark, at, 1)
                    np.add.at(mark, at + (a["length"] - window + 1), -1)
                at = np.flatnonzero(np.cumsum(mark[: len(h) - window + 1]) > 0)
                w1, w2 = (scramble(run_hashes(h, window, odd))[at] for odd in ODD)
                parts.append((np.full(len(at), i), w1, w2, at))
            if not parts:
                continue
            row, w1, w2, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([_signed(w1), _signed(w2), pa.array(ids[row]), pa.array(keys[row]), pa.array(at.astype(np.int32))], ["w1", "w2", "mf_id", "mf_key", "start"])

    return run


def places_of(piece: dict) -> np.ndarray:
    """Where a block stands in its document: the first place and those that ``more`` holds."""
    first = np.array([piece["start"]], np.int32)
    return np.concatenate([first, np.frombuffer(piece["more"], "<i4")]) if piece["more"] else first


def parse(start: np.ndarray, length: np.ndarray, ref: np.ndarray, ref_start: np.ndarray) -> list[tuple[int, int, int, int]]:
    """Greedy factors (start, end, ref, ref_start) of a document, from the pieces of it that stand in references."""
    shift = ref_start - start
    order = np.lexsort((start, shift, ref))
    start, end, ref, shift = start[order], (start + length)[order], ref[order], shift[order]
    # pieces that continue each other at one shift of one reference are one match
    group = np.cumsum(np.concatenate([[0], (ref[1:] != ref[:-1]) | (shift[1:] != shift[:-1])]))
    high = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * high) - group * high
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] > reach[:-1])]))
    end = np.maximum.reduceat(end, first)
    start, ref, shift = start[first], ref[first], shift[first]
    factors, at, best = [], 0, None
    order = np.lexsort((ref, -end, start))
    for s, e, r, d in zip(*(x[order].tolist() for x in (start, end, ref, shift)), strict=True):
        # matches that begin beyond the reach of the best so far: take it
        while best and s > at:
            factors.append((at, best[0], best[1], at + best[2]))
            at, best = best[0], None
            if s > at:
                break
        if not best and s > at:
            at = s
        if e > at and (not best or e > best[0]):
            best = (e, r, d)
    if best:
        factors.append((at, best[0], best[1], at + best[2]))
    return factors


def joined_spans(factors: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    spans: list[tuple[int, int]] = []
    for s, e, _, _ in factors:
        if spans and s <= spans[-1][1]:
            spans[-1] = (spans[-1][0], e)
        else:
            spans.append((s, e))
    return spans


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FACTORS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("ref_id", pa.int64()), ("ref_start", pa.int64())]))


def _cut(keep_columns):
    def run(batches):
        for b in slices(batches, 4 << 20, "mf_text"):
            out: list[list] = [[], [], [], [], []]
            pieces = b.column("mf_pieces")
            for i, text in enumerate(b.column("mf_text").to_pylist()):
                words, found, factors = words_of(text), pieces[i].as_py(), []
                if found:
                    places = [places_of(x) for x in found]
                    many = [len(x) for x in places]
                    of = [np.repeat(np.array([x[n] for x in found], np.int64), many) for n in ("length", "ref_id", "ref_start")]
                    factors = parse(np.concatenate(places).astype(np.int64), *of)
                spans, at, left = joined_spans(factors), 0, []
                for s, e in spans:
                    left += words[at:s]
                    at = e
                left += words[at:]
                row = (
                    len(words), len(words) - len(left), b" ".join(left).decode(), [{"start": s, "end": e} for s, e in spans],
                    [{"start": s, "end": e, "ref_id": None if r == LAST_ID else r, "ref_start": k} for s, e, r, k in factors],
                )
                for x, y in zip(out, row, strict=True):
                    x.append(y)
            kinds = (pa.int64(), pa.int64(), pa.string(), SPANS, FACTORS)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep_columns] + [pa.array(x, t) for x, t in zip(out, kinds, strict=True)], [*keep_columns, *MADE])

    return run


MADE = ["n_words", "n_removed", "kept_text", "spans", "factors"]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, window: int = 50, seed: int = 16) -> DataFrame:
    """The rows of ``docs`` with n_words, n_removed, kept_text, spans (word positions, end exclusive) and factors.

    Every word covered by a run of ``window`` words that also starts in a
    document with a smaller id is removed; judged on the input.  Kept words
    are joined by one space.  A factor also names a document with a smaller
    id that holds it (null for one without an id) and where.

    Null texts have no words and stay null in the text column; a null id is
    ordered after all others; rows with one id remove nothing from each
    other, and rows equal in id and text get equal results; columns of
    ``docs`` named like results are replaced; an empty table gives an empty
    result.
    """
    base = with_row_key(docs.drop(*(c for c in docs.columns if c in MADE)), id_col, text_col)
    texts = base.select("mf_id", "mf_key", F.col(text_col).alias("text"))
    rows = materialize(texts.mapInArrow(_index(window, seed), "anchor long, h1 long, h2 long, mf_id long, mf_key long, start int, more binary, length int"), "rlz-blocks")
    # most anchors stand in one document alone: their blocks go no further
    shared = rows.groupBy("anchor").agg(F.min("mf_id").alias("lo"), F.max("mf_id").alias("hi"), (F.min("h1") < F.max("h1")).alias("several")).filter("lo < hi").select("anchor", "several")
    rows = materialize(rows.join(shared, "anchor"), "rlz-shared")
    refs = rows.groupBy("h1", "h2").agg(F.min(F.struct("mf_id", "start")).alias("ref"), F.max("mf_id").alias("last"), F.any_value("several").alias("several"))
    refs = refs.filter("several or ref.mf_id < last").select("h1", "h2", "ref")
    piece = lambda more, length: F.struct("start", more.alias("more"), length.alias("length"), F.col("ref.mf_id").alias("ref_id"), F.col("ref.start").alias("ref_start")).alias("piece")
    placed = materialize(rows.join(refs, ["h1", "h2"]).filter("mf_id > ref.mf_id or several").select("mf_id", "mf_key", "start", "more", "length", "ref"), "rlz-placed")
    whole = placed.filter("mf_id > ref.mf_id").select("mf_id", "mf_key", piece(F.col("more"), F.col("length")))
    # anchors with several blocks: these can share windows without being equal
    asked = placed.filter("mf_id <= ref.mf_id").groupBy("mf_id", "mf_key").agg(F.collect_list(F.struct("start", "more", "length")).alias("asked"))
    grams = materialize(texts.join(asked, ["mf_id", "mf_key"]).mapInArrow(_windows(window), "w1 long, w2 long, mf_id long, mf_key long, start int"), "rlz-windows")
    firsts = grams.groupBy("w1", "w2").agg(F.min(F.struct("mf_id", "start")).alias("ref"), F.max("mf_id").alias("last")).filter("ref.mf_id < last").drop("last")
    part = grams.join(firsts, ["w1", "w2"]).filter("mf_id > ref.mf_id").select("mf_id", "mf_key", piece(F.lit(None).cast("binary"), F.lit(window)))
    pieces = whole.unionByName(part).groupBy("mf_id", "mf_key").agg(F.collect_list("piece").alias("mf_pieces"))
    keep = [c for c in base.columns if c not in ("mf_id", "mf_key")]
    joined = base.withColumn("mf_text", F.col(text_col)).join(pieces, ["mf_id", "mf_key"], "left")
    made = "n_words long, n_removed long, kept_text string, spans array<struct<start: long, end: long>>, factors array<struct<start: long, end: long, ref_id: long, ref_start: long>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name in keep), made])
    return joined.mapInArrow(_cut(keep), schema)

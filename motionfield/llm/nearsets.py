"""Near-duplicates by SimHash of shingle sets, followed by an exact check of their Jaccard similarity.

1. A class of equal sets has a SimHash fingerprint of 256 bits, and 768 bits
   more for grids: a bit is 1 if set in over half the shingle hashes.
2. A grid is a draw of 18 one-bit segments; a cell of it is their bit counts.
   Bits with a clear majority hardly differ between near sets, so that of
   4,096 grids a set enters the 192 whose bits are clearest, and near sets
   choose mostly the same ones.
3. A row of a cell has 34 further bits, others in each grid; rows of a cell
   that differ in more than ``CHECK_RADIUS`` of them go no further, so that
   sets which meet by chance hardly leave the cells.
4. Fingerprints in one cell are compared by the Manhattan distance of the bit
   counts of 4-bit segments, which bounds the Hamming distance from below,
   then by the Hamming distance itself.
5. Pairs within ``RADIUS`` of the 256 bits are linked if the Jaccard similarity of their
   sets, counted on the sets themselves, reaches the threshold.

A sixteenth of the grids is searched first.  What its distances hold together
is a clump; all pairs of a clump are counted, and the other grids are asked
only for what lies between clumps.
"""

from __future__ import annotations

from math import erf, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, bounds, materialize, slices, text_key, with_row_key
from .links import cell_units, components, first_reached, units_of, with_payload
from .simhash import bit_counts, mixed, random_grids, shingle_hashes

#: Words of 64 bits: of a fingerprint, and of all bits that grids draw on.
WORDS, ALL_WORDS = 4, 16
GRIDS, GRID_BITS, ENTERED = 4096, 18, 192
#: Grids that are searched first.
FIRST_GRIDS = GRIDS // 16
#: Bits of a row of a cell; near sets differ in 5 or 6 on average (sd 2.2), unrelated ones in 17 (2.9).
CHECK_BITS, CHECK_RADIUS = 34, 11
#: Clumps of up to this many sets are compared pair by pair, in units of two chunks.
CLUMP, CHUNK = 4096, 256
#: Of 256 bits two sets at a Jaccard similarity of 0.8 differ in 39 on average (sd 5.7; four of five shingles: 48, 6.2), unrelated ones in 128.
RADIUS = 76


def shingle_set(text: str | None, n: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, n), np.uint64))


def grid_table() -> np.ndarray:
    """The bits of each grid."""
    return np.array(random_grids(GRIDS, GRID_BITS, 64 * ALL_WORDS), np.int64)[:, :, 0]


def fingerprints_of_sets(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, margins) of runs of shingle hashes: uint8 and float32, a row for each run."""
    counts = np.concatenate([bit_counts(mixed(flat, k), bounds(size)) for k in range(ALL_WORDS)], axis=1)
    over = 2 * counts - size[:, None]
    return (over > 0).astype(np.uint8), np.abs(over).astype(np.float32) / np.sqrt(np.maximum(size, 1), dtype=np.float32)[:, None]


def clearest_grids(margins: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The ``ENTERED`` grids whose bits all agree most probably with those of a near set; of equal ones the first."""
    steps = 32
    # chance of agreement of a bit at a cosine of 8/9 (0.8 of equal sizes), in logarithms of whole ten-thousandths
    chance = np.array([round(1e4 * np.log(0.5 + 0.5 * erf(8 / sqrt(17) * z / steps / sqrt(2)))) for z in range(4 * steps)], np.int32)
    each = chance[np.minimum((margins * steps).astype(np.int32), len(chance) - 1)].T.copy()
    score = np.zeros((len(table), len(margins)), np.int32)
    for k in range(GRID_BITS):
        score += each[table[:, k]]
    rank = np.arange(len(table), dtype=np.int32)[:, None] - score * np.int32(len(table))
    return np.sort(np.argpartition(np.ascontiguousarray(rank.T), ENTERED - 1, axis=1)[:, :ENTERED], axis=1).astype(np.uint16)


def _marks(shingle, least):
    def run(batches):
        table = grid_table()
        for b in slices(batches, 4 << 20):
            sets = [shingle_set(t, shingle) for t in b.column("text").to_pylist()]
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            # a set so small that one shingle more takes it below the threshold is near to its equals alone
            full = np.flatnonzero(size >= least * (size + 1))
            fps, grids = [None] * len(sets), [None] * len(sets)
            for part in np.split(full, range(256, len(full), 256)) if len(full) else []:
                bits, margins = fingerprints_of_sets(np.concatenate([sets[i] for i in part]), size[part])
                packed, chosen = np.packbits(bits, axis=1, bitorder="little"), clearest_grids(margins, table)
                for k, i in enumerate(part.tolist()):
                    fps[i], grids[i] = packed[k].tobytes(), chosen[k].tobytes()
            columns = [b.column("id"), b.column("text_hash"), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()), pa.array(fps, pa.binary()), pa.array(grids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "key", "fp", "grids"])

    return run


def check_words(words: np.ndarray, row: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The check bits of rows of ``words`` in a grid each."""
    shift = (grid // ALL_WORDS % (65 - CHECK_BITS)).astype(np.uint64)
    return (words[row, grid % ALL_WORDS] >> shift & np.uint64((1 << CHECK_BITS) - 1)).view(np.int64)


def _cells(most):
    """Cells, with the check bits, in those grids of each set that are among the first ``most``."""

    def run(batches):
        table, place = grid_table(), 1 << np.arange(GRID_BITS, dtype=np.int64)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            raw = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(n, 8 * ALL_WORDS)
            bit, words = np.unpackbits(raw, axis=1, bitorder="little"), raw.view(np.uint64)
            grids = np.frombuffer(b"".join(b.column("grids").to_pylist()), np.uint16).reshape(n, ENTERED).astype(np.int64)
            ids, known = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "known"))
            for k in range(ENTERED):
                row = np.flatnonzero(grids[:, k] < most)
                if not len(row):
                    break
                grid = grids[row, k]
                # counts of one-bit segments
                cell = (grid << GRID_BITS) + bit[row[:, None], table[grid]] @ place
                yield pa.RecordBatch.from_arrays([pa.array(cell << CHECK_BITS | check_words(words, row, grid)), pa.array(ids[row]), pa.array(known[row])], ["cell", "id", "known"])

    return run


def hamming_labels(fps: np.ndarray, radius: int) -> np.ndarray:
    """``first_reached`` of fingerprints (rows of bytes) by pairs of ``radius`` or fewer differing bits."""
    count = np.bitwise_count(np.concatenate([fps & 15, fps >> 4], axis=1)).astype(np.int8)
    word = np.ascontiguousarray(fps).view(np.uint64)

    def near(i, left):
        out = np.abs(count[left] - count[i]).sum(axis=1, dtype=np.int32) <= radius
        # what is left is verified bit by bit
        some = left[out]
        out[out] = np.bitwise_count(word[some] ^ word[i]).sum(axis=1, dtype=np.int32) <= radius
        return out

    return first_reached(len(fps), near)


def set_links(sets: list[np.ndarray], least: float) -> np.ndarray:
    """The smallest index reachable from each set by pairs of a Jaccard similarity of ``least`` or more."""
    n = len(sets)
    size = np.fromiter(map(len, sets), np.int64, n)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.zeros(2, np.int64) if both and both >= least * (size.sum() - both) else np.arange(n)
    at = bounds(size)
    _, place = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(place), np.int64)

    def near(i, left):
        out = (size[left] > 0) & (np.minimum(size[left], size[i]) >= least * np.maximum(size[left], size[i]))
        fit = left[out]
        mark[place[at[i] : at[i + 1]]] = 1
        both = np.fromiter((mark[place[at[j] : at[j + 1]]].sum() for j in fit), np.int64, len(fit))
        mark[place[at[i] : at[i + 1]]] = 0
        out[out] = both >= least * (size[fit] + size[i] - both)
        return out

    return first_reached(n, near)


def _near(radius):
    """Members of units to (left): the ids of each group of two or more that Hamming distances hold together."""

    def run(batches):
        for b in batches:
            groups = []
            for _, _, ids, load in units_of(b):
                label = hamming_labels(np.frombuffer(b"".join(load.to_pylist()), np.uint8).reshape(len(ids), 8 * WORDS), radius)
                order = np.argsort(label, kind="stable")
                parts = np.split(ids[order], np.flatnonzero(np.diff(label[order])) + 1)
                groups += [np.sort(x) for x in parts if len(x) > 1]
            flat = np.concatenate(groups) if groups else np.empty(0, np.int64)
            offsets = bounds(np.fromiter(map(len, groups), np.int64, len(groups)))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["left"])

    return run


def _verify(shingle, least):
    def run(batches):
        for b in batches:
            a, c = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for _, _, ids, load in units_of(b):
                label = set_links([shingle_set(t, shingle) for t in load.to_pylist()], least)
                moved = label != np.arange(len(ids))
                a.append(ids[moved]), c.append(ids[label[moved]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(c))], ["a", "b"])

    return run


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """(mf_id, mf_key, id, key, component, label): a row for each row of ``docs``, keyed as by ``with_row_key``.

    ``label`` numbers the groups; ``component`` is the smallest id reachable by links between texts whose
    sets of ``shingle``-word shingles have a Jaccard similarity of ``least``
    or more.  Rows with one set are one class and are compared once, whatever
    their number; null, empty and blank texts are one class that links to no
    other.  A null id takes part in no minimum; other columns are not read;
    an empty table gives an empty result.  Only pairs whose fingerprints differ
    in at most ``radius`` bits are looked at; it and the grids are made for a
    ``least`` of 0.8 or more.
    """
    tag = "nearsets"
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("text_hash", text_key(F.col("text")))
    marks = materialize(rows.mapInArrow(_marks(shingle, least), "id long, text_hash long, key binary, fp binary, grids binary"), f"{tag}-marks", "snappy")
    # a class, and the row whose text stands for it
    firsts = marks.groupBy("key").agg(F.min("id").alias("least"), F.min(F.struct("id", "text_hash")).alias("row"), F.first("fp").alias("fp"), F.first("grids").alias("grids"))
    classes = materialize(firsts.withColumn("id", F.monotonically_increasing_id()), f"{tag}-class", "snappy")
    full = classes.filter("fp is not null")

    def close(full, most, name):
        """(left, list): ids that distances within the radius hold together, from the cells whose ``known`` isn't one value."""
        # near copies meet in many grids; units of the same members are compared once
        cells = full.select("id", "fp", "grids", "known").mapInArrow(_cells(most), "cell long, id long, known long")
        units = cell_units(cells, f"{tag}-{name}", bits=CHECK_BITS, radius=CHECK_RADIUS).groupBy("left", "right").agg(F.min("cell").alias("cell"))
        found = with_payload(units, full.select("id", F.substring("fp", 1, 8 * WORDS).alias("load")), f"{tag}-{name}-fp").mapInArrow(_near(radius), "left array<long>")
        return materialize(found.distinct().withColumn("list", F.monotonically_increasing_id()), f"{tag}-{name}-close")

    def texts_of(lists, name):
        ids = lists.select(F.explode("left").alias("id")).distinct()
        wanted = ids.join(full.select("id", F.col("row.id").alias("row_id"), F.col("row.text_hash").alias("text_hash")), "id")
        match = F.col("w.row_id").eqNullSafe(F.col("r.id")) & (F.col("w.text_hash") == F.col("r.text_hash"))
        return materialize(rows.alias("r").join(wanted.alias("w"), match).select("w.id", "r.text").groupBy("id").agg(F.first("text").alias("load")), f"{tag}-{name}-texts")

    def verified(lists, texts, name):
        units = lists.select(F.monotonically_increasing_id().alias("cell"), "left", F.lit(None).cast("array<long>").alias("right"))
        return materialize(with_payload(units, texts, f"{tag}-{name}-pairs").mapInArrow(_verify(shingle, least), "a long, b long"), f"{tag}-{name}-links")

    def joined(groups, name):
        """``full`` with the group ``known`` that each class is in by ``groups``."""
        return materialize(full.join(groups, "id", "left").withColumn("known", F.coalesce("component", "id")).drop("component"), f"{tag}-{name}-known", "snappy")

    def unjoined(lists, known, name):
        """Those of the lists that aren't one group yet."""
        ends = lists.select("list", F.explode("left").alias("id")).join(known.select("id", "known"), "id").groupBy("list").agg(F.min("known").alias("low"), F.max("known").alias("high"))
        return materialize(lists.join(ends.filter("low < high"), "list").select("left"), f"{tag}-{name}-open")

    def pairs_of(clumps):
        """(left): lists that hold every pair of a clump."""
        c = F.ceil(F.col("n") / CHUNK)
        own = clumps.select("component", c.alias("c"), F.pmod(F.xxhash64("id"), c).alias("x"), "id")
        # the only chunk by itself, one of several with each other
        dealt = own.select("component", "x", "id", F.explode(F.expr("filter(sequence(0, c - 1), y -> c = 1 or y <> x)")).alias("y"))
        return dealt.groupBy("component", F.least("x", "y"), F.greatest("x", "y")).agg(F.sort_array(F.collect_list("id")).alias("left")).select("left")

    # some of the grids: all pairs of each clump
    lists = close(full.withColumn("known", F.col("id")), FIRST_GRIDS, "some")
    texts = texts_of(lists, "some")
    clumps = components(lists.select(F.col("left")[0].alias("a"), F.explode("left").alias("b")), f"{tag}-clumps")
    clumps = materialize(clumps.join(clumps.groupBy("component").agg(F.count("*").alias("n")), "component"), f"{tag}-clump-sizes")
    groups, large = clumps.filter(F.col("n") <= CLUMP), clumps.filter(F.col("n") > CLUMP)
    links, groups = verified(pairs_of(groups), texts, "clumps"), groups.select("id", "component")
    if not large.isEmpty():
        # of larger ones each text with the smallest id that it meets, then all pairs of the lists that this leaves in parts
        lists = lists.join(large.select(F.col("id").alias("first")), F.col("left")[0] == F.col("first")).select("list", "left")
        heads = lists.select(F.col("left")[0].alias("head"), F.explode("left").alias("id")).groupBy("id").agg(F.min("head").alias("head")).filter("head < id")
        found = verified(heads.select(F.array("head", "id").alias("left")), texts, "heads")
        found = found.unionByName(verified(unjoined(lists, joined(components(found, f"{tag}-heads-groups"), "heads"), "some"), texts, "some"))
        links, groups = links.unionByName(found), groups.unionByName(components(found, f"{tag}-some-groups"))
    # all grids: all pairs of a cell, but for cells and lists of one clump or group
    known = joined(groups, "some")
    lists = unjoined(close(known, GRIDS, "all"), known, "all")
    links = links.unionByName(verified(lists, texts_of(lists, "all"), "all"))
    linked = components(links, tag)
    named = classes.join(linked, "id", "left").select("key", "least", F.coalesce("component", "id").alias("c"))
    top = named.groupBy("c").agg(F.min("least").alias("component"))
    of_class = named.join(top, "c").select("key", "component", F.col("c").alias("label"))
    return marks.select("id", "text_hash", "key").join(of_class, "key").select(F.coalesce("id", F.lit(LAST_ID)).alias("mf_id"), F.col("text_hash").alias("mf_key"), "id", "key", "component", "label")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **of) -> DataFrame:
    """``docs`` with one row of each group of ``jaccard_groups``: that with the smallest id.

    Rows without an id come after all others; of different texts of a group
    under that id the one with the smaller hash stays, of rows equal in id and
    text any one.  Rows with an id in common are judged each by its own text.
    """
    groups = materialize(jaccard_groups(docs, id_col, text_col, **of).select("mf_id", "mf_key", "label"), "nearsets-groups")
    key = F.struct("mf_id", "mf_key")
    first = groups.groupBy("label").agg(F.min(key).alias("first"))
    # what to do with rows: of a key that isn't the first of its group none stays, of one that occurs repeatedly one
    marked = groups.groupBy("label", "mf_id", "mf_key").agg(F.count("*").alias("n")).join(first, "label").select("mf_id", "mf_key", F.when(key != F.col("first"), 0).when(F.col("n") > 1, 1).alias("stay"))
    marked = materialize(marked.filter("stay is not null"), "nearsets-marked")
    # no bound holds for the number of rows that go, so they are never broadcast, whatever the size
    rows = with_row_key(docs, id_col, text_col).join(marked.hint("merge"), ["mf_id", "mf_key"], "left")
    return rows.filter("stay is null").unionByName(rows.filter("stay = 1").dropDuplicates(["mf_id", "mf_key"])).select(*docs.columns)

"""SimHash near-duplicates: fingerprints, popcount cells, exact check, groups.

A fingerprint is mapped to the bit counts of its segments.  The Manhattan
distance of two such count vectors never exceeds the Hamming distance of the
fingerprints, so a grid join on counts finds every pair: with the segments in
``groups`` groups, two fingerprints at distance ``radius`` or less differ in
at most ``radius`` groups, hence agree on all counts of some ``groups -
radius`` of them.  Each choice of those groups is one grid (cell width 1);
pairs in a cell are tested by Manhattan distance, then by Hamming distance.

For wide radii ``lattices`` random grids of ``lattice_bits`` segments take
the place of the exhaustive choice.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, bounds, materialize, slices
from .links import cell_units, components, local_labels, units_of, with_payload

LANES = np.uint64(0x0101010101010101)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def shingle_hashes(text: str | None, n: int) -> list[int]:
    """XXH64 (seed 42) of every n-word shingle, repeats included; the whole sequence if it is shorter."""
    words = ascii_words(text)
    if not words:
        return []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= n:
        return [xxhash.xxh64_intdigest(line, 42)]
    starts = np.concatenate([[0], ends[:-n] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(line[s:e], 42) for s, e in zip(starts, ends[n - 1 :].tolist(), strict=True)]


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent 64-bit word derived from a hash; the hash itself for 0."""
    if not k:
        return h
    x = h + np.uint64(int(GOLDEN) * k % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bit_counts(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many hashes of each run have each of the 64 bits set.  Runs may be empty."""
    sizes = np.diff(starts)
    out = np.zeros((len(sizes), 64), np.int64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    chunks = -(-sizes[full] // 255)
    first = bounds(chunks)
    at = np.repeat(starts[full], chunks) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], chunks))
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & LANES, at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[full, j::8] = np.add.reduceat(lanes, first[:-1], axis=0)
    return out


def majority_bits(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Fingerprints of hash runs: a bit is 1 if set in over half the hashes of a run.  Runs may be empty (0)."""
    bits = (2 * bit_counts(h, starts) > np.diff(starts)[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int, words: int = 1) -> DataFrame:
    """(id, fp): fingerprints of ``64 * words`` bits as big-endian binary, for every row; all bits zero without words."""

    def run(batches):
        for b in slices(batches, 4 << 20):
            per = [shingle_hashes(t, shingle) for t in b.column("text").to_pylist()]
            starts = bounds(np.fromiter(map(len, per), np.int64, len(per)))
            h = np.fromiter(itertools.chain.from_iterable(per), np.uint64, int(starts[-1]))
            fp = np.stack([majority_bits(mixed(h, k), starts) for k in range(words)], axis=1)
            flat = np.ascontiguousarray(fp).astype(">u8").tobytes()
            w = 8 * words
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([flat[i : i + w] for i in range(0, len(flat), w)], pa.binary())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp binary")


def exhaustive_grids(radius: int, groups: int) -> list[list[list[int]]]:
    """Every choice of ``groups - radius`` groups of a 64-bit word, each a list of 2-bit segments."""
    segments = [[2 * i, 2 * i + 1] for i in range(32)]
    parts = [segments[i * 32 // groups : (i + 1) * 32 // groups] for i in range(groups)]
    return [[s for p in chosen for s in p] for chosen in itertools.combinations(parts, groups - radius)]


def random_grids(lattices: int, lattice_bits: int, bits: int, seed: int = 7) -> list[list[list[int]]]:
    """Grids on ``lattice_bits`` one-bit segments drawn without repetition from shuffled bit orders."""
    rng, out = np.random.default_rng(seed), []
    while len(out) < lattices:
        order = rng.permutation(bits)
        out += [[[int(x)] for x in order[i : i + lattice_bits]] for i in range(0, bits - lattice_bits + 1, lattice_bits)]
    return out[:lattices]


def _cells(grids, words):
    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            raw = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(n, 8 * words)
            bit = np.unpackbits(raw, axis=1, bitorder="little")
            ids = b.column("id").to_numpy(zero_copy_only=False)
            for t, grid in enumerate(grids):
                key = np.full(n, t + 1, np.uint64)
                for segment in grid:
                    key = key * np.uint64(5) + bit[:, segment].sum(axis=1, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(mixed(key, 1).view(np.int64)), pa.array(ids)], ["cell", "id"])

    return run


def hamming_links(side, ids, load, radius: int, words: int):
    """Star links of one unit: (member id, first id of its local component)."""
    raw = np.frombuffer(b"".join(load.to_pylist()), np.uint8).reshape(len(ids), 8 * words)
    # Manhattan distance of the segments' bit counts bounds the Hamming distance from below
    count, low = np.bitwise_count(raw).astype(np.int16), np.zeros((len(ids), len(ids)), np.int16)
    for segment in count.T:
        low += np.abs(segment[:, None] - segment[None, :])
    near = np.triu(low <= radius, 1)
    if side.any():
        near &= side[:, None] != side[None, :]
    # what is left is verified bit by bit
    a, b = np.nonzero(near)
    word = raw.view(np.uint64)
    true = np.bitwise_count(word[a] ^ word[b]).sum(axis=1) <= radius
    near[:] = False
    near[a[true], b[true]] = near[b[true], a[true]] = True
    label = local_labels(near)
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def _verify(radius, words):
    def run(batches):
        for b in batches:
            a, c = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for _, side, ids, load in units_of(b):
                x, y = hamming_links(side, ids, load, radius, words)
                a.append(x), c.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(c))], ["a", "b"])

    return run


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, radius: int = 2, words: int = 1, groups: int = 5, lattices: int = 0, lattice_bits: int = 24) -> DataFrame:
    """(id, fp, component): a row for each row of ``docs``.

    ``component`` is the smallest id among fingerprints reachable by links of
    ``radius`` or fewer differing bits.  Rows with one fingerprint are one
    class and enter the grids once, whatever their number.

    Null and empty texts have fingerprint zero and link like any other; rows
    that repeat get equal results; a null id takes part in no minimum (its
    component is that of its class, null where no row of it has an id); other
    columns are not read; an empty table gives an empty result.
    """
    tag = f"simhash{words}"
    marks = materialize(fingerprints(docs, id_col, text_col, shingle, words), f"{tag}-fp", "snappy")
    classes = materialize(marks.groupBy("fp").agg(F.min("id").alias("least")).withColumn("id", F.monotonically_increasing_id()), f"{tag}-class")
    grids = random_grids(lattices, lattice_bits, 64 * words) if lattices else exhaustive_grids(radius, groups)
    units = cell_units(classes.mapInArrow(_cells(grids, words), "cell long, id long"), tag)
    members = with_payload(units, classes.select("id", F.col("fp").alias("load")), tag)
    linked = components(members.mapInArrow(_verify(radius, words), "a long, b long"), tag)
    named = classes.join(linked, "id", "left").select("fp", "least", F.coalesce("component", "id").alias("c"))
    top = named.groupBy("c").agg(F.min("least").alias("component"))
    of_class = named.join(top, "c").select("fp", "component")
    return marks.join(of_class, "fp").select("id", "fp", "component")

import random
from collections import Counter

import numpy as np

import corpus_pipeline as P
from motionfield.llm import nearsets
from motionfield.llm.links import cell_units, with_payload
from motionfield.llm.nearsets import GRID_BITS, RADIUS, clearest_grids, fingerprints_of_sets, grid_table, hamming_labels, jaccard_groups, set_links


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def kept(spark, texts):
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    return {r.doc_id for r in P.near_dedup(spark, docs, "").collect()}


def test_pairs_around_the_threshold(spark):
    """Pairs from 0.6 to 0.95, long and short: linked from 0.8 on, and only then."""
    rng = random.Random(4)
    texts = []
    for k in range(300):
        n = rng.choice([12, 40, 300])
        words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        # a changed tail of t words leaves n - 4 - t of the n - 4 + t shingles
        same = rng.choice([0.6, 0.7, 0.77, 0.79, 0.8, 0.81, 0.85, 0.95])
        t = round((n - 4) * (1 - same) / (1 + same))
        texts += [" ".join(words), " ".join(words[: n - t] + [f"x{rng.randrange(10**6)}" for _ in range(t)])]
    left = kept(spark, texts)
    wrong = [k for k in range(0, len(texts), 2) if k not in left or ((k + 1) in left) != (jaccard(shingles(texts[k]), shingles(texts[k + 1])) < 0.8)]
    assert wrong == []


def test_repeated_line_links_nothing(spark):
    rng = random.Random(5)
    line = " ".join(f"line{k}" for k in range(14))
    texts = [" ".join([f"w{rng.randrange(10**6)}" for _ in range(304)] + [line] * 100) for _ in range(6)]
    assert kept(spark, texts) == set(range(6))


def test_set_links_equals_brute_force():
    rng = np.random.default_rng(2)
    for n in (2, 3, 40):
        for _ in range(20):
            base = rng.choice(10**9, 60, replace=False).astype(np.uint64)
            sets = [np.unique(np.concatenate([rng.choice(base, int(rng.integers(40, 60)), replace=False), rng.integers(0, 2**60, int(rng.integers(0, 6)), np.uint64)])) for _ in range(n)]
            sets[0] = sets[0][:0] if rng.random() < 0.2 else sets[0]
            label = list(range(n))
            for _ in range(n):
                for i in range(n):
                    for j in range(n):
                        both = len(np.intersect1d(sets[i], sets[j]))
                        if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                            label[i] = label[j] = min(label[i], label[j])
                if n == 2:
                    break
            assert set_links(sets, 0.8).tolist() == label


def test_links_come_through_hamming_distances(spark):
    """Near sets are linked only if their fingerprints lie within the radius; equal sets have one fingerprint."""
    rng = random.Random(6)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        texts += [" ".join(words), " ".join(words[:-2] + ["x", "y"]), " ".join(words)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {radius: {r.id: r.component for r in jaccard_groups(docs, radius=radius).collect()} for radius in (-1, RADIUS)}
    assert found[-1] == {k: k if k % 3 < 2 else k - 2 for k in range(len(texts))}
    assert found[RADIUS] == {k: k - k % 3 for k in range(len(texts))}


def test_grids_bring_near_sets_together():
    """Pairs at a Jaccard similarity of exactly 0.8 share a cell and lie within the radius; unrelated sets hardly meet."""
    rng, table = np.random.default_rng(9), grid_table()
    for shared, left, right in ((4, 0, 1), (8, 1, 1), (12, 0, 3), (40, 5, 5), (360, 0, 90)):
        sides = []
        common = [rng.integers(0, 2**64, shared, np.uint64) for _ in range(250)]
        for own in (left, right):
            sets = [np.concatenate([c, rng.integers(0, 2**64, own, np.uint64)]) for c in common]
            bits, margins = fingerprints_of_sets(np.concatenate(sets), np.full(len(sets), shared + own))
            sides.append((bits, clearest_grids(margins, table).astype(np.int64)))
        (x, gx), (y, gy) = sides
        cells = lambda bits, g: {(int(k), bits[table[k]].tobytes()) for k in g}
        met = [len(cells(a, g) & cells(b, h)) for a, g, b, h in zip(x, gx, y, gy, strict=True)]
        near = (x[:, :256] != y[:, :256]).sum(axis=1) <= RADIUS
        assert min(met) > 0 and near.all(), (shared, left, right)
        assert sum(len(cells(x[k], gx[k]) & cells(y[k - 1], gy[k - 1])) for k in range(250)) <= 5
    assert table.shape[1] == GRID_BITS and table.max() < 1024


def test_hamming_labels_equal_brute_force():
    rng = np.random.default_rng(10)
    for n in (2, 3, 60):
        base = rng.integers(0, 256, (3, 32), np.uint8)
        fps = base[rng.integers(0, 3, n)] ^ np.packbits(rng.random((n, 256)) < 0.16, axis=1)
        far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
        label = list(range(n))
        for _ in range(n):
            label = [min(label[j] for j in range(n) if far[i, j] <= 76) for i in range(n)]
        assert hamming_labels(fps, 76).tolist() == label


def test_check_bits_part_a_cell(spark):
    """Rows of a cell stay together if their words hold them together; a cell longer than a block stays whole."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 2**34, 3)
    rows, want = [], set()
    for cell, n in ((-7, 2), (3, 5), (4, 40), (2**29 - 1, 90)):
        word = [int(base[rng.integers(0, 3)]) ^ sum(1 << int(p) for p in rng.choice(34, rng.integers(0, 8), replace=False)) for _ in range(n)]
        ids = [1000 * len(rows) + k for k in range(n)]
        rows += [((cell << 34) + w, i, i) for w, i in zip(word, ids, strict=True)]
        label = list(range(n))
        for _ in range(n):
            label = [min(label[j] for j in range(n) if (word[i] ^ word[j]).bit_count() <= 11) for i in range(n)]
        groups = [tuple(i for i, x in zip(ids, label, strict=True) if x == root) for root in set(label)] if n <= 64 else [tuple(ids[:64]), tuple(ids[64:])]
        want |= {g for g in groups if len(g) > 1}
    units = cell_units(spark.createDataFrame(rows, "cell long, id long, known long"), "parted", 64, bits=34, radius=11).collect()
    assert {tuple(r.left) for r in units if r.right is None} == want
    assert [(len(r.left), len(r.right)) for r in units if r.right is not None] == [(64, 26)]


def test_near_copies_are_compared_a_few_times_each(spark, monkeypatch):
    """A group of near copies, of which many aren't linked, isn't compared once for each cell in which it meets."""
    rng = random.Random(12)
    base, texts = [f"w{rng.randrange(10**6)}" for _ in range(150)], []
    for k in range(240):
        words = list(base)
        for p in rng.sample(range(150), k % 8):
            words[p] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rows = Counter()

    def counted(units, payload, tag):
        units = units.cache()
        rows["texts" if tag.endswith("-pairs") else "fingerprints"] += units.selectExpr("size(left) + greatest(size(right), 0) as n").groupBy().sum("n").collect()[0][0] or 0
        return with_payload(units, payload, tag)

    monkeypatch.setattr(nearsets, "with_payload", counted)
    found = {}
    for clump in (nearsets.CLUMP, 100):
        # clumps of one unit, of several (chunks of 32), and too large for any
        for chunk in (nearsets.CHUNK, 32) if clump > 100 else (nearsets.CHUNK,):
            monkeypatch.setattr(nearsets, "CLUMP", clump), monkeypatch.setattr(nearsets, "CHUNK", chunk)
            rows.clear()
            docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
            found[clump, chunk] = {r.id: r.component for r in jaccard_groups(docs).collect()}
            if clump > 100:
                assert rows["texts"] <= 12 * len(texts) and rows["fingerprints"] <= 40 * len(texts), rows
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))
    near = [[j for j in range(len(texts)) if jaccard(sets[i], sets[j]) >= 0.8] for i in range(len(texts))]
    for _ in range(len(texts)):
        label = [min(label[j] for j in near[i]) for i in range(len(texts))]
    assert 10 < len(set(label)) < 200
    assert all(f == dict(enumerate(label)) for f in found.values())

import random

import numpy as np
import xxhash

from motionfield.llm.links import components
from motionfield.llm.queries import op7_simhash
from motionfield.llm.simhash import simhash_groups

SF = "/root/testdata/sf0.001"


def fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum((h >> j) & 1 for h in hs) > len(hs))


def brute(docs, radius=2):
    fps = [(i, fingerprint(t)) for i, t in docs]
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a][1] ^ fps[b][1]).bit_count() <= radius:
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(fps):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted((repr(i), f"{f:016x}", repr(least.get(find(k)))) for k, (i, f) in enumerate(fps))


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in op7_simhash(spark, SF).collect())
    assert got == brute(docs)


def test_edges(spark):
    rng = random.Random(3)
    base = " ".join(rng.choice("abcdefgh") * 3 for _ in range(400))
    docs = [(5, None), (4, ""), (9, "one"), (9, "one"), (None, "One"), (None, None), (7, base), (3, base + " tail"), (8, base * 60)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, fp string, component int")
    got = sorted((repr(r.id), f"{int.from_bytes(r.fp, 'big'):016x}", repr(r.component)) for r in simhash_groups(df).collect())
    assert got == brute(docs)
    assert simhash_groups(df.limit(0)).collect() == []


def test_many_rows_in_one_cell(spark):
    """More fingerprints in a cell than a block holds, all found through pairs of blocks."""
    import motionfield.llm.links as links

    ids = list(range(50))
    cells = spark.createDataFrame([(1, i) for i in ids] + [(2, 7), (2, 8), (3, 9)], "cell long, id long")
    units = links.cell_units(cells, "t", block=8).collect()
    pairs = []
    for u in units:
        if u.right is None:
            pairs += [(u.cell, a, b) for a in u.left for b in u.left if a < b]
        else:
            pairs += [(u.cell, min(a, b), max(a, b)) for a in u.left for b in u.right]
    assert sorted(pairs) == sorted([(1, a, b) for a in ids for b in ids if a < b] + [(2, 7, 8)])


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, 2000 + i) for i in range(1, 60)]
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            label[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {x: find(x) for x in label}
    assert components(spark.createDataFrame([], "a long, b long"), "t").collect() == []


def test_wide_radius_finds_edited_copies(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(3000)]
    docs = []
    for k in range(20):
        words = [rng.choice(vocab) for _ in range(300)]
        docs.append((2 * k, " ".join(words)))
        for j in range(0, 300, 100):
            words[j] = "changed"
        docs.append((2 * k + 1, " ".join(words)))
    got = simhash_groups(spark.createDataFrame(docs, "doc_id long, text string"), shingle=5, radius=45, words=4, lattices=128).collect()
    assert all(r.component == r.id // 2 * 2 for r in got)

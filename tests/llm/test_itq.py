import math

import numpy as np

import motionfield.llm.itq as itq
import pytest
from motionfield.llm.itq import Itq, embedding_links, table_keys


def brute(rows, least=0.95, kind=np.float32):
    """(id, links, component) of all rows, by all pairs of one length."""
    by_size = {}
    for k, (_, v) in enumerate(rows):
        if v and all(c is not None and math.isfinite(kind(c)) for c in v) and any(kind(c) != 0 for c in v):
            by_size.setdefault(len(v), []).append(k)
    links, label = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for keys in by_size.values():
        x = np.array([rows[k][1] for k in keys], kind).astype(float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= least
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            a, b = keys[i], keys[j]
            links[a] += 1
            links[b] += 1
            a, b = find(a), find(b)
            label[max(a, b)] = min(a, b)
    least_id = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least_id[find(k)] = min(i, least_id.get(find(k), i))
    return sorted((repr(i), links[k], repr(least_id.get(find(k)))) for k, (i, _) in enumerate(rows))


def run(spark, rows, kind="float", **kw):
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, id int")
    return sorted((repr(r.id), r.n_links, repr(r.component)) for r in embedding_links(df, **kw).collect())


def test_groups_of_near_vectors_and_edges(spark):
    rng = np.random.default_rng(0)
    rows, k = [], 0
    for _ in range(40):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((k, (centre + rng.normal(size=16) * 0.08).tolist()))
            k += 1
    rows += [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [None] + [1.0] * 15), (905, [1.0, 2.0]), (906, rows[0][1]), (906, rows[0][1]), (None, rows[5][1])]
    got, want = run(spark, rows), brute(rows)
    # few vectors: compared as one cell, so nothing is missed
    assert got == want and sum(w[1] for w in want) > 100
    assert run(spark, [(1, None)]) == [("1", 0, "1")]
    assert run(spark, []) == []


def alike(rng, n, d, common):
    """Unit vectors with a mean cosine of ``common``, as of texts of one kind."""
    m = rng.normal(size=d)
    r = rng.normal(size=(n, d))
    x = math.sqrt(common) * m / np.linalg.norm(m) + math.sqrt(1 - common) * r / np.linalg.norm(r, axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def at_cosine(rng, x, cosine):
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1)[:, None] * x
    return cosine * x + math.sqrt(1 - cosine**2) * side / np.linalg.norm(side, axis=1)[:, None]


@pytest.mark.parametrize("common", [0.0, 0.3, 0.5, 0.7, 0.8])
@pytest.mark.parametrize(("d", "n"), [(64, 3000), (384, 800)])
@pytest.mark.parametrize("rows", [3_000, 10_000_000])
def test_recall_at_the_threshold(common, d, n, rows):
    """Pairs at exactly the least cosine are found by the tables, whatever the vectors have in common and however many they are."""
    if d == 384 and (rows > 10_000 or common not in (0.0, 0.7)):
        pytest.skip("a few of the wide ones are enough")
    rng = np.random.default_rng(1)
    x = alike(rng, n, d, common)
    model = Itq(1, itq.MOST_BITS).fit(x).calibrated(x, rows, 0.95, 0.985)
    key = lambda v: table_keys(model.codes(v), model.table_bits)
    fresh = alike(np.random.default_rng(1), n, d, common)[: n // 2]
    assert (key(fresh) == key(at_cosine(rng, fresh, 0.95))).any(axis=1).mean() >= 0.97
    bits = ((x - model.mean) @ model.maps > model.cut).mean(axis=0)
    assert abs(bits - 0.5).max() < 0.01


@pytest.mark.parametrize("common", [0.0, 0.7])
def test_planted_pairs_are_found(spark, common):
    rng = np.random.default_rng(8)
    x = alike(rng, 1200, 64, common)
    y = np.concatenate([at_cosine(rng, x[k : k + 1], c) for k, c in enumerate(rng.uniform(0.9502, 0.97, 700))])
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))]
    got, want = run(spark, rows, "double"), brute(rows, kind=np.float64)
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and there >= 1400 and found >= 0.95 * there


def test_keys_cover_a_radius_of_one():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2**28, (200, 3), np.uint64)
    one = table_keys(codes, 28)
    for bit in range(28):
        flipped = codes.copy()
        flipped[:, 1] ^= np.uint64(1 << bit)
        both = one == table_keys(flipped, 28)
        assert both[:, 4:8].sum(axis=1).min() == 1 and both[:, :4].all() and both[:, 8:].all()


def near_groups(rng, n, d, noise):
    rows = []
    while len(rows) < n:
        centre = rng.normal(size=d)
        rows += [(centre + rng.normal(size=d) * noise).tolist() for _ in range(int(rng.integers(1, 6)))]
    return [(k, v) for k, v in enumerate(rows[:n])]


@pytest.mark.parametrize("n", [499, 500, 999])
def test_coded_vectors_against_all_pairs(spark, monkeypatch, n):
    """With codes for every length: pairs are counted once, components are as by all pairs but for links not found."""
    monkeypatch.setattr(itq, "LEARNED_FROM", 8)
    rows = near_groups(np.random.default_rng(n), n, 32, 0.15)
    rows += [(5000 + k, v[:20]) for k, v in rows[:40]] + [(6000 + k, v) for k, v in rows[:3]]
    got, want = run(spark, rows, fit_rows=400), brute(rows)
    links = lambda x: sum(r[1] for r in x)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True)) and links(got) >= 0.95 * links(want) > 200
    assert sum(g[2] == w[2] for g, w in zip(got, want, strict=True)) >= 0.97 * len(rows)
    # with every key a hit all pairs are found, each counted once
    monkeypatch.setattr(itq, "WIDTHS", (4,))
    monkeypatch.setattr(itq.Itq, "calibrated", lambda self, *a, **k: setattr(self, "maps", self.maps[:, :12]) or setattr(self, "cut", self.cut[:12]) or setattr(self, "tables", 3) or setattr(self, "table_bits", 4) or self)
    assert run(spark, rows, fit_rows=400) == want


def test_given_vectors_with_planted_pairs(spark):
    """The given vectors hold no pair at 0.95: each third one gets a partner."""
    given = np.array([list(r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()])
    rng = np.random.default_rng(2)
    unit = given / np.linalg.norm(given, axis=1)[:, None]
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([given, at_cosine(rng, unit[::3], 0.951)]))]
    got, want = run(spark, rows, "double"), brute(rows, kind=np.float64)
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert there >= 330 and 0.95 * there <= found <= there


def test_doubles_are_compared_as_doubles(spark):
    """Two vectors whose cosine is on the other side of the threshold once rounded to floats."""
    angle = math.acos(0.95)
    rows = [(1, [1.0, 0.0]), (2, [math.cos(angle - 1e-12), math.sin(angle - 1e-12)]), (3, [math.cos(angle + 1e-9), -math.sin(angle + 1e-9)])]
    assert run(spark, rows, "double") == [("1", 1, "1"), ("2", 1, "1"), ("3", 0, "3")] == brute(rows, kind=np.float64)

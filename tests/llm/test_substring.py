import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from motionfield.llm.substring import parse, substring_dedup


def brute(docs, window=50):
    """(id, n_words, n_removed, kept): null ids come last; rows with one id don't remove from each other."""
    last = 2**63
    order = lambda i: last if i is None else i
    words = [(t or "").encode().split() for _, t in docs]
    first = {}
    for (i, _), w in zip(docs, words, strict=True):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, last + 1), order(i))
    out = []
    for (i, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < order(i):
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((repr(i), len(w), len(w) - len(kept), b" ".join(kept).decode()))
    return sorted(out)


def run(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, [1], "x", 3) for i, t in docs], "doc_id long, text string, spans array<int>, mf_text string, n_words int").repartition(3)
    done = substring_dedup(df, **kw).cache()
    words = lambda t: (t or "").encode().split()
    by_id = {}
    for i, t in docs:
        by_id.setdefault(i, []).append(words(t))
    for r in done.collect():
        at = 0
        for f in r.factors:
            # in order, each a copy of what its reference holds, together the spans
            assert f.start >= at and (f.ref_id is None or r.doc_id is None or f.ref_id < r.doc_id)
            part = words(r.text)[f.start : f.end]
            assert any(t[f.ref_start : f.ref_start + len(part)] == part for t in by_id[f.ref_id])
            at = f.end
        covered = {k for f in r.factors for k in range(f.start, f.end)}
        assert covered == {k for x in r.spans for k in range(x.start, x.end)} and len(covered) == r.n_removed
    assert done.columns[:3] == ["doc_id", "text", "mf_text"] or "mf_text" not in done.columns
    return sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in done.collect())


def test_random_documents_with_shared_passages(spark):
    rng = random.Random(11)
    for vocabulary, window, seed in ((4000, 50, 16), (3, 12, 5), (2, 9, 9)):
        word = lambda: f"w{rng.randrange(vocabulary)}"  # noqa: E731, B023
        shared = [[word() for _ in range(rng.choice([window - 1, window, window + 1, 3 * window]))] for _ in range(8)]
        shared += [["same"] * (2 * window), ["a", "b"] * window, shared[0] + shared[1]]
        docs = []
        for k in range(60):
            parts = []
            for _ in range(rng.randint(0, 5)):
                parts += rng.choice(shared) if rng.random() < 0.6 else [word() for _ in range(rng.randint(1, 40))]
            docs.append((rng.randrange(1000) if rng.random() < 0.1 else k, " ".join(parts)))
        docs += [(None, " ".join(shared[3] * 3)), (None, " ".join(shared[3] * 3)), (70, None), (71, ""), (72, docs[5][1]), (72, docs[5][1]), (73, "the " * 30000)]
        assert run(spark, docs, window=window, seed=seed) == brute(docs, window)


def test_empty_table_and_white_space(spark):
    assert run(spark, []) == []
    text = "a\tb\x0bc d \x1fe\n"
    assert run(spark, [(1, text)]) == [("1", 4, 0, "a b c d \x1fe")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(5, 12), st.integers(0, 3), st.integers(0, 30)), min_size=1, max_size=25))
def test_parse_takes_the_furthest_match(pieces):
    factors = parse(*(np.array(x, np.int64) for x in zip(*pieces, strict=True)))
    assert {k for s, e, _, _ in factors for k in range(s, e)} == {k for s, n, _, _ in pieces for k in range(s, s + n)}
    for (_, e, _, _), (s, _, _, _) in zip(factors, factors[1:]):
        assert s >= e
    # a shortest cover by the maximal matches: greedy is as short as any
    cover = {}
    for s, n, r, k in pieces:
        cover.setdefault((r, k - s), set()).update(range(s, s + n))
    at, best = 0, []
    every = sorted({k for x in cover.values() for k in x})
    while left := [k for k in every if k >= at]:
        k = left[0]
        end = max(next(j for j in range(k, 99) if j not in x) for x in cover.values() if k in x)
        best.append((k, end))
        at = end
    assert [(s, e) for s, e, _, _ in factors] == best

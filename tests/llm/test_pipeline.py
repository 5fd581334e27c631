import random

import corpus_pipeline as P
from motionfield.llm.queries import pipeline

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text, n=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def test_near_dedup_stage_against_jaccard(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    kept = {r.doc_id for r in P.near_dedup(spark, docs, SF).collect()}
    sets = {r.doc_id: shingles(r.text) for r in rows}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        best = max((len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) for b in ids[:i]), default=0)
        if best >= 0.9 or (best == 1 and sets[a]):
            assert a not in kept, (a, best)
        # clean documents stay
        others = max((len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) for b in ids if b != a), default=0)
        if others < 0.5:
            assert a in kept, (a, others)


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == COLUMNS, name
        assert 0 < after.count() <= before.count()
        before = after
    texts = {r.doc_id: r.text for r in before.collect()}
    seen = {}
    for i in sorted(texts):
        w = (texts[i] or "").split(" ")
        assert not any(tuple(w[k : k + 120]) in seen for k in range(0, max(0, len(w) - 119)))
        seen |= {tuple(w[k : k + 120]): i for k in range(max(0, len(w) - 119))}


def test_stages_on_edges(spark):
    rng = random.Random(0)
    body = " ".join(f"w{rng.randrange(900)}" for _ in range(300))
    rows = [(1, body), (2, body), (None, body), (3, None), (4, ""), (5, body + " end"), (6, "short text"), (6, "short text")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t else None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id or 0 for r in P.near_dedup(spark, docs, SF).collect()) == [1, 3, 6]
    cut = {r.doc_id: r for r in P.repeated_passages(spark, docs, SF).collect()}
    assert cut[1].text == body and cut[2].text == "" and cut[2].n_chars == 0 and cut[5].text == "end" and cut[3].text is None and cut[6].text == "short text"
    assert len(P.benchmark_passages(spark, docs, SF).collect()) == len(rows)
    judged = {r.doc_id or 0 for r in P.quality_filter(spark, docs, SF).collect()}
    assert judged <= {0, 1, 2, 3, 4, 5, 6}
    pieces = P.packing(spark, docs, SF).collect()
    assert sorted({(r.doc_id or 0, r.doc_tokens) for r in pieces if not r.start}) and sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert [r.doc_tokens for r in pieces if r.doc_id in (3, 4)] == [1, 1] and sum(r.doc_id == 6 for r in pieces) >= 2
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []


def test_near_dedup_judges_rows_by_their_own_text(spark):
    rng = random.Random(1)
    a, b, c = (" ".join(f"w{rng.randrange(900)}" for _ in range(60)) for _ in range(3))
    rows = [(1, a), (7, a), (7, b), (None, c), (None, c), (9, b), (7, b), (2, c + " more")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in P.near_dedup(spark, docs, SF).collect()) == sorted([(1, a), (7, b), (2, c + " more")])


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like an operator's own come through with their values."""
    names = ["mf_id", "mf_key", "score", "top_passage", "n_words", "n_removed", "kept_text", "spans", "factors", "id", "key", "stay", "label", "mf_text", "mf_pieces", "own_column_3"]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    wide = docs.selectExpr("*", *[f"concat('{n}', doc_id) as {n}" for n in names])
    for name, stage in P.STAGES[:-1]:
        plain = sorted(map(tuple, stage(spark, docs, SF).collect()), key=str)
        got = stage(spark, wide, SF)
        assert got.columns == wide.columns, name
        rows = got.collect()
        assert sorted((tuple(r)[:5] for r in rows), key=str) == plain and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name


def test_very_long_texts(spark):
    """A text of 150,000 words goes through every stage; its copy goes."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(40_000)}" for _ in range(150_000))
    docs = spark.createDataFrame([(1, long, "en", "s", len(long)), (2, long, "en", "s", len(long)), (3, "short", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r[0] for r in P.quality_filter(spark, docs, SF).select("doc_id").collect()} <= {1, 2, 3}
    assert sorted(r[0] for r in P.near_dedup(spark, docs, SF).select("doc_id").collect()) == [1, 3]
    cut = {r.doc_id: r.text for r in P.repeated_passages(spark, docs, SF).collect()}
    assert cut == {1: long, 2: "", 3: "short"}
    assert P.benchmark_passages(spark, docs, SF).count() == 3
    pieces = P.packing(spark, docs, SF).filter("doc_id = 1").collect()
    assert sum(r.length for r in pieces) == pieces[0].doc_tokens > 150_000


def test_whole_pipeline_against_brute_force(spark):
    """All stages on all given documents, the classifier's scores taken as they are."""
    import glob
    import re

    from tokenizers import Tokenizer

    from motionfield.llm.queries import tokenizer_path

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {r.doc_id: r.text for r in P.quality_filter(spark, docs, sf).collect()}
    sets = {i: shingles(t) for i, t in left.items()}
    ids, label = sorted(left), {i: i for i in left}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if (both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)) or not (sets[a] or sets[b]):
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    left = {i: left[i] for i in ids if top(i) == i}
    starts, cut = {}, {}
    for i in sorted(left):
        w = (left[i] or "").encode().split()
        windows = [tuple(w[k : k + 50]) for k in range(len(w) - 49)]
        gone = {p for k, x in enumerate(windows) if starts.get(x, i) < i for p in range(k, k + 50)}
        for x in windows:
            starts.setdefault(x, i)
        cut[i] = b" ".join(x for k, x in enumerate(w) if k not in gone).decode() if gone else left[i]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    held = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        v = words(r.text)
        n = min(13, len(v))
        held |= {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if v else set()
    kept = {}
    for i, t in cut.items():
        w = words(t)
        hit = {p for n in {len(x) for x in held} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in held for p in range(k, k + n)}
        if not hit or 20 * len(hit) < len(w):
            kept[i] = t
    tool = Tokenizer.from_file(tokenizer_path())
    want = {i: tool.encode(t or "", add_special_tokens=False).ids + [1] for i, t in kept.items()}
    rows = P.run(spark, sf).collect()
    got, windows = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        piece = [int.from_bytes(r.ids[k : k + 4], "little") for k in range(0, len(r.ids), 4)]
        assert r.start == len(got.setdefault(r.doc_id, [])) and len(piece) == r.length
        got[r.doc_id] += piece
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == want and 0 < len(want) < docs.count()
    for parts in windows.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    # of the pipeline's tables the last stage's alone is left
    assert len(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/mf-stage*")) == 1


def test_query(spark):
    assert pipeline(spark, "/root/testdata/sf0.001").count() > 0

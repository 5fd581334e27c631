import math
import random
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

import motionfield.llm.mil as mil

from motionfield.llm.mil import FEATURES, PASSAGE, GatedAttention, NoisyOr, Passages, features, fit_attention, fit_noisy_or, labelled_sample, passage_features, score_quality, score_toxicity, sentences, word_features
from motionfield.llm.queries import op3_toxicity, op10_quality

SF = "/root/testdata/sf0.01"
MORE = "/root/testdata/sf0.1"


def accuracy(spark, query, label, sf):
    rows = query(spark, sf).cache()
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    joined = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    held = [r for r in joined if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in joined)
    return sum(r.predicted == r[label] for r in held) / len(held)


def test_quality_on_held_out(spark):
    assert accuracy(spark, op10_quality, "quality", SF) >= 0.95


def test_toxicity_on_held_out(spark):
    assert accuracy(spark, op3_toxicity, "toxic", MORE) >= 0.96


def test_noisy_or_locates_the_sentence():
    rng = random.Random(0)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") * 2
    texts, y = [], []
    for k in range(400):
        body = [[word() for _ in range(8)] for _ in range(6)]
        if k % 2:
            body[k % 6][3] = "nasty"
        texts.append(". ".join(" ".join(s) for s in body))
        y.append(k % 2)
    model = NoisyOr(16).fit([features(sentences(t), 16) for t in texts], np.array(y))
    for k in range(20):
        p = model.sentence_scores(sentences(texts[k]))
        assert (p >= 0.5).any() == bool(y[k])
        if y[k]:
            assert int(p.argmax()) == k % 6


def plain_attention(model, text):
    """The score of a text, passage by passage and word by word."""
    words = text.encode().split() if text else []
    x = passage_features(text)[0]
    hs, es = [], []
    for k in range(len(x)):
        some = words[k * PASSAGE : (k + 1) * PASSAGE]
        mean = [sum(model.p["E"][xxhash.xxh64_intdigest(w) >> 52][n] for w in some) / max(1, len(some)) for n in range(8)]
        v = [*((x[k].astype(float) - model.mean) / model.scale), *mean]
        h = [math.tanh(sum(v[i] * model.p["A"][i][j] for i in range(len(v))) + model.p["a"][j]) for j in range(16)]
        gate = [math.tanh(sum(h[i] * model.p["V"][i][j] for i in range(16))) / (1 + math.exp(-sum(h[i] * model.p["U"][i][j] for i in range(16)))) for j in range(8)]
        hs.append(h)
        es.append(math.exp(sum(g * w for g, w in zip(gate, model.p["w"], strict=True))))
    z = [sum(e * h[j] for e, h in zip(es, hs, strict=True)) / sum(es) for j in range(16)]
    return 1 / (1 + math.exp(-sum(c * q for c, q in zip(model.p["c"], z, strict=True)) - float(model.p["b"][0]))), int(np.argmax(es))


def test_queries_equal_the_plain_models(spark):
    """Scores of both queries' models, recomputed sentence by sentence and passage by passage."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.limit(40).collect()}
    some = docs.filter(F.col("doc_id").isin(list(texts)))
    tox = fit_noisy_or(labelled_sample(docs, labels, "toxic", 500))
    for r in score_toxicity(some, tox).collect():
        found, none, hits = sentences(texts[r.id]), 1.0, []
        for k, words in enumerate(found):
            p = 1 / (1 + math.exp(-max(-30, min(30, tox.bias + sum(float(tox.weights[f]) for w in words for f in word_features(w, 20))))))
            none *= 1 - p
            hits += [k] if p >= 0.5 else []
        assert abs(r.score - (1 - none)) < 1e-5 and r.offending == hits
    good = fit_attention(labelled_sample(docs, labels, "quality", 500))
    for r in score_quality(some, good).collect():
        want = plain_attention(good, r.text)
        assert abs(r.score - want[0]) < 1e-6 and r.top_passage == want[1]


def test_attention_learns_from_words_and_from_counts():
    rng = np.random.default_rng(0)
    for by_word in (False, True):
        docs, y = [], []
        for k in range(60):
            n = int(rng.integers(1, 5))
            x, words = rng.normal(size=(n, FEATURES)), rng.integers(0, 300, 64 * n - 10)
            if by_word and k % 2:
                words[rng.integers(0, len(words), 6)] = 999
            docs.append((x.astype(np.float32), words.astype(np.int16)))
            y.append(float(k % 2) if by_word else float(x[:, 0].max() > 0.8))
        model = GatedAttention().fit(docs, np.array(y), epochs=200, batch=60)
        assert ((model.score(Passages(docs))[0] >= 0.5) == (np.array(y) == 1)).mean() >= 0.9


def test_gradients_of_attention_by_differences():
    rng = np.random.default_rng(4)
    docs = [(rng.normal(size=(n, FEATURES)).astype(np.float32), rng.integers(0, 50, 64 * n - 7).astype(np.int16)) for n in (1, 3, 2)]
    y = np.array([1.0, 0.0, 1.0])
    start = GatedAttention().fit(docs, y, epochs=0)
    moved = GatedAttention().fit(docs, y, epochs=1, batch=3, rate=1e-6)

    def loss(p):
        m = GatedAttention()
        m.p, m.mean, m.scale = p, start.mean, start.scale
        s = m.score(Passages(docs))[0]
        return -np.mean(y * np.log(s) + (1 - y) * np.log(1 - s))

    for name in start.p:
        for _ in range(5):
            at = tuple(int(rng.integers(0, min(n, 50))) for n in start.p[name].shape)
            slopes = []
            for by in (1e-5, -1e-5):
                p = {n: v.copy() for n, v in start.p.items()}
                p[name][at] += by
                slopes.append(loss(p))
            slope = (slopes[0] - slopes[1]) / 2e-5
            # the first step of the optimiser goes against the sign of the slope
            if abs(slope) > 1e-5:
                assert np.sign(start.p[name][at] - moved.p[name][at]) == np.sign(slope), (name, at)


def test_fit_is_bounded_in_rows_and_bytes(spark):
    rows = [(k % 7, f"word{k} " * (5000 if k == 3 else 5), k % 2) for k in range(60)] + [(99, "same text", 1)] * 40
    df = spark.createDataFrame(rows, "h long, text string, y int")
    for most, most_bytes in ((10, 1 << 30), (1000, 3000), (1000, 10)):
        for encoded in (df.mapInArrow(mil._sentence_rows(12), "h long, size long, words binary, starts binary, y int"), df.mapInArrow(mil._passage_rows, "h long, size long, x binary, words binary, y int")):
            got = mil.bounded_rows(encoded, most, most_bytes, "test")
            assert 1 <= len(got) <= most and (len(got) == 1 or sum(r["size"] for r in got) <= most_bytes)
    fit_noisy_or(df, 12, most=20)
    fit_attention(df, most=20)


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " \n\t"), (None, "some words. more"), (4, "x" * 200_000), (4, "x" * 200_000), (5, "!!! ... ???")]
    df = spark.createDataFrame([(i, t, 0.5, "c") for i, t in docs], "doc_id long, text string, score double, lang string")
    tox = NoisyOr(16).fit([], np.empty(0))
    got = score_toxicity(df, tox).collect()
    assert sorted(map(repr, (r.id for r in got))) == sorted(repr(i) for i, _ in docs) and all(0 <= r.score <= 1 for r in got)
    model = GatedAttention().fit([passage_features("some text")], np.array([1.0]))
    got = score_quality(df, model).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got) and got[0].lang == "c"
    assert score_quality(df.limit(0), model).collect() == [] and score_toxicity(df.limit(0), tox).collect() == []


def test_sample_is_bounded_and_leaves_out_the_fold(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(200)], "doc_id long, text string")
    got = labelled_sample(docs, labels, "toxic", 50).collect()
    assert len(got) == 50
    assert all(zlib.crc32(r.text[1:].encode()) % 5 for r in got)


def test_fit_weighs_common_words(spark):
    """A word of every toxic document, which is in a third of the sample."""
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") * 2
    rows = []
    for k in range(300):
        body = [[word() for _ in range(8)] for _ in range(4)]
        if k < 100:
            body[k % 4][3] = "nasty"
        rows.append((". ".join(" ".join(s) for s in body), int(k < 100)))
    model = fit_noisy_or(spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "h long, text string, y int"), 16)
    scores = [1 - np.prod(1 - model.sentence_scores(sentences(t))) for t, _ in rows]
    assert all((p >= 0.5) == bool(y) for p, (_, y) in zip(scores, rows, strict=True))

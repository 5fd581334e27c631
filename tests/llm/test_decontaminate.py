import glob
import os
import random
import re

import pytest

from motionfield.llm.common import LAST_ID
from motionfield.llm.decontaminate import find_items, probably
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=13):
    out = []
    for i, text in docs:
        w = words(text)
        hit, who = [False] * len(w), set()
        for item, t in items:
            v = words(t)
            n = min(window, len(v))
            for o in range(len(v) - n + 1 if v else 0):
                for k in range(len(w) - n + 1):
                    if w[k : k + n] == v[o : o + n]:
                        hit[k : k + n] = [True] * n
                        who.add(item)
        n = sum(hit)
        out.append((repr(i), len(w), n, sorted(map(str, who - {None})), n > 0 and 20 * n >= len(w)))
    return sorted(out)


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, win int")
    b = spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, words string")
    rows = find_items(d, b, **kw).collect()
    return sorted((repr(None if r.mf_id == LAST_ID else r.mf_id), r.n_words, r.n_hit, sorted(map(str, r.item_ids)), r.contaminated) for r in rows)


def test_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda n=12: "kürbis alpha Beta x1 y2 Zeta ÉTÉ o p q r s".split()[rng.randrange(n)]
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 12, 13, 14, 30])))) for k in range(25)]
    items += [(90, None), (91, "?!"), (None, "only words of nobody here at all but these ones make a window of more"), (3, items[4][1]), (95, "the")]
    docs = []
    for k in range(50):
        parts = [items[rng.randrange(25)][1].upper() if rng.random() < 0.4 else " ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 4))]
        docs.append((k, "; ".join(parts)))
    docs += [(60, None), (61, ""), (None, items[7][1]), (None, items[7][1]), (62, docs[3][1]), (62, docs[3][1]), (63, "the lazy dog " * 20000)]
    want = brute(docs, items)
    assert run(spark, docs, items) == want
    # nothing is broadcast, and bitmaps too small to leave anything out change nothing
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert run(spark, docs, items) == want
        assert run(spark, docs, items, most_bits=64) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("n", [1, 100, 30_000])
def test_bitmap_passes_all_tokens_and_few_others(spark, n):
    tokens = spark.range(n).select(F.xxhash64("id").alias("h"))
    test = probably(tokens, n)
    assert tokens.filter(test(F.col("h"))).count() == n
    others = spark.range(10_000_000, 10_100_000).select(F.xxhash64("id").alias("h"))
    assert others.filter(test(F.col("h"))).count() < 3000


def test_only_probable_hits_are_shuffled(spark):
    """With a benchmark of any size, documents without its shingles send nothing but their own rows."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"w{k}x"), "id") for k in range(50)]).alias("text"))
    items = spark.range(20_000).select(F.col("id").alias("item_id"), F.concat_ws(" ", *[F.concat(F.lit(f"v{k}y"), "id") for k in range(30)]).alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = find_items(docs, items)
        assert found.count() == 2000 and found.filter("n_hit > 0").count() == 0
        assert found.agg(F.sum("n_words")).first()[0] == 100_000
        root = spark.conf.get("spark.checkpoint.dir")
        path = max(glob.glob(f"{root}/mf-decon-places-*"), key=os.path.getmtime)
        assert spark.read.parquet(path).count() < 2000 + 0.05 * 96_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b")]) == []
    assert run(spark, [(1, "a b")], []) == [("1", 2, 0, [], False)]
    assert run(spark, [(1, "a b")], [(1, "...")]) == [("1", 2, 0, [], False)]

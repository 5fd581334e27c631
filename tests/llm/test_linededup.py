import random
import re

import pytest

from motionfield.llm.linededup import kept_lines, line_dedup, repeated_lines
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "a line that says the same in many documents"


def key(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(LOWER)


def brute(docs, least_chars=40, least_docs=5):
    ident = [(2**63 - 1 if i is None else i, t or "") for i, t in docs]
    held = {}
    for d in set(ident):
        for line in d[1].split("\n"):
            held.setdefault(key(line), set()).add(d)
    out = []
    for (i, _), d in zip(docs, ident, strict=True):
        lines = d[1].split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least_chars and len(held[key(x)]) >= least_docs and d[0] < max(held[key(x)])[0])]
        out.append((repr(i), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def run(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, pos int, h1 string").repartition(3)
    return sorted((repr(r.id), r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup(df, **kw).collect())


def test_against_brute_force(spark):
    rng = random.Random(4)
    pool = [f"{k} Une ligne répétée que l'on retrouve à bien des endroits, numéro {k}" for k in range(6)] + ["short", "", "x" * 39, "é" * 40, "y" * 40]
    docs = []
    for k in range(60):
        lines = [rng.choice(["", " ", "\t", "\x0b"]) + (rng.choice(pool).upper() if rng.random() < 0.2 else rng.choice(pool)) + rng.choice(["", "\r", " \x0c"]) for _ in range(rng.randint(0, 12))]
        docs.append((k, "\n".join(lines)))
    docs += [(70, None), (71, ""), (72, "\n\n"), (5, docs[5][1]), (6, docs[7][1]), (None, docs[3][1]), (None, docs[4][1]), (80, ("only here and in no other document, again and again\n") * 3000 + pool[0] + "\n" + LONG)]
    assert run(spark, docs) == brute(docs)
    assert run(spark, docs, least_docs=2, least_chars=5) == brute(docs, 5, 2)


@pytest.mark.parametrize("at", [[0], [1, 2], [0, 2, 3], [62, 63, 64, 199], list(range(200))])
def test_bitmaps_drop_the_lines_they_name(spark, at):
    lines = [f"{k} {LONG}" if k in at else str(k) for k in range(200)]
    docs = [(k, "\n".join(lines)) for k in range(4)] + [(4, "\n".join(f"{k} {LONG}" for k in range(200)))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = repeated_lines(df).orderBy("mf_id").collect()
    assert [r.mf_id for r in rows] == [0, 1, 2, 3]
    runs = rows[0].runs
    assert [k for k in range(sum(runs)) if sum(n for n in runs[: next(i for i in range(len(runs)) if k < sum(runs[: i + 1]))]) <= k and next(i for i in range(len(runs)) if k < sum(runs[: i + 1])) % 2] == at
    kept = df.filter("doc_id = 0").select(kept_lines(F.col("text"), F.lit(None).cast("array<int>")).alias("all"), kept_lines(F.col("text"), F.array(*map(F.lit, runs))).alias("k")).first()
    assert kept["all"] == docs[0][1] and kept.k == "\n".join(x for k, x in enumerate(lines) if k not in at)


def test_edges(spark):
    assert run(spark, []) == []
    same = [(k, LONG) for k in range(4)]
    assert run(spark, same) == brute(same) and all(r[2] == 0 for r in run(spark, same))
    five = [*same, (9, f"{LONG}\n{LONG}\n")]
    assert [r[1:] for r in run(spark, five)] == [(1, 1, "")] * 4 + [(3, 0, f"{LONG}\n{LONG}\n")]


def test_a_line_of_all_documents_is_shared_by_many_tasks(spark):
    """The range of a hot line's hash is cut between documents."""
    df = spark.range(0, 4000, 1, 8).select(F.col("id").alias("doc_id"), F.lit(LONG).alias("text"))
    from motionfield.llm.linededup import line_hashes

    ranged = line_hashes(df, "doc_id", "text", 40).repartitionByRange(8, "h1", "h2", F.desc("mf_id"), "mf_key")
    sizes = [r[1] for r in ranged.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 6 and max(sizes) < 1500
    assert [r.mf_id for r in repeated_lines(df).agg(F.count("*").alias("n"), F.max("mf_id").alias("mf_id")).collect()] == [3998]

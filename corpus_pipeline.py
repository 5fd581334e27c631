"""A corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; ``run`` writes each stage's result to the shared folder and reads it
again as the next stage's ``docs``.

In all stages null and empty texts are documents without words, null ids come
after all others, columns that ``docs`` has beside those of documents are kept
whatever their names, and an empty table gives an empty table.  Rows that
repeat an id and a text are judged alike; of such rows the near-duplicate
stage keeps one.  Rows with one id and different texts are different documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionfield.llm.common import with_row_key
from motionfield.llm.decontaminate import find_items
from motionfield.llm.mil import fit_attention, labelled_sample, score_quality
from motionfield.llm.nearsets import one_of_each
from motionfield.llm.packing import pack
from motionfield.llm.queries import FIT_ROWS, table, tokenizer_path
from motionfield.llm.substring import substring_dedup
from motionfield.storage import fresh_path, handed_out, remove_since, write_table

QUALITY = 0.3
#: Near duplicates share 0.8 or more of their 5-word shingles (Jaccard of the two sets).
NEAR = {"shingle": 5, "least": 0.8}


def shielded(docs: DataFrame, stage) -> DataFrame:
    """``stage`` of ``docs`` with its extra columns under names that no operator uses."""
    own = {c: c if c in ("doc_id", "text", "n_chars") else f"own_column_{k}" for k, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()])
    return stage(renamed).select(*[F.col(n).alias(c) for c, n in own.items()])


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the attention classifier scores below ``QUALITY``."""
    model = fit_attention(labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", FIT_ROWS))
    return shielded(docs, lambda d: score_quality(d, model).filter(F.col("score") >= QUALITY))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group; documents without words are one group."""
    return shielded(docs, lambda d: one_of_each(d, **NEAR))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every run of 50 words that also starts in a document with a smaller id; texts that lose nothing stay as they are."""
    lost = F.col("n_removed") > 0

    def stage(d):
        cut = substring_dedup(d)
        if "n_chars" in d.columns:
            cut = cut.withColumn("n_chars", F.when(lost, F.length("kept_text").cast(d.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
        return cut.withColumn("text", F.when(lost, F.col("kept_text")).otherwise(F.col("text")))

    return shielded(docs, stage)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which 1 word in 20 or more lies in a window of a benchmark item."""
    found = find_items(docs, table(spark, sf_dir, "benchmark"))
    gone = found.filter("contaminated").select("mf_id", "mf_key").distinct()
    return shielded(docs, lambda d: with_row_key(d, "doc_id", "text").join(gone.hint("merge"), ["mf_id", "mf_key"], "left_anti"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return pack(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("packing", packing),
]

#: SQL can't express a classifier, SimHash or a tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; of their tables the last alone stays in the shared folder."""
    docs, mark = table(spark, sf_dir, "documents"), handed_out()
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage{k}")
        docs = write_table(stage(spark, docs, sf_dir), path)
        # what the stage has read and made on its way is no longer read
        remove_since(spark, mark, (path,))
    return docs

"""Line dedup: repeated lines found in a table of line hashes sorted by hash, document and position.

DataFrame functions only.  The texts are split once, into 128-bit hashes of
the lines that are long enough.  The hashes are range-partitioned by hash and
document (so the range of a line that stands everywhere is cut between its
documents and shared by many tasks) and sorted by hash, document and position;
each task streams its range and gives one row for each hash: how many documents
hold it, and which of them comes first.  What is returned are compressed keep
bitmaps, one for each document: runs of lines, kept and dropped in turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, materialize, partitions, with_row_key
from .decontaminate import ascii_lower

#: Fixed: the characters stripped off both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_hashes(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(h1, h2, mf_id, mf_key, pos): a row for each line whose key has ``least_chars`` code points or more."""
    base = with_row_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    lines = base.select("mf_id", "mf_key", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # the number of code points is at most that of bytes: short lines are not trimmed at all
    lines = lines.filter(F.octet_length("line") >= least_chars).withColumn("line", F.trim("line", F.lit(BLANKS)))
    key = ascii_lower(F.col("line"))
    return lines.filter(F.length("line") >= least_chars).select(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"), "mf_id", "mf_key", "pos")


def runs_of(positions: Column, count: Column) -> Column:
    """Sorted distinct positions of dropped lines as run lengths, kept and dropped in turn from line 0 to the last dropped one."""
    first = F.filter(positions, lambda p, i: (i == 0) | (F.get(positions, i - 1) != p - 1))
    last = F.filter(positions, lambda p, i: (i == count - 1) | (F.get(positions, i + 1) != p + 1))
    # the lines before a run are kept from the end of the run before
    ends = F.concat(F.array(F.lit(0)), F.transform(last, lambda p: p + 1))
    runs = F.filter(F.arrays_zip(first.alias("first"), last.alias("last"), ends.alias("before")), lambda r: r["first"].isNotNull())
    return F.flatten(F.transform(runs, lambda r: F.array(r["first"] - r["before"], r["last"] - r["first"] + 1)))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """(mf_id, mf_key, runs): the keep bitmap of each document that loses a line, keyed as by ``with_row_key``.

    A line's key is the line without blanks at its ends, A-Z lower-cased; a
    key of ``least_chars`` code points or more in ``least_docs`` documents or
    more keeps its lines in the document with the largest id only (in all rows
    with this id).  ``runs`` are numbers of lines, kept and dropped in turn
    from the first line on; lines after the last run are kept.

    Null ids are larger than all others; rows equal in id and text are one
    document, rows with one id and different texts are two; documents that
    lose nothing have no row; null and empty texts have one empty line; other
    columns are not read; an empty table gives an empty result.
    """
    document = ["h1", "h2", "mf_id", "mf_key"]
    hashes = materialize(line_hashes(docs, id_col, text_col, least_chars), "line-hashes")
    ranged = hashes.repartitionByRange(partitions(docs.sparkSession), "h1", "h2", F.desc("mf_id"), "mf_key").sortWithinPartitions("h1", "h2", F.desc("mf_id"), "mf_key", "pos")
    # the range partitioning holds for the first grouping: only rows for hashes move on
    holders = ranged.groupBy(*document).agg(F.min("pos").alias("pos")).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("mf_id").alias("keeper"))
    repeated = materialize(holders.filter(F.col("n") >= least_docs).drop("n"), "line-repeats")
    gone = hashes.join(repeated, ["h1", "h2"]).filter("mf_id < keeper")
    lost = gone.groupBy("mf_id", "mf_key").agg(F.sort_array(F.collect_set("pos")).alias("gone")).withColumn("n", F.size("gone"))
    return lost.select("mf_id", "mf_key", runs_of(F.col("gone"), F.col("n")).alias("runs"))


def kept_lines(text: Column, runs: Column) -> Column:
    """The text without the lines that a keep bitmap drops."""
    keep = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    lines = F.split(text, "\n", -1)
    # lines beyond the bitmap meet nulls and stay; array_join leaves out nulls
    return F.when(runs.isNull(), text).otherwise(F.array_join(F.zip_with(lines, keep, lambda line, k: F.when(F.coalesce(k, F.lit(True)), line)), "\n"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(mf_id, mf_key, runs, n_lines, n_dropped, kept_text): a row for each row of ``docs``, whose texts meet their bitmaps here."""
    base = with_row_key(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "doc_id", "text")
    # keyed by the text that is never null, on both sides; no bound for the documents that lose lines: never broadcast
    found = base.join(repeated_lines(base, "doc_id", "text", **how).hint("merge"), ["mf_id", "mf_key"], "left")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    dropped = F.aggregate(F.transform("runs", lambda n, i: F.when(i % 2 == 1, n).otherwise(0)), F.lit(0), lambda a, x: a + x)
    return found.select(
        F.when(F.col("mf_id") != F.lit(LAST_ID), F.col("mf_id")).alias("id"), "mf_key", "runs", n_lines.cast("long").alias("n_lines"),
        F.coalesce(dropped, F.lit(0)).cast("long").alias("n_dropped"), kept_lines(F.col("text"), F.col("runs")).alias("kept_text"),
    )

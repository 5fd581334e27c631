"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

DataFrame functions only.  A window's tokens are its shingles; since a
document must hold all of them, one prefix token is enough: the shingle that
is rarest in the corpus.  Every document is split into words once, and the
places of the benchmark's shingles in it are kept; from these come the
shingles' frequencies, the windows' prefix tokens and, by positional and
length bounds, the candidates.  Only documents with candidates are read again,
to compare the words one by one.

Before anything is shuffled, a bitmap of the benchmark's shingles (two probes
for each, at most 32 MB, whatever the benchmark's size) leaves out nearly all
other shingles; a second one does the same for prefix tokens.  What passes by
chance finds no partner in the joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_row_key

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHINGLE = 3
#: Bits of a bitmap for each token that it knows, and the most and least of all.
BITS_EACH, MOST_BITS, LEAST_BITS = 16, 1 << 28, 1 << 12


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; texts without other letters take the faster built-in."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def shingles(w: Column, m: int) -> Column:
    """Hashes of the m-word shingles of a word array, in order."""
    at = lambda i: F.xxhash64(F.lit(m), *[F.get(w, i + k) for k in range(m)])
    return F.when(F.size(w) >= m, F.transform(F.sequence(F.lit(0), F.size(w) - m), at))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(words, item_ids): the distinct windows of all items, with the items that have them."""
    base = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    starts = F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.slice("w", i + 1, size))
    return base.select("item", F.explode(starts).alias("words")).groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))


def covered(spans: Column) -> Column:
    """Number of positions covered by an array of (start, length), sorted by start."""
    state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))

    def step(s, x):
        end = x["start"] + x["length"]
        new = F.greatest(F.lit(0), end - F.greatest(s["end"], x["start"]))
        return F.struct(F.greatest(s["end"], end).alias("end"), (s["total"] + new).alias("total"))

    return F.aggregate(F.array_sort(spans), state, step, lambda s: s["total"])


def probably(tokens: DataFrame, count: int, most_bits: int = MOST_BITS):
    """A test of hashes (a column ``h`` of ``tokens``): true for all of them and for few others."""
    bits = LEAST_BITS
    while bits < min(most_bits, BITS_EACH * count):
        bits *= 2
    probes = lambda h: [h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))]
    place, bit = lambda p: F.shiftright(p, 6).cast("int"), lambda p: p.bitwiseAND(F.lit(63)).cast("int")
    marks = tokens.select(F.explode(F.array(*probes(F.col("h")))).alias("p")).groupBy(place(F.col("p")).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("p")))).alias("b"))
    words = tokens.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b")).unionByName(marks).groupBy("w").agg(F.bit_or("b").alias("b"))
    bitmap = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"])).scalar()

    def test(h: Column) -> Column:
        first, second = [F.call_function("shiftright", F.get(bitmap, place(p)), bit(p)).bitwiseAND(F.lit(1).cast("long")) == 1 for p in probes(h)]
        return first & second

    return test


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", *, window: int = 13, most_bits: int = MOST_BITS) -> DataFrame:
    """(mf_id, mf_key, n_words, n_hit, item_ids, contaminated): a row for each row of ``docs``, keyed as by ``with_row_key``.

    A document word is hit if it lies in an occurrence of a window of any
    item; ``contaminated`` is n_hit > 0 and 20 * n_hit >= n_words.

    Null and empty texts have no words; an item without words has no window;
    a null item id names no item but its words count; equal windows of
    several items give all their ids; rows equal in id and text get equal
    results; empty tables give no hits.
    """
    key = ["mf_id", "mf_key"]
    base = with_row_key(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id", "text")
    # windows with the same items share a number: a passage of many items is followed as one
    wins = item_windows(items, item_id, item_text, window).select("words", "item_ids", F.xxhash64("item_ids").alias("set"), F.monotonically_increasing_id().alias("win"))
    wins = materialize(wins, "decon-windows")
    sets = wins.groupBy("set").agg(F.any_value("item_ids").alias("item_ids"))
    sized = wins.withColumn("m", F.least(F.size("words"), F.lit(SHINGLE)))
    token = F.when(F.col("m") == 3, shingles(F.col("words"), 3)).when(F.col("m") == 2, shingles(F.col("words"), 2)).otherwise(shingles(F.col("words"), 1))
    tokens = materialize(sized.select("win", F.posexplode(token).alias("off", "h"), "m"), "decon-tokens")
    shapes = sorted(r[0] for r in tokens.select("m").distinct().limit(SHINGLE).collect())
    n_tokens = tokens.count()

    # a row for each document (pos -1) and for each place of a benchmark shingle in one
    worded = base.select(*key, words(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    grams = worded.select(*key, "n", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), *[F.coalesce(shingles(F.col("w"), m), F.array().cast("array<long>")) for m in shapes])).alias("pos", "h"))
    # places are numbered shape after shape
    pos, end = F.when(F.col("pos") == 0, -1), F.lit(1)
    for m in shapes:
        begin, end = end, end + F.greatest(F.col("n") - (m - 1), F.lit(0))
        pos = pos.when(F.col("pos") < end, F.col("pos") - begin)
    grams = grams.select(*key, "n", pos.alias("pos"), "h")
    known = probably(tokens.select("h"), n_tokens, most_bits)
    places = materialize(grams.filter((F.col("pos") < 0) | known(F.col("h"))), "decon-places")
    found = places.filter("pos >= 0")

    rare = found.groupBy("h").agg(F.count("*").alias("df"))
    whole = tokens.join(rare, "h").groupBy("win").agg(F.count("*").alias("got"), F.min(F.struct("df", "off", "h")).alias("p"))
    need = tokens.groupBy("win").agg(F.count("*").alias("got"))
    # a window with a token that no document has can't occur
    prefix = materialize(whole.join(need, ["win", "got"]).join(wins, "win").select("p.h", "p.off", "words", "set"), "decon-prefix")
    start = F.col("pos") - F.col("off")
    rarest = probably(prefix.select("h"), n_tokens, most_bits)
    fits = found.filter(rarest(F.col("h"))).join(prefix, "h").filter((start >= 0) & (start + F.size("words") <= F.col("n")))
    asked = materialize(fits.groupBy(*key).agg(F.collect_set(F.struct(start.alias("start"), "words", "set")).alias("asked")), "decon-asked")

    # nor is there a bound for the number of documents with candidates: shuffled at every size
    texts = base.select(*key, "text").join(asked.hint("merge"), key).select(*key, words(F.col("text")).alias("w"), "asked")
    # word by word up to the first that differs: a slice would copy all of a long document
    # (with two uses of w the planner keeps it a column of its own; with one it would be split anew for each candidate)
    true = F.filter("asked", lambda c: (c["start"] + F.size(c["words"]) <= F.size("w")) & F.forall(F.sequence(F.lit(0), F.size(c["words"]) - 1), lambda k: F.get("w", c["start"] + k) == F.get(c["words"], k)))
    hits = texts.select(*key, true.alias("hits")).groupBy(*key).agg(F.any_value("hits").alias("hits")).filter(F.size("hits") > 0)
    per = hits.select(
        *key, covered(F.transform("hits", lambda c: F.struct(c["start"].alias("start"), F.size(c["words"]).alias("length")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda c: c["set"]))).alias("sets"),
    )
    per = materialize(per, "decon-hits")
    # the items of each combination of sets, once
    kinds = per.select("sets").distinct().select("sets", F.explode("sets").alias("set")).join(sets, "set")
    kinds = kinds.groupBy("sets").agg(F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))
    out = places.filter("pos = -1").select(*key, F.col("n").cast("long").alias("n_words")).join(per.join(kinds, "sets", "left").drop("sets"), key, "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(*key, "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast(wins.schema["item_ids"].dataType)).alias("item_ids"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))

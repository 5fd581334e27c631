"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(a long, b long) links to (id, component): the smallest id reachable, for every id that has a link.

    Each round maps every id to the neighbour first in a fixed random order
    and contracts the links, so the tables shrink geometrically whatever the
    shape of the graph; rounds are written to the shared folder.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("r"), F.col(c).alias("id"))
    tidy = lambda e: e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = materialize(tidy(edges), f"{tag}-links")
    levels: list[DataFrame] = []
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("id"), F.least(rank("a"), F.col("m"))["id"].alias("to"))
        to = materialize(to, f"{tag}-to")
        levels.append(to)
        left = to.select(F.col("id").alias("a"), F.col("to").alias("a2"))
        right = to.select(F.col("id").alias("b"), F.col("to").alias("b2"))
        links = materialize(tidy(links.join(left, "a").join(right, "b").select(F.col("a2").alias("a"), F.col("b2").alias("b"))), f"{tag}-links")
    if not levels:
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    found = levels.pop()
    while levels:
        up = found.select(F.col("id").alias("to"), F.col("to").alias("top"))
        found = levels.pop().join(up, "to", "left").select("id", F.coalesce("top", "to").alias("to"))
    found = materialize(found, f"{tag}-found")
    smallest = found.groupBy("to").agg(F.min("id").alias("component"))
    return found.join(smallest, "to").select("id", "component")

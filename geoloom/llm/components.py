"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoloom.llm.tables import stored


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).collect()[0]
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), root being the smallest node of its component.

    In a large star every node links its larger neighbours to the smallest of all, in a small star its smaller ones;
    both keep components and end in stars around their smallest nodes. Each step aggregates and joins by node, so
    adaptive execution can split the rows of a node with very many links. Only a count and a checksum reach the driver.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                   "links")
    before, now = None, _state(edges)
    while now != before:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(
            "a <> b").distinct()
        small = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        edges = stored(small.select("b", "m").unionByName(small.select(F.col("a").alias("b"), "m")).where(
            "b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links")
        before, now = now, _state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

"""Fixpoints over tables of links: all ancestors by deltas, and depths of chains by pointer doubling.

Both run as loops of joins over stored tables, so neither the engine's limit on recursive queries nor the lineage of
earlier rounds bounds them. The driver reads whether a round found anything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from geoloom.functions.geo import quoted
from geoloom.operators.skew import DEFAULT_POLICY, HotPolicy, lookup_join
from geoloom.session import store


def ancestors(links: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """(node, ancestor, distance) of all direct and indirect parents, by the distance of the shortest way.

    Each round follows one more link from the pairs found last and keeps those not found before, so every pair is
    expanded once, however many ways lead to it, and cycles end. Rounds are stored as deltas; what is known is their
    union. Links with a null end are left out.
    """
    edges = store(links.select(quoted(node).alias("node"), quoted(parent).alias("parent")).dropna().distinct(), "edges")
    newest = store(edges.select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")), "delta")
    deltas = [newest]
    step = edges.select(F.col("node").alias("ancestor"), F.col("parent").alias("next"))
    while not newest.isEmpty():
        known = reduce(DataFrame.unionByName, deltas).select("node", "ancestor")
        further = newest.join(step, "ancestor").select(
            "node", F.col("next").alias("ancestor"), (F.col("distance") + 1).alias("distance")).distinct()
        newest = store(further.join(known, ["node", "ancestor"], "left_anti"), "delta")
        deltas.append(newest)
    return reduce(DataFrame.unionByName, deltas)


def chain_depths(
    links: DataFrame, node: str = "node", parent: str = "parent", policy: HotPolicy = DEFAULT_POLICY
) -> DataFrame:
    """(node, root, depth) of every node with a parent, where every node has one parent at most.

    Every node points some links ahead. In a round each pointer that has not reached a root moves on by the pointer it
    points at, so its reach doubles: a chain of n links takes log2(n) rounds, each with a join of all open pointers.
    Nodes that many point at are salted. A cycle is refused, repeated links count once.
    """
    given = links.select(quoted(node).alias("node"), quoted(parent).alias("root")).dropna().distinct()
    jumps = store(given.withColumn("depth", F.lit(1).cast("bigint")), "jumps")
    count = jumps.count()
    if jumps.select("node").distinct().count() != count:
        raise ValueError("A node has more than one parent.")
    roots = store(jumps.select("root").distinct().join(jumps.select(F.col("node").alias("root")), "root", "left_anti"), "roots")
    done: list[DataFrame] = []
    for _ in range(count.bit_length() + 1):
        ended = jumps.join(roots, "root", "left_semi").select("node", "root", "depth")
        done.append(ended)
        going = jumps.join(roots, "root", "left_anti")
        if going.isEmpty():
            return reduce(DataFrame.unionByName, done)
        ahead = reduce(DataFrame.unionByName, [*done, going]).select(
            F.col("node").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        moved = lookup_join(going, ahead, "root", "inner", policy)
        jumps = store(moved.select("node", F.col("next").alias("root"), (F.col("depth") + F.col("more")).alias("depth")), "jumps")
    raise ValueError("The links hold a cycle.")

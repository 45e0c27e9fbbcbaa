"""Closures and chains against plain Python, sketches against exact ranks and counts."""

import random

import pytest
from pyspark.sql import functions as F

from geoloom.operators.closure import ancestors, chain_depths
from geoloom.operators.skew import DEFAULT_POLICY
from geoloom.operators.sketches import COUNT_ERROR, RANK_ERROR, merge_sketches, read_sketches, sketch
from tests.conftest import values


def test_all_ancestors_with_cycles_and_many_ways(spark):
    rnd = random.Random(2)
    links = [(rnd.randrange(30), rnd.randrange(30)) for _ in range(45)] + [(1, 1), (None, 3), (4, None)]
    want = set()
    for node in range(30):
        seen, ring, distance = {}, {node}, 0
        while ring:
            distance += 1
            ring = {p for n, p in links if n in ring and p is not None} - set(seen)
            seen.update(dict.fromkeys(ring, distance))
        want |= {(node, a, d) for a, d in seen.items()}
    got = ancestors(spark.createDataFrame(links, "node int, parent int"))
    assert set(values(got)) == want and got.count() == len(want)
    assert ancestors(spark.createDataFrame([], "node int, parent int")).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_depths_of_chains_and_trees(spark, tiny, hot):
    rnd = random.Random(5)
    parent = {i: rnd.randrange(max(0, i - 40), i) if i % 50 else None for i in range(600)}
    parent |= {10_000 + i: 3 for i in range(200)}  # many nodes below one that is no root
    links = spark.createDataFrame([(n, p) for n, p in parent.items()] * 2, "node int, parent int")
    want = {}
    for node in parent:
        root, depth = node, 0
        while parent.get(root) is not None:
            root, depth = parent[root], depth + 1
        if depth:
            want[node] = (root, depth)
    got = chain_depths(links, policy=tiny if hot else DEFAULT_POLICY)
    assert {r.node: (r.root, r.depth) for r in got.collect()} == want and got.count() == len(want)


def test_one_long_chain(spark):
    """Far beyond what one recursion may return row by row."""
    n = 100_000
    got = chain_depths(spark.range(1, n).select(F.col("id").alias("node"), (F.col("id") - 1).alias("parent")))
    assert got.where("root <> 0 OR depth <> node").count() == 0 and got.count() == n - 1


def test_chains_that_are_none(spark):
    with pytest.raises(ValueError):
        chain_depths(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node int, parent int"))
    with pytest.raises(ValueError):
        chain_depths(spark.createDataFrame([(1, 2), (1, 3)], "node int, parent int"))
    assert chain_depths(spark.createDataFrame([(1, None)], "node int, parent int")).count() == 0


def test_merged_sketches_stay_within_their_errors(spark):
    df = spark.range(60_000).selectExpr("id % 4 AS fine", "id % 2 AS g", "CAST(id * 7919 % 60013 AS DOUBLE) AS v", "id % 9000 AS k")
    for q in (0.1, 0.5, 0.99):
        read = read_sketches(merge_sketches(sketch(df, ["fine", "g"], "v", "k"), ["g"]), q)
        rows = df.join(read, "g").groupBy("g").agg(
            F.avg((F.col("v") <= F.col("estimate")).cast("int")).alias("rank"), F.count_distinct("k").alias("k"),
            F.max("distinct_estimate").alias("d"), F.max("n").alias("n")).collect()
        assert len(rows) == 2
        for r in rows:
            assert r.n == 30_000 and abs(r["rank"] - q) <= 2 * RANK_ERROR and abs(r.d / r.k - 1) <= COUNT_ERROR
    odd = spark.sql("SELECT * FROM VALUES (1, CAST(NULL AS DOUBLE), 'x'), (1, DOUBLE('NaN'), NULL) AS t(g, v, k)")
    assert read_sketches(sketch(odd, ["g"], "v", "k")).collect() == [(1, 2, None, 1)]

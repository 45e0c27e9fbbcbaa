"""Recall against brute force, ranking, and the defined cases."""

import numpy as np
import pytest

from geoloom.llm import neighbours
from geoloom.llm.neighbours import Block, products, search
from geoloom.llm.neighbours_query import op4_neighbours


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall(spark, scale):
    folder = f"/root/testdata/{scale}"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    ids, vectors = table.vec_id.to_numpy(), np.stack(table.embedding.to_numpy()).astype(float)
    out = op4_neighbours(spark, folder).toPandas()
    asked = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    assert len(out) == 20 * len(asked)
    recall = []
    for i in asked:
        scores = products(vectors, vectors[i])
        scores[i] = -np.inf
        want = ids[np.lexsort((ids, -scores))][:20]
        got = out[out.query_id == ids[i]].sort_values("rank")
        assert got["rank"].tolist() == list(range(1, 21)) and ids[i] not in set(got.vec_id)
        place = {v: s for v, s in zip(ids, scores)}
        assert np.allclose(got.score, [place[v] for v in got.vec_id], rtol=0, atol=1e-12)
        assert list(zip(-got.score, got.vec_id)) == sorted(zip(-got.score, got.vec_id))
        recall.append(len(set(want) & set(got.vec_id)) / 20)
    assert np.mean(recall) >= 0.93


def test_norms_matter_and_blocks_agree():
    rng = np.random.default_rng(5)
    vectors = rng.standard_normal((3_000, 16)) * rng.uniform(0.1, 3, (3_000, 1))
    largest = np.linalg.norm(vectors, axis=1).max()
    block = Block(np.arange(3_000), vectors, largest)
    found = block.search(np.arange(40), vectors[:40], 20)
    recall = []
    for i, (ids, scores) in enumerate(found):
        every = products(vectors, vectors[i])
        every[i] = -np.inf
        recall.append(len(set(np.argsort(-every)[:20]) & set(ids)) / 20)
    assert np.mean(recall) >= 0.9


def test_defined_cases(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (20, [0.5, 0.5], "x"), (1, [2.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (2, [2.0, 0.0], "x"),
            (3, None, "x"), (40, [0.0, 0.0], "x"), (5, [nan, 1.0], "x"), (60, [inf, 1.0], "x"), (7, [None, 1.0], "x"),
            (8, [], "x"), (80, [1.0], "x"), (9, [-1.0, 0.0], "x"), (None, [9.0, 9.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    for block, group in ((65_536, 512), (2, 1)):
        monkeypatch.setattr(neighbours, "BLOCK_VECTORS", block)
        monkeypatch.setattr(neighbours, "GROUP_QUERIES", group)
        out = search(df, df.where("vec_id % 20 = 0"), 20)
        got = sorted(map(tuple, out.collect()))
        assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 2, 2.0), (0, 4, 20, 0.5), (0, 5, 9, -1.0),
                       (20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 2, 1.0), (20, 4, 0, 0.5), (20, 5, 9, -0.5)]
    assert search(df.limit(0), df, 20).count() == 0 and search(df, df.limit(0), 20).count() == 0

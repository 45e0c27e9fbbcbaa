"""Approximate nearest neighbours by collision counting over query-centred windows.

Largest inner products are turned into nearest points: vectors are scaled by the largest norm and lifted by one
coordinate to the unit sphere, queries are scaled to it, so the distance falls as the product grows. A vector's hash
is its projection on a random line; every block of vectors keeps one sorted array per line. A query's window on each
line is centred at its own projection and widened step by step (virtual rehashing: the arrays stay, only the window
grows); entering a window counts one collision, and vectors whose count reaches a threshold are verified by their
exact product. The query stops in a block when its k-th best verified vector lies well inside the distance that the
current window stands for, or when all vectors are verified.

Vectors are dealt into blocks by a hash, queries into groups, and every group meets every block; each block gives at
most k rows per query, and these are ranked again. Nothing is capped: any number of vectors may pass the threshold.
Lines and window steps are the same for all blocks and sizes. Everything but the largest norm (one number) stays on
the executors.

Defined cases: vectors that are null, empty, all zero, or hold null or non-finite numbers take no part, neither as
queries nor as candidates; vectors of another length than the query's are no candidates; a query's own id is none,
also where ids repeat; equal products are ranked by smaller id; repeated rows are candidates each, and a repeated query
is answered once per distinct vector, each answer being ranked alone; null ids take no part. Empty tables give no rows.
Further columns are ignored.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

LINES = 48
#: Share of lines on which a vector must collide to be verified.
THRESHOLD = 0.65
#: First half-width of the windows as a share of the sphere's spread on a line, and its growth per step.
FIRST, GROWTH = 0.6, 1.1
#: A query stops when its k-th best lies within this share of the distance that the windows stand for.
MARGIN = 0.8
BLOCK_VECTORS, GROUP_QUERIES = 65_536, 512
SEED = 97


def lines(size: int) -> np.ndarray:
    """Random unit lines, the same everywhere."""
    drawn = np.random.default_rng([SEED, size]).standard_normal((LINES, size))
    return drawn / np.linalg.norm(drawn, axis=1, keepdims=True)


def lift(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Vectors on the unit sphere of one dimension more."""
    scaled = vectors / largest
    height = np.sqrt(np.maximum(0, 1 - (scaled ** 2).sum(axis=1)))
    return np.hstack([scaled, height[:, None]])


def products(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, summed in the same order for every row, so that equal vectors give equal products."""
    return (vectors * query).sum(axis=1)


class Block:
    """Sorted projections of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float):
        self.ids, self.vectors, self.largest = ids, vectors, largest
        self.lines = lines(vectors.shape[1] + 1)
        at = self.lines @ lift(vectors, largest).T
        self.order = np.argsort(at, axis=1, kind="stable")
        self.sorted = np.take_along_axis(at, self.order, axis=1)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and products of the k best verified vectors of every query, best first. All queries widen their windows
        in step, as long as they are not done."""
        n, width = len(self.ids), FIRST / np.sqrt(self.lines.shape[1])
        size = np.linalg.norm(queries, axis=1)
        centre = (queries / size[:, None]) @ self.lines[:, :-1].T
        low = np.array([np.searchsorted(a, c) for a, c in zip(self.sorted, centre.T)]).T
        high, counts = low.copy(), np.zeros((len(queries), n), np.int16)
        done = np.iinfo(np.int16).min // 2  # verified vectors count from here, so they are not verified again
        for i, own in enumerate(query_ids):
            counts[i, self.ids == own] = done
        need = int(np.ceil(THRESHOLD * LINES))
        # Windows stand for the distance at which a vector is expected to collide on the threshold's share of lines.
        stands_for = np.sqrt(self.lines.shape[1]) / NormalDist().inv_cdf((1 + THRESHOLD) / 2)
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        active = np.arange(len(queries))
        while len(active):
            left = np.array([np.searchsorted(a, c) for a, c in zip(self.sorted, centre[active].T - width)]).T
            right = np.array([np.searchsorted(a, c) for a, c in zip(self.sorted, centre[active].T + width)]).T
            going = []
            for q, a, b in zip(active.tolist(), left, right):
                spans = zip(self.order, a.tolist(), low[q].tolist(), high[q].tolist(), b.tolist())
                entered = [part for line, i, j, x, y in spans for part in (line[i:j], line[x:y])]
                low[q], high[q] = a, b
                count = counts[q]
                count += np.bincount(np.concatenate(entered), minlength=n).astype(np.int16)
                new = np.flatnonzero(count >= need)
                ids, scores = best[q]
                if len(new):
                    count[new] = done
                    ids = np.concatenate([ids, self.ids[new]])
                    scores = np.concatenate([scores, products(self.vectors[new], queries[q])])
                    first = np.lexsort((ids, -scores))[:k]
                    best[q] = ids, scores = ids[first], scores[first]
                if len(ids) == k:
                    cosine = scores[-1] / (size[q] * self.largest)
                    if np.sqrt(max(0.0, 2 - 2 * cosine)) <= MARGIN * width * stands_for:
                        continue
                if (count >= 0).any():
                    going.append(q)
            active = np.array(going, int)
            width *= GROWTH
        return best


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(base: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k nearest of ``base`` found for every row of ``queries``: query_id, rank (from 1), vec_id, score."""
    def prepared(df: DataFrame) -> DataFrame:
        values = F.col(f"`{vector}`").cast("array<double>")
        return df.select(F.col(f"`{key}`").cast("long").alias("id"), values.alias("v")).where(
            F.col("id").isNotNull() & usable(F.col("v"))).withColumn("size", F.size("v"))

    vectors, asked = prepared(base), prepared(queries).distinct()
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    counted = vectors.agg(F.max(norm).alias("largest"), F.count("*").alias("n")).collect()[0]
    largest, blocks = counted.largest or 1.0, max(1, -(-counted.n // BLOCK_VECTORS))
    groups = max(1, -(-asked.count() // GROUP_QUERIES))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # Every group of queries is sent to every block, and every block to every group.
    placed = vectors.select(F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int").alias("block"),
                            numbers(groups).alias("grp"), "size", F.lit(False).alias("asks"),
                            F.lit(0).cast("long").alias("mark"), "id", "v")
    sent = asked.select(numbers(blocks).alias("block"),
                        F.pmod(F.xxhash64("v", "id"), F.lit(groups)).cast("int").alias("grp"), "size",
                        F.lit(True).alias("asks"), F.xxhash64("v").alias("mark"), "id", "v")

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        own, asks = part[~part["asks"]], part[part["asks"]]
        rows = []
        if len(own) and len(asks):
            block = Block(own["id"].to_numpy(), np.stack(own["v"].to_numpy()), largest)
            found = block.search(asks["id"].to_numpy(), np.stack(asks["v"].to_numpy()), k)
            for query_id, mark, (ids, scores) in zip(asks["id"].to_numpy(), asks["mark"].to_numpy(), found):
                rows.append(pd.DataFrame({"query_id": query_id, "mark": mark, "vec_id": ids, "score": scores}))
        return pd.concat(rows) if rows else pd.DataFrame({"query_id": [], "mark": [], "vec_id": [], "score": []})

    met = placed.unionByName(sent).groupBy("block", "grp", "size").applyInPandas(
        meet, "query_id long, mark long, vec_id long, score double")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

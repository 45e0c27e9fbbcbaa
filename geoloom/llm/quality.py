"""Quality classification by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its score into grades:
P(grade <= k) = sigmoid(threshold_k - score). The model gives the expected grade and the probability of reaching a
chosen grade, by which documents are selected. It is fitted on at most ``MAX_LABELLED`` rated documents (those of
smallest hashed id, so the choice does not depend on the order of rows); every document is then scored on its whole
text.

Features are the presence of letter runs and of runs of marks, and, as further hashed words, levels of a text's
shares: each mark run per word, distinct words per word, the commonest word's share, words per mark, length.

Defined cases: a null or empty text has only the features of an empty text; a null rating, or one without its
document, teaches nothing; repeated ratings of one document count once each; ratings are taken in the order of their
values. Without two different grades nothing can be fitted: every document then has the only grade there is (0 if
none) and is kept. Repeated rows are each scored; empty tables give empty tables. Columns named like the result's are
replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from geoloom.llm.tables import lean, text_pieces
from geoloom.llm.words import NOT_LETTERS, NOT_MARKS, SPACES, mix, word_hashes

BITS = 18
#: Texts of an Arrow batch that are handled at once, in bytes (a longer text alone).
PIECE = 1 << 21
#: Rated documents that the model is fitted on, at most.
MAX_LABELLED = 12_000
#: A feature must occur in two documents of the sample and in one of so many to get a weight.
MIN_SHARE = 300
STEPS, RATE, PENALTY = 150, 0.1, 1e-3


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray


def _level(kind: int, *values: np.ndarray) -> np.ndarray:
    """Hashed features of a kind and integer levels."""
    key = np.full(len(values[0]), kind, np.uint64)
    for v in values:
        key = mix(key ^ v.astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
    return mix(key) >> np.uint64(64 - BITS)


def _log_level(share: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(2 * np.log2(np.maximum(share, 2.0 ** -10))) + 20, 0, 63)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all texts, each once per text, and each text's first (one more entry at the end)."""
    n = len(texts)
    owners, found = [], []

    def add(owner: np.ndarray, feature: np.ndarray) -> None:
        owners.append(owner)
        found.append(feature)

    def counted(separators: np.ndarray):
        """Distinct runs with their text and count, and the number of runs per text."""
        words, first = word_hashes(texts, separators)
        key = np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(40), np.diff(first)) | (words >> np.uint64(24))
        key.sort()
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        count = np.diff(np.append(at, len(key)))
        key = key[at]
        return key & np.uint64((1 << 40) - 1), (key >> np.uint64(40)).astype(np.int64), count, np.diff(first)

    everyone = np.arange(n)
    words, owner, count, total = counted(NOT_LETTERS)
    add(owner, _level(1, words))
    distinct, top = np.bincount(owner, minlength=n), np.zeros(n)
    np.maximum.at(top, owner, count)
    at_least = np.maximum(total, 1)
    add(everyone, _level(2, _log_level(distinct / at_least), np.minimum(np.log2(at_least), 6)))
    add(everyone, _level(3, _log_level(top / at_least), np.minimum(np.log2(at_least), 6)))
    add(everyone, _level(4, np.floor(np.log2(at_least))))
    marks, owner, count, _ = counted(NOT_MARKS)
    share = _log_level(count / at_least[owner])
    add(owner, _level(5, marks))
    add(owner, _level(6, marks, share))
    _, first = word_hashes(texts, SPACES)
    add(everyone, _level(7, _log_level(np.bincount(owner, weights=count, minlength=n) / np.maximum(np.diff(first), 1))))
    key = np.concatenate(owners) << BITS | np.concatenate(found).astype(np.int64)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(n + 1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _scores(weights: np.ndarray, found: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(weights[found])])
    return sums[first[1:]] - sums[first[:-1]]


def fit(grades: np.ndarray, found: np.ndarray, first: np.ndarray) -> Model:
    """Maximum penalised likelihood by Adam over the whole sample; features of few documents are left out."""
    levels = int(grades.max(initial=0)) + 1
    weights = np.zeros(1 << BITS)
    if len(np.unique(grades)) < 2:
        return Model(weights, np.full(max(levels - 1, 0), -30.0))
    used, inverse = np.unique(found, return_inverse=True)
    common = np.bincount(inverse) >= 2 + len(grades) // MIN_SHARE
    place = np.where(common, np.cumsum(common) - 1, -1)[inverse]
    row = np.repeat(np.arange(len(grades)), np.diff(first))[place >= 0]
    place = place[place >= 0]
    below = np.array([(grades <= k).mean() for k in range(levels - 1)]).clip(1e-3, 1 - 1e-3)
    start = np.log(below / (1 - below))
    # Thresholds are kept in order: the first, then logarithms of the gaps.
    steps = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.5))])
    w = np.zeros(int(common.sum()))
    moments = [(np.zeros_like(x), np.zeros_like(x)) for x in (w, steps)]
    hit = np.eye(levels)[grades]
    for t in range(1, STEPS + 1):
        thresholds = steps[0] + np.concatenate([[0.0], np.cumsum(np.exp(steps[1:]))])
        score = np.bincount(row, weights=w[place], minlength=len(grades))
        up = np.hstack([np.zeros((len(grades), 1)), _sigmoid(thresholds - score[:, None]), np.ones((len(grades), 1))])
        chance = (hit * np.diff(up, axis=1)).sum(axis=1).clip(1e-9)
        slope = up * (1 - up)
        per_threshold = (hit[:, :-1] - hit[:, 1:]) * slope[:, 1:-1] / chance[:, None]
        by_score = -(hit * np.diff(slope, axis=1)).sum(axis=1) / chance
        g_w = -np.bincount(place, weights=by_score[row], minlength=len(w)) / len(grades) + PENALTY * w
        g_t = -per_threshold.mean(axis=0)
        tail = np.cumsum(g_t[::-1])[::-1]
        g_s = np.concatenate([tail[:1], tail[1:] * np.exp(steps[1:])])
        for x, g, (m, v) in ((w, g_w, moments[0]), (steps, g_s, moments[1])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= RATE * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-8)
    weights[used[common]] = w
    return Model(weights, steps[0] + np.concatenate([[0.0], np.cumsum(np.exp(steps[1:]))]))


def learn(docs: DataFrame, ratings: DataFrame, grade: Column, key: str = "doc_id", text: str = "text",
          most: int = MAX_LABELLED) -> Model:
    """Fits the model on rated documents. ``grade`` is an expression over ``ratings``, from 0 upwards."""
    chosen = ratings.select(F.col(f"`{key}`").alias("key"), grade.cast("int").alias("grade")).dropna()
    chosen = chosen.orderBy(F.xxhash64("key"), "key", "grade").limit(most)  # bounds what is broadcast
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(
        F.broadcast(chosen), "key").select("grade", "text")

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in text_pieces(batch.column(1), PIECE):
                found, first = features(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(part)), pa.ListArray.from_arrays(
                    pa.array(first.astype(np.int32)), pa.array(found))], ["grade", "found"])

    sample = rows.mapInArrow(read, "grade int, found array<int>").toArrow().combine_chunks()
    grades = sample["grade"].to_numpy().astype(int)
    lists = sample["found"].combine_chunks() if len(sample) else pa.array([], pa.list_(pa.int32()))
    first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
    return fit(grades, lists.flatten().to_numpy().astype(int), first)


def grade_texts(df: DataFrame, model: Model, at_least: int, text: str = "text", expected: str = "expected_grade",
                tail: str = "tail_probability") -> DataFrame:
    """Adds the expected grade and the probability of a grade of ``at_least`` or more (of the best grade that was
    learned, if that is lower)."""
    shared = df.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.thresholds))

    @lean
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weights, thresholds = shared.value[0].astype(float), shared.value[1]
        for batch in batches:
            # Features take several times the memory of their texts.
            scores = [_scores(weights, *features(part)) for _, part in text_pieces(batch, PIECE)]
            above = 1 - _sigmoid(thresholds - np.concatenate([np.zeros(0), *scores])[:, None])
            level = min(at_least, len(thresholds))
            reach = above[:, level - 1] if level > 0 else np.ones(len(batch))
            yield pa.StructArray.from_arrays([pa.array(above.sum(axis=1)), pa.array(reach)], ["expected", "reach"])

    apply = F.arrow_udf(run, "struct<expected:double,reach:double>")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (expected, tail)]
    found = df.select(F.struct(*kept).alias("kept"), apply(F.col(f"`{text}`").cast("string")).alias("found"))
    return found.select("kept.*", F.col("found.expected").alias(expected), F.col("found.reach").alias(tail))

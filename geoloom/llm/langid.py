"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams per language in every task, sums them by (language, bucket) in Spark, and forms a matrix of
log-probabilities whose size is bounded by the number of buckets and of languages. The matrix is broadcast; texts are
scored in batches, each n-gram adding one row of the matrix to its text's scores.

Defined cases: a null text, or one without any letter, is ``und`` with score 0, as is every text when nothing was
learned; a null language teaches nothing, nor does a null text. Ties go to the language that sorts first. Repeated
rows count as often as they occur. Empty tables give empty tables. Columns named like the result's are replaced, all
others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.tables import lean

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
MAX_LANGUAGES = 256
SMOOTHING = 0.5
#: Characters that are scored at once.
PIECE = 1 << 18
_LETTER = regex.compile(r"\p{L}")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint64)


def ngrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, in pieces; n-grams across pieces are counted with the later piece."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    longest = max(SIZES)
    for lo in range(0, len(points), PIECE):
        overlap = min(lo, longest - 1)
        part = points[lo - overlap: lo + PIECE].astype(np.uint64)
        found = []
        for n in SIZES:
            skip = max(0, overlap - n + 1)
            if len(part) - skip < n:
                continue
            value = np.full(len(part) - skip - n + 1, n, np.uint64)
            for k in range(n):
                value = value * np.uint64(0x100000001B3) + part[skip + k: len(part) - n + 1 + k] * _FACTORS[k]
            found.append((value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(49))
        yield np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, and the (bucket, language) matrix of log-probabilities; language priors are left out, so the share
    of a language in the training rows does not favour it. Counts cover all rows."""
    rows = labelled.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).dropna()

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name not in counts and len(counts) >= MAX_LANGUAGES:
                    raise ValueError(f"More than {MAX_LANGUAGES} languages.")
                mine = counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                for found in ngrams(words.as_py()):
                    mine += np.bincount(found, minlength=BUCKETS)
        for name, mine in counts.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)),
                                              pa.array(mine[at])], ["lang", "bucket", "n"])

    sums = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n")).toPandas()
    names = sorted(sums["lang"].unique())
    if len(names) > MAX_LANGUAGES:
        raise ValueError(f"More than {MAX_LANGUAGES} languages.")
    counts = np.full((BUCKETS, len(names)), SMOOTHING)
    place = {name: i for i, name in enumerate(names)}
    counts[sums["bucket"].to_numpy(int), sums["lang"].map(place).to_numpy(int)] += sums["n"].to_numpy(float)
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32) if names else counts.astype(np.float32)


def predict(df: DataFrame, names: list[str], log_probs: np.ndarray, text: str = "text", out: str = "lang_pred",
            score: str = "score") -> DataFrame:
    """Adds the likeliest language and its posterior probability under equal priors, 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast((names, log_probs))

    @lean
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        learned, matrix = shared.value
        for batch in batches:
            totals = np.zeros((len(batch), max(1, len(learned))))
            judged = np.zeros(len(batch), bool)
            waiting, owners, n = [], [], 0

            def add() -> None:
                starts = np.cumsum([0, *map(len, waiting)])[:-1]
                sums = np.add.reduceat(matrix[np.concatenate(waiting)], starts, axis=0, dtype=np.float64)
                np.add.at(totals, owners, sums)

            for i, words in enumerate(batch):
                words = words.as_py()
                if not learned or words is None or not _LETTER.search(words):
                    continue
                judged[i] = True
                for found in ngrams(words):
                    if len(found):
                        waiting.append(found)
                        owners.append(i)
                        n += len(found)
                    if n > PIECE:
                        add()
                        waiting, owners, n = [], [], 0
            if waiting:
                add()
            best = totals.argmax(axis=1)
            sure = 1 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
            yield pa.StructArray.from_arrays([
                pa.array([learned[b] if ok else "und" for b, ok in zip(best, judged)], pa.string()),
                pa.array(np.where(judged, sure, 0.0))], ["lang", "score"])

    apply = F.arrow_udf(run, "struct<lang:string,score:double>")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (out, score)]
    judged = df.select(F.struct(*kept).alias("kept") if kept else F.lit(None).alias("kept"),
                       apply(F.col(f"`{text}`").cast("string")).alias("found"))
    return judged.select(*([F.col("kept.*")] if kept else []), F.col("found.lang").alias(out),
                         F.col("found.score").alias(score))

"""The ordinal classifier on rated documents that it has not seen, and its defined cases."""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from geoloom.llm import quality
from geoloom.llm.quality import BITS, features, fit, grade_texts, learn
from geoloom.llm.quality_query import GOOD, SURE, op8_quality, rating

SF = "/root/testdata/sf0.1"


def test_unseen_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    unseen = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) == 0
    model = learn(docs, labels.where(~unseen), rating())
    out = grade_texts(docs, model, GOOD).join(labels.where(unseen), "doc_id").select(
        rating().alias("grade"), (F.col("tail_probability") >= SURE).alias("keep"), "expected_grade").toPandas()
    kept = out.groupby("grade").keep.mean()
    assert kept[2] > 0.97 and kept[0] < 0.05 and kept[1] < kept[2] - 0.3
    means = out.groupby("grade").expected_grade.mean()
    assert means[0] < means[1] < means[2]


def test_query_grades_every_document(spark):
    rows = op8_quality(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in rows)


def test_thresholds_are_ordered_and_likelihood_beats_the_start():
    rng = np.random.default_rng(1)
    found = rng.integers(0, 20, (400, 4))
    found.sort(axis=1)
    grades = np.clip((found < 5).sum(axis=1), 0, 2)
    model = fit(grades, found.ravel(), np.arange(0, 1601, 4))
    assert np.all(np.diff(model.thresholds) > 0)
    score = model.weights[found].sum(axis=1)
    assert score[grades == 2].mean() > score[grades == 1].mean() > score[grades == 0].mean()


def test_features_by_brute_force():
    texts = ["Ab ab, c!! é", "", None, "x" * 50, "a a a a b"]
    found, first = features(pa.array(texts))
    alone = [features(pa.array([t], pa.string()))[0] for t in texts]
    for i in range(len(texts)):
        mine = found[first[i]: first[i + 1]]
        assert (mine == alone[i]).all() and len(set(mine)) == len(mine) and mine.max() < 1 << BITS
    assert (alone[1] == alone[2]).all()


def test_grades_by_plain_python(spark):
    """Expected grade and tail probability from weights and thresholds, one text at a time; ties and repeated rows."""
    rng = np.random.default_rng(7)
    model = quality.Model(rng.normal(0, 0.2, 1 << BITS).astype(np.float32).astype(float), np.array([-0.4, 0.9]))
    texts = ["one two, two!", "", None, "one two, two!", "ZZ " * 70_000, "é … $$$ 12"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in grade_texts(df, model, 2).collect()}
    for i, text in enumerate(texts):
        score = sum(float(model.weights[f]) for f in features(pa.array([text], pa.string()))[0])
        above = [1 - 1 / (1 + math.exp(-(t - score))) for t in model.thresholds]
        assert math.isclose(got[i].expected_grade, sum(above), abs_tol=1e-9)
        assert math.isclose(got[i].tail_probability, above[1], abs_tol=1e-9)
    assert got[0][2:] == got[3][2:] and got[1][2:] == got[2][2:]


def test_fit_against_the_likelihood():
    """The penalised likelihood, written out row by row, has hardly any slope left where the fit ends."""
    rng = np.random.default_rng(3)
    found = np.array([rng.choice(12, 3, replace=False) for _ in range(150)])
    grades = np.clip((found < 4).sum(axis=1) + (rng.random(150) < 0.2), 0, 2)
    model = fit(grades, found.ravel(), np.arange(0, 451, 3))

    def loss(weights, thresholds):
        total = 0.0
        for row, grade in zip(found, grades):
            score = sum(weights[f] for f in row)
            upto = [0.0, *[1 / (1 + math.exp(score - t)) for t in thresholds], 1.0]
            total -= math.log(upto[grade + 1] - upto[grade])
        return total / len(grades) + quality.PENALTY / 2 * sum(weights[f] ** 2 for f in range(12))

    def slopes(weights, thresholds):
        out = []
        for values in (weights, thresholds):
            for i in range(len(values) if values is thresholds else 12):
                values[i] += 1e-5
                up = loss(weights, thresholds)
                values[i] -= 2e-5
                out.append((up - loss(weights, thresholds)) / 2e-5)
                values[i] += 1e-5
        return np.abs(out).max()

    assert slopes(model.weights.copy(), model.thresholds.copy()) < 0.05 * slopes(np.zeros(1 << BITS), np.array([-1.0, 1.0]))


def test_presence_features_by_plain_python():
    """Texts share a presence feature for every run of letters, and of marks, that both hold, whatever its case."""
    texts = ["Alpha beta, GAMMA!", "gamma beta;", "delta", "ALPHA alpha alpha", "!!! , ;"]
    held = [set(features(pa.array([t]))[0].tolist()) for t in texts]
    runs = [set(re.findall("[a-z]+", t.lower())) | set(re.findall("[!,;]+", t)) for t in texts]
    alone = {r: set(features(pa.array([r]))[0].tolist()) for r in set().union(*runs)}
    empty = {r: alone[r] - set().union(*[alone[x] for x in alone if x != r]) for r in alone}
    for r in alone:  # the feature that nothing but this run has
        for text, mine in zip(texts, runs):
            shared = empty[r] & set(features(pa.array([text]))[0].tolist())
            assert bool(shared) == (r in mine), (r, text)
    assert all(held)


def test_defined_cases(spark):
    docs = spark.createDataFrame([(1, "good text", 9.0), (1, "good text", 9.0), (2, None, 1.0), (3, "", 2.0)],
                                 "doc_id long, text string, tail_probability double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for ratings in (none, spark.createDataFrame([(1, 1, 0), (9, 0, 0), (2, None, None)], none.schema)):
        model = learn(docs, ratings, rating())
        out = grade_texts(docs, model, GOOD)
        assert out.columns == ["doc_id", "text", "expected_grade", "tail_probability"]
        assert out.count() == 4 and out.where("tail_probability >= 0.5").count() == 4
    assert grade_texts(docs.limit(0), model, GOOD).count() == 0
    assert quality.MAX_LABELLED == 12_000

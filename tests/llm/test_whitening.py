"""Whitening against dense linear algebra, exact moments against Python integers, and the defined cases."""

import math

import numpy as np
import pytest

from geoloom.llm.whitening import (
    characteristic, characteristic_residues, largest_roots, moments, null_vectors, primes_below, roots_beyond, whiten,
)
from geoloom.llm.whitening_query import op12_whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>"


def polynomial(roots):
    poly = [1]
    for r in roots:
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
    return poly


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def expected(rows, components=4):
    """(vec_id, component) -> (n, deviation, whitened, explained) by exact integers and numpy, for equal lengths."""
    kept = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows if usable(v)]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    exact = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], object)
    v = (exact.T @ exact / n ** 3).astype(float)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    out = []
    for i, x in kept:
        centred = [n * a - s for a, s in zip(x, sums)]
        for k in range(components):
            out.append((i, k + 1, n, sum(c * c for c in centred), np.array(centred, float) @ vectors[:, k] / n / values[k] ** 0.5,
                        values[k] / np.trace(v)))
    return out


def check(got, want):
    assert len(got) == len(want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], abs(r[4]))
    got, want = sorted([tuple(r)[:6] for r in got], key=key), sorted(want, key=key)
    signs = {}
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and a[5] == pytest.approx(b[5], rel=1e-9)
        if abs(b[4]) > 0.1:
            signs.setdefault(a[1], a[4] * b[4] > 0)
    for a, b in zip(got, want):
        assert a[4] * (1 if signs[a[1]] else -1) == pytest.approx(b[4], abs=1e-9)


def test_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error)
           for r in op12_whitening(spark, SF).collect()]
    check(got, expected(rows))
    assert all(0 <= r[6] < 1e-12 for r in got) and len({r[6] for r in got}) == 1


def test_nulls_repeats_and_clashes(spark, tmp_path):
    rng = np.random.default_rng(5)
    rows = [(i % 70 if i % 70 else None, [float(c) for c in rng.normal(0, [9, 3, 2, 1, 0.5])]) for i in range(90)]
    rows += [rows[3]] * 200 + [(7, None), (8, [1.0, None, 0.0, 0.0, 0.0]), (9, [math.inf] * 5), (10, [math.nan] * 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in op12_whitening(spark, str(tmp_path)).collect()]
    check(got, expected(rows))
    out = whiten(df.selectExpr("*", "'kept' AS x", "1 AS n", "2 AS whitened"), 2)
    assert set(out.columns) == {"vec_id", "embedding", "x", "n", "deviation", "whitened", "explained", "identity_error"}
    assert out.where("x = 'kept'").count() == 290


def test_lengths_and_degenerate_tables(spark, tmp_path):
    def run(rows, name):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        return op12_whitening(spark, f"{tmp_path}/{name}").collect()

    assert run([], "none") == [] and run([(1, [1.0, 2.0])] * 5, "same") == [] and run([(1, []), (2, None)], "void") == []
    line = run([(1, [1.0]), (2, [1.0, 0.0]), (3, []), (4, [3.0, 0.0])], "line")
    assert {r.component for r in line} == {1} and {r.n for r in line} == {3} and len(line) == 4
    assert {r.explained for r in line} == {1.0} and max(r.identity_error for r in line) < 1e-12


def test_moments_are_exact(spark):
    big = 1 << 40
    rows = [[big + 1, -3], [big, 5], [-big, 0]]
    n, sums, products = moments(spark.createDataFrame([(r,) for r in rows], "x array<long>"), 2)
    assert n == 3 and sums == [big + 1, 2] and products[0][0] == (big + 1) ** 2 + 2 * big * big
    assert products[0][1] == products[1][0] == -3 * (big + 1) + 5 * big and products[1][1] == 34


def test_large_deviation_is_null(spark):
    df = spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 3.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    rows = {r.vec_id: r for r in whiten(df, 2).collect()}
    assert rows[1].deviation is None and rows[2].deviation is None and rows[3].deviation is not None
    assert all(abs(rows[1].identity_error) < 1e-12 for _ in rows)


def test_characteristic_polynomial(spark):
    rng = np.random.default_rng(3)
    for size in (1, 2, 7):
        half = rng.integers(-50, 50, (size, size)).astype(object)
        matrix = half @ half.T
        poly = characteristic(spark, matrix)
        for at in range(-2, size):  # equal at size + 2 places, so equal
            a = [[int(v) * -1 + (at if i == j else 0) for j, v in enumerate(row)] for i, row in enumerate(matrix)]
            assert sum(c * at ** k for k, c in enumerate(poly)) == determinant(a)
    sparse = np.diag([0, 3, 0, 5]).astype(object)
    p = primes_below(1 << 31, 1)[0]
    assert characteristic_residues(sparse, [p])[0].tolist() == [0, 0, 15, p - 8, 1]
    assert characteristic(spark, sparse) == polynomial([0, 0, 3, 5])


def determinant(a):
    """By fraction-free elimination."""
    a, sign, before = [row[:] for row in a], 1, 1
    for k in range(len(a) - 1):
        pivot = next((i for i in range(k, len(a)) if a[i][k]), None)
        if pivot is None:
            return 0
        if pivot != k:
            a[k], a[pivot], sign = a[pivot], a[k], -sign
        for i in range(k + 1, len(a)):
            for j in range(k + 1, len(a)):
                a[i][j] = (a[i][j] * a[k][k] - a[i][k] * a[k][j]) // before
        before = a[k][k]
    return sign * a[-1][-1]


def test_roots_simple_multiple_and_close():
    poly = polynomial([0, 0, 7, 9, 9, 9, 1000, 1001])
    assert [roots_beyond(poly, at, 0) for at in (0, 7, 8, 9, 1000)] == [6, 5, 5, 2, 1]
    found = largest_roots(poly, 8)
    assert [(round(m / (1 << s), 12), count) for m, s, count in found] == [(1001, 1), (1000, 1), (9, 3), (7, 1)]
    assert largest_roots(polynomial([0, 0]), 3) == []


def test_vectors_of_a_multiple_root():
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(6, 6)))
    matrix = np.diag([4, 4, 4, 2, 1, 0]).astype(object)
    rows = null_vectors(matrix, (8, 1), 3)
    assert np.allclose(rows @ rows.T, np.eye(3), atol=1e-15) and np.allclose(rows[:, 3:], 0, atol=1e-15)
    near = np.round(q @ np.diag([1e6, 1e5, 1e4, 5, 3, 1]) @ q.T * 1e6).astype(np.int64)
    near = ((near + near.T) // 2).astype(object)
    values, vectors = np.linalg.eigh(near.astype(float))
    row = null_vectors(near, (int(values[-1] * 2 ** 20), 20), 1)[0]
    assert abs(abs(row @ vectors[:, -1]) - 1) < 1e-14

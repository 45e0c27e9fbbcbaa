"""Whitening of embeddings along the principal components of their exact integer scatter.

Entries become integers (``floor(SCALE * c)``), every distinct vector counts once, and all moments are exact integers:
with n vectors of sum S and second moments P, the matrix n * P - S S^T is n^2 times their covariance.

1. Tasks sum vectors and products exactly; Spark adds the sums, cut into limbs, by place. What reaches the driver has
   one entry per pair of dimensions, whatever the number of rows.
2. The matrix' characteristic polynomial is computed modulo many 31-bit primes, dealt over tasks, each by reduction to
   Hessenberg form; Chinese remaindering gives the integer coefficients (the trace bounds their size and so the number
   of primes).
3. All roots are real, so Descartes' rule counts the roots beyond any number exactly. Bisection with that count
   isolates the largest roots, sign changes refine them to ``ROOT_BITS`` bits. Roots that agree in all of them count as
   one multiple root.
4. Inverse iteration in ``WORK_BITS``-bit fixed point on the matrix less a root gives its null space, as many
   orthonormal vectors as the root's multiplicity.

Vectors are whitened by exact centred integers times the unit vectors, over the root of the eigenvalue.

Defined cases: vectors that are null or hold a null or non-finite entry are dropped; where lengths differ, shorter
vectors (also empty ones) have 0 in the dimensions they lack; repeated vectors count once in the fit and are each
whitened; components with eigenvalue 0 are left out, so equal vectors, one vector or none have no components; the
vectors of an eigenvalue of higher multiplicity are one orthonormal basis of its space. A squared deviation beyond the
range of a long is null. Null ids and further columns are kept; columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geoloom.llm.tables import stored

SCALE = 256
#: Bits of roots, beyond which two roots count as one, and of the arithmetic that finds their vectors.
ROOT_BITS, WORK_BITS = 192, 640
LIMB = 30
#: Primes that one task works on.
TASK_PRIMES = 16


@dataclass(frozen=True)
class Model:
    """``roots`` are eigenvalues of n^2 times the covariance as (numerator, binary exponent of the denominator)."""

    n: int
    sums: list[int]
    trace: int
    roots: list[tuple[int, int]]
    vectors: np.ndarray

    def explained(self) -> list[float]:
        """Each component's share of the total variance."""
        return [m / (self.trace << s) for m, s in self.roots]


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vector.isNotNull() & ~bad


def integers(vector: Column, size: int) -> Column:
    """Entries as integers, filled up to ``size`` with zeros."""
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE))
    return F.concat(whole, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(F.lit(0), F.lit(size) - F.size(whole))))


def _matrix(batch: pa.Array, size: int) -> np.ndarray:
    return batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _limbs(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Signed limbs of integers, lowest first; the last one takes the sign."""
    k = 0
    while True:
        if k and all(-(1 << LIMB) <= int(v) < 1 << LIMB for v in (values.min(), values.max())):
            yield k, values
            return
        yield k, values & ((1 << LIMB) - 1)
        values, k = values >> LIMB, k + 1


def moments(vectors: DataFrame, size: int) -> tuple[int, list[int], np.ndarray]:
    """(rows, sums, second moments) of integer vectors, exactly; the arrays hold Python integers."""
    rows, columns = np.triu_indices(size + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size + 1, size + 1), object)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            largest = max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
            kind = np.float64 if largest ** 2 * len(x) < 1 << 53 else object  # both exact
            with_one = np.hstack([np.ones((len(x), 1), kind), x.astype(kind)])
            found = with_one.T @ with_one
            total += found.astype(np.int64).astype(object) if kind is np.float64 else found
        for k, limb in _limbs(total[rows, columns]):
            yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(columns.astype(np.int32)), pa.array(
                np.full(len(rows), k, np.int32)), pa.array(limb.astype(np.int64))], ["i", "j", "limb", "v"])

    summed = vectors.mapInArrow(run, "i int, j int, limb int, v long").groupBy("i", "j", "limb").agg(F.sum("v").alias("v"))
    out = np.zeros((size + 1, size + 1), object)
    for i, j, limb, v in summed.collect():  # a few numbers per pair of dimensions
        out[i, j] += v << LIMB * limb
    out = out + np.triu(out, 1).T
    return int(out[0, 0]), [int(v) for v in out[0, 1:]], out[1:, 1:]


def primes_below(limit: int, product: int) -> list[int]:
    """Largest primes below ``limit`` (at most 2^31) until their product exceeds ``product``."""
    found, whole, p = [], 1, limit | 1
    while whole <= product:
        p -= 2
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1

        def passes(base: int) -> bool:
            x = pow(base, odd, p)
            return x in (1, p - 1) or any((x := x * x % p) == p - 1 for _ in range(twos - 1))

        if all(passes(b) for b in (2, 3, 5, 7)):  # certain below 3.2 * 10^9
            found.append(p)
            whole *= p
    return found


def characteristic_residues(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """Coefficients, lowest first, of a matrix' characteristic polynomial modulo each prime."""
    size, n = len(matrix), len(primes)
    a = np.stack([(matrix % p).astype(np.int64) for p in primes]) if size else np.zeros((n, 0, 0), np.int64)
    p1 = np.array(primes, np.int64)[:, None]
    p2, each = p1[:, :, None], np.arange(n)
    for k in range(size - 2):
        pivot = (a[:, k + 1:, k] != 0).argmax(axis=1) + k + 1
        a[each, pivot], a[each, k + 1] = a[each, k + 1], a[each, pivot]
        a[each, :, pivot], a[each, :, k + 1] = a[each, :, k + 1], a[each, :, pivot]
        inverse = np.array([pow(int(v), -1, p) if v else 0 for v, p in zip(a[:, k + 1, k], primes)], np.int64)[:, None]
        factor = a[:, k + 2:, k] * inverse % p1
        a[:, k + 2:] = (a[:, k + 2:] - factor[:, :, None] * a[:, k + 1: k + 2]) % p2
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2:] * factor[:, None] % p2).sum(axis=2)) % p1
    polynomials = np.zeros((size + 1, n, size + 1), np.int64)
    polynomials[0, :, 0] = 1
    for m in range(1, size + 1):
        now = np.zeros((n, size + 1), np.int64)
        now[:, 1:] = polynomials[m - 1, :, :-1]
        now -= a[:, m - 1, m - 1][:, None] * polynomials[m - 1] % p1
        below = np.ones(n, np.int64)
        for i in range(m - 2, -1, -1):
            below = below * a[:, i + 1, i] % p1[:, 0]
            now -= (a[:, i, m - 1] * below % p1[:, 0])[:, None] * polynomials[i] % p1
        polynomials[m] = now % p1
    return polynomials[size]


def characteristic(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients, lowest first, of the characteristic polynomial of a positive semidefinite integer matrix."""
    size = len(matrix)
    # A coefficient is a sum of products of eigenvalues, at most (1 + trace)^size in all.
    primes = primes_below(1 << 31, 2 * (1 + int(np.trace(matrix))) ** size if size else 1)
    shared = spark.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = batch.column(0).to_pylist()
            for at in range(0, len(mine), TASK_PRIMES):
                part = mine[at: at + TASK_PRIMES]
                found = characteristic_residues(shared.value, part)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(found.tolist(), pa.list_(pa.int64()))],
                                                 ["prime", "residues"])

    dealt = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(-(-len(primes) // TASK_PRIMES))
    rows = dealt.mapInArrow(run, "prime long, residues array<long>").collect()
    whole = prod(primes)
    total = [0] * (size + 1)
    for p, residues in rows:
        others = whole // p
        unit = others * pow(others, -1, p)
        total = [t + r * unit for t, r in zip(total, residues)]
    return [v - whole if 2 * v > whole else v for v in (t % whole for t in total)]


def roots_beyond(poly: list[int], at: int, scale: int) -> int:
    """How many roots of a real-rooted polynomial lie beyond at / 2^scale, with multiplicity."""
    size = len(poly) - 1
    c = [v << scale * (size - k) for k, v in enumerate(poly)]
    for i in range(size):  # c becomes the polynomial around ``at``
        for k in range(size - 1, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], at: int, scale: int) -> int:
    value = 0
    for k, v in enumerate(reversed(poly)):
        value = value * at + (v << scale * k)
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], most: int) -> list[tuple[int, int, int]]:
    """(numerator, binary exponent of the denominator, multiplicity) of the largest positive roots of a polynomial
    without negative or complex roots, until their multiplicities add up to ``most``."""
    poly = poly[next(i for i, v in enumerate(poly) if v):]
    rank, bound = len(poly) - 1, (-poly[-2] if len(poly) > 1 else 0)
    found: list[tuple[int, int, int]] = []
    done = 0
    while done < min(most, rank):
        lo, hi, scale, at_lo, at_hi = 0, bound, 0, rank, 0
        while (hi - lo) << ROOT_BITS > hi:
            if hi - lo < 2:
                lo, hi, scale = lo << 32, hi << 32, scale + 32
            mid = (lo + hi) // 2
            if at_lo - at_hi == 1:  # one simple root is left, where the sign changes
                here = _sign(poly, mid, scale)
                # Beyond the done roots above, the sign at a point right of this root is that of an even or odd number.
                beyond = done if here == (-1) ** done or here == 0 else done + 1
            else:
                beyond = roots_beyond(poly, mid, scale)
            if beyond > done:
                lo, at_lo = mid, beyond
            else:
                hi, at_hi = mid, beyond
        found.append((lo + hi, scale + 1, at_lo - at_hi))
        done += at_lo - at_hi
    return found


def null_vectors(matrix: np.ndarray, root: tuple[int, int], count: int) -> np.ndarray:
    """``count`` orthonormal vectors (rows, as doubles) that the matrix less a root takes to nothing."""
    numerator, scale = root
    size, one = len(matrix), 1 << WORK_BITS
    bound = max(1, int(np.trace(matrix))) << scale
    a = matrix * (1 << scale)
    a[np.diag_indices(size)] -= numerator
    a = a * one // bound
    rng = np.random.default_rng(size)
    x = rng.integers(-(1 << 30), 1 << 30, (size, count)).astype(object) * (one >> 30)
    order = np.arange(size)
    for k in range(size):
        pivot = k + max(range(size - k), key=lambda i: abs(a[k + i, k]))
        a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
        a[k, k] = a[k, k] or 1
        factor = (a[k + 1:, k] * one) // a[k, k]
        a[k + 1:, k + 1:] -= (factor[:, None] * a[k, k + 1:]) >> WORK_BITS
        a[k + 1:, k] = factor
    for _ in range(3):
        x = x[order]
        for k in range(size):
            x[k + 1:] -= (a[k + 1:, k][:, None] * x[k]) >> WORK_BITS
        for k in range(size - 1, -1, -1):
            x[k] = (x[k] - ((a[k, k + 1:][:, None] * x[k + 1:]).sum(axis=0) >> WORK_BITS)) * one // a[k, k]
        for j in range(count):  # orthonormal again, larger first
            x[:, j] = x[:, j] * one // max(1, max(abs(v) for v in x[:, j]))
            for _ in range(2):
                for i in range(j):
                    x[:, j] -= ((x[:, i] * x[:, j]).sum() >> WORK_BITS) * x[:, i] >> WORK_BITS
            x[:, j] = x[:, j] * one // isqrt(int((x[:, j] ** 2).sum()))
    rows = x.T
    for row in rows:
        if max(row, key=abs) < 0:
            row *= -1
    return np.array([[v / one for v in row] for row in rows])


def distinct_vectors(df: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """(table with the one column ``x`` of distinct integer vectors, stored; their length)."""
    given = df.where(usable(F.col(f"`{vector}`")))
    size = given.agg(F.max(F.size(F.col(f"`{vector}`")))).first()[0] or 0
    return stored(given.select(integers(F.col(f"`{vector}`"), size).alias("x")).distinct(), "vectors"), size


def fit(vectors: DataFrame, size: int, components: int) -> Model:
    """The model of distinct integer vectors in the column ``x``."""
    n, sums, products = moments(vectors, size) if size else (0, [], np.zeros((0, 0), object))
    matrix = n * products - np.array([[a * b for b in sums] for a in sums], object).reshape(size, size)
    trace = int(np.trace(matrix))
    if not trace:
        return Model(n, sums, 0, [], np.zeros((0, size)))
    roots, rows = [], []
    for numerator, scale, count in largest_roots(characteristic(vectors.sparkSession, matrix), components):
        roots += [(numerator, scale)] * count
        rows.append(null_vectors(matrix, (numerator, scale), count))
    return Model(n, sums, trace, roots[:components], np.vstack(rows)[:components])


def add_whitened(df: DataFrame, model: Model, x: str = "x", deviation: str = "deviation", whitened: str = "whitened") -> DataFrame:
    """Adds the squared deviation of n * x from the sums, and the whitened components."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        scales = np.array([(numerator / (1 << s)) ** 0.5 for numerator, s in m.roots])
        for batch in batches:
            v = _matrix(batch, len(m.sums)) if m.sums else np.zeros((len(batch), 0), np.int64)
            largest = max(abs(int(v.min())), abs(int(v.max()))) if v.size else 0
            reach = m.n * largest + max((abs(s) for s in m.sums), default=0)
            kind = np.int64 if reach ** 2 * v.shape[1] < 1 << 63 else object
            centred = v.astype(kind) * m.n - np.array(m.sums, kind)
            squares = [int(s) if s < 1 << 63 else None for s in (centred ** 2).sum(axis=1)]
            out = centred.astype(float) @ m.vectors.T / scales
            lists = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * len(scales), pa.array(out.ravel()))
            yield pa.StructArray.from_arrays([pa.array(squares, pa.int64()), lists], ["deviation", "whitened"])

    apply = F.arrow_udf(run, "struct<deviation:bigint,whitened:array<double>>")
    found = df.withColumn("_found", apply(F.col(f"`{x}`")))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (deviation, whitened)]
    return found.select(*kept, F.col("_found.deviation").alias(deviation), F.col("_found.whitened").alias(whitened))


def identity_error(vectors: DataFrame, model: Model) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity."""
    k = len(model.roots)
    if not k:
        return 0.0
    w = [F.col("whitened")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = add_whitened(vectors, model).agg(*[F.covar_pop(w[i], w[j]) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, row))


def whiten(df: DataFrame, components: int, vector: str = "embedding") -> DataFrame:
    """Fits the model on ``df`` and adds ``n``, ``deviation``, ``whitened`` and ``explained`` (arrays by component) and
    ``identity_error`` to every row with a usable vector."""
    vectors, size = distinct_vectors(df, vector)
    model = fit(vectors, size, components)
    given = df.where(usable(F.col(f"`{vector}`"))).withColumn("_x", integers(F.col(f"`{vector}`"), size))
    return add_whitened(given, model, "_x").drop("_x").withColumns({
        "n": F.lit(model.n).cast("bigint"), "identity_error": F.lit(identity_error(vectors, model)),
        "explained": F.array(*[F.lit(v) for v in model.explained()]).cast("array<double>")})

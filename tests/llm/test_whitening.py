"""Whitening against exact rational arithmetic and numpy on small tables."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurescope.llm import whitening

ROWS = "vec_id long, embedding array<double>"


def exact_polynomial(matrix):
    """Coefficients of det(t - M) by Faddeev and LeVerrier's recurrence over the rationals, lowest first."""
    d = len(matrix)
    coefficients, power = [Fraction(1)], [[Fraction(0)] * d for _ in range(d)]
    for k in range(1, d + 1):
        power = [
            [sum(matrix[i][m] * power[m][j] for m in range(d)) + coefficients[-1] * (i == j) for j in range(d)] for i in range(d)
        ]
        trace = sum(sum(matrix[i][m] * power[m][i] for m in range(d)) for i in range(d))
        coefficients.append(Fraction(-trace, k))
    return [int(c) for c in reversed(coefficients)]


def scatter_of(y):
    big = np.array(y, dtype=object)
    n, s = len(big), big.sum(axis=0)
    return (n * big.T.dot(big) - np.outer(s, s)).tolist()


@pytest.mark.parametrize("d,low,high", [(1, -9, 9), (2, -9, 9), (7, -90, 90), (9, -3, 3), (6, -(10**7), 10**7)])
def test_polynomial_is_exact(spark, d, low, high):
    y = np.random.default_rng(d).integers(low, high + 1, (12, d))
    if d == 9:
        y[:, 4] = y[:, 2]  # a null vector and a column that needs no elimination
        y[:, 5] = 0
    matrix = scatter_of(y)
    assert whitening.characteristic_polynomial(spark, matrix) == exact_polynomial(matrix)
    assert all(abs(c) <= whitening.coefficient_bound(matrix) for c in exact_polynomial(matrix))


def test_roots_and_their_repeats():
    def expanded(roots):
        poly = [1]
        for r in roots:
            poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
        return poly

    roots = [0, 0, 3, 7, 7, 7, 1000]
    poly = expanded(roots)
    assert [whitening.roots_beyond(poly, a) for a in (-1, 0, 2, 3, 6, 7, 999, 1000)] == [7, 5, 5, 4, 4, 1, 1, 0]
    found, s = whitening.largest_roots(poly, 16)
    assert [(f + 1) >> s for f in found] == [1000, 7, 7, 7, 3]
    irrational, s = whitening.largest_roots([1, -4, 1], 1)  # 2 + sqrt 3
    assert irrational[0] == math.isqrt(3 << (2 * s)) + (2 << s)


def test_null_vectors_of_close_and_equal_roots():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    matrix = [[5 if i == j else 0 for j in range(4)] for i in range(4)]
    matrix[3][3] = 2
    vectors = np.array(whitening.null_vectors(matrix, (5 << 200) - 1, 200, 3))
    assert np.allclose(vectors @ vectors.T, np.eye(3), atol=1e-15) and np.allclose(vectors[:, 3], 0, atol=1e-15)
    # Two eigenvalues that differ by two parts in 10^18: doubles cannot tell their vectors apart.
    big = 10**18
    found, s = whitening.largest_roots([big * big - 1, -2 * big, 1], 2)
    close = [whitening.null_vectors([[big, 1], [1, big]], r, s, 1)[0] for r in found]
    assert np.allclose(np.abs(close), math.sqrt(0.5), atol=1e-15) and abs(np.dot(*close)) < 1e-15


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [None if c is None else float(c) for c in v]) for i, v in enumerate(vectors)], ROWS)


def test_whitened_rows(spark):
    rng = np.random.default_rng(7)
    good = rng.normal(size=(60, 20)) @ rng.normal(size=(20, 20))
    vectors = [*good.tolist(), *good[:20].tolist(), good[0].tolist(), None, [], [1.0] * 19, [None, *good[0][1:]], [float("nan")] * 20, [float("inf"), *good[0][1:]]]
    docs = frame(spark, vectors).withColumn("component", F.lit("mine")).withColumn("x", F.lit(1))
    out = whitening.whiten(docs)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = out.orderBy("vec_id", "component").collect()
    assert len(rows) == 81 * 16 and rows[0]["identity_error"] < 1e-10
    x = np.floor(good * 64).astype(np.int64) + 1000000
    n, s = len(x), x.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(x.T.astype(float), bias=True))
    order = np.argsort(-values)[:16]
    every = np.vstack([x, x[:20], x[:1]])
    white = (every - s / n) @ axes[:, order] / np.sqrt(values[order])
    got = np.array([r["whitened"] for r in rows]).reshape(-1, 16)
    sign = np.sign((got * white).sum(axis=0))
    assert np.allclose(got, white * sign, rtol=1e-7, atol=1e-7)
    assert [r["component"] for r in rows[:16]] == list(range(1, 17)) and {r["n"] for r in rows} == {n}
    assert [r["deviation"] for r in rows[::16]] == [int(((n * v - s) ** 2).sum()) for v in every]
    assert np.allclose([r["explained"] for r in rows[:16]], values[order] / values.sum(), rtol=1e-9)


def test_few_vectors_and_none(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [[1.0, 2.0], [1.0, 2.0]])).count() == 0
    two = whitening.whiten(frame(spark, [[1.0, 2.0, 0.0], [3.0, 2.0, 0.0], [1.0, 2.0, 0.0]])).orderBy("vec_id").collect()
    assert [(r["component"], r["n"], r["deviation"], abs(round(r["whitened"], 12)), r["explained"]) for r in two] == [(1, 2, 128**2, 1.0, 1.0)] * 3


def test_products_of_large_entries():
    y = np.array([[1 << 40, 3], [-(1 << 41), 5]], dtype=np.int64)
    assert whitening.products(y).tolist() == [[(1 << 80) + (1 << 82), 3 * (1 << 40) - 5 * (1 << 41)], [3 * (1 << 40) - 5 * (1 << 41), 34]]
    wide = np.full((300, 2), (1 << 25) - 1, dtype=np.int64)
    assert whitening.products(wide).tolist() == [[300 * ((1 << 25) - 1) ** 2] * 2] * 2

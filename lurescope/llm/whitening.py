"""Embedding whitening through the exact characteristic polynomial of the integer scatter matrix.

Vectors become integers x. Over the distinct ones Spark sums the integers of the scatter matrix
M = n * sum(x x') - S S', so the covariance is M / n^2 without any rounding. The characteristic
polynomial of M is found modulo many primes (a Hessenberg reduction for each, spread over tasks) and put
together by Chinese remaindering, with a proven bound on its coefficients. All its roots are real, so
the signs of the polynomial shifted to a point count the roots beyond it exactly; halving with that count
isolates the largest roots to 256 bits below the largest. Components are null vectors of M - root, found by
inverse iteration in long decimals, one root to a task. Only what is as large as the matrix is ever held
on the driver; vectors stay in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext
from math import comb, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lurescope.session import materialise

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Bits to which roots are isolated below the largest, and decimal digits of the inverse iteration.
ROOT_BITS = 256
DIGITS = 200
_EXACT_DOUBLE = 1 << 53

WHITENED = "key long, component int, n long, deviation long, whitened double, explained double"


# --- Integer vectors and their sums ---------------------------------------------------------------


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x): floor(64 c) + 1000000 of every component c.

    Rows whose vector is null, empty, or has null or non-finite components take no part, nor do those whose
    length is not the commonest one (of equally common ones the longest). Repeated rows and keys stay.
    """
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    usable = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    sizes = usable.groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    usual = sizes.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    size = usual[0]["size"] if usual else 0
    whole = F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)
    return usable.where(F.size(vector) == size).select(F.col(key).cast("long").alias("key"), whole.alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) - SHIFT


def products(y: np.ndarray) -> np.ndarray:
    """y' y, exact, as Python integers."""
    most = int(np.abs(y).max(initial=0))
    if most < 1 << 26 and most * most * len(y) < _EXACT_DOUBLE:
        wide = y.astype(np.float64)
        return (wide.T @ wide).astype(np.int64).astype(object)
    if len(y) > 1 and most < 1 << 26:
        half = len(y) // 2
        return products(y[:half]) + products(y[half:])
    big = y.astype(object)
    return big.T.dot(big)


def scatter(fit: DataFrame) -> tuple[int, list[int], list[list[int]]]:
    """n, S (of x less its shift) and M of the rows of ``fit`` (x)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, table = 0, 0, 0
        for batch in batches:
            if batch.num_rows:
                y = _matrix(batch.column("x"))
                n, sums, table = n + len(y), sums + y.astype(object).sum(axis=0), table + products(y)
        if n:
            d = len(sums)
            i, j = np.triu_indices(d)
            places = np.concatenate([[-1], np.full(d, -1), i]), np.concatenate([[-1], np.arange(d), j])
            values = [n, *sums, *table[i, j]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(places[0].astype(np.int32)), pa.array(places[1].astype(np.int32)), pa.array([str(v) for v in values])],
                names=["i", "j", "v"],
            )

    parts = fit.mapInArrow(rows, "i int, j int, v string").groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    # As many rows as the matrix has entries in its upper half.
    found = {(r["i"], r["j"]): int(r["v"]) for r in parts.collect()}
    if not found:
        return 0, [], []
    n = found[-1, -1]
    d = max(j for _, j in found) + 1
    total = [found[-1, j] for j in range(d)]
    return n, total, [[n * found[min(i, j), max(i, j)] - total[i] * total[j] for j in range(d)] for i in range(d)]


# --- Characteristic polynomial --------------------------------------------------------------------


def is_prime(n: int) -> bool:
    """Miller's test with bases that decide every n below 2^64."""
    small = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37)
    if n < 2 or any(n % q == 0 for q in small):
        return n in small
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in small:
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """Primes below 2^31, largest first, whose product is more than twice ``bound``."""
    found, left, at = [], 2 * bound + 1, (1 << 31) - 1
    while left > 0:
        if is_prime(at):
            found.append(at)
            left //= at
        at -= 2
    return found


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient of the polynomial of a matrix without negative eigenvalues is larger.

    The k-th is the k-th elementary symmetric mean of the eigenvalues times comb(d, k), and no such mean
    passes the k-th power of the first, trace / d.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    mean = -(-trace // d)
    return max(comb(d, k) * mean**k for k in range(d + 1))


def modular_polynomial(matrix: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(t - M) modulo ``p``, the leading one last, by a Hessenberg reduction."""
    h = np.array([[v % p for v in row] for row in matrix], dtype=np.int64)
    d = len(h)
    for m in range(1, d - 1):
        pivots = np.flatnonzero(h[m:, m - 1])
        if not len(pivots):
            continue
        i = m + int(pivots[0])
        h[[i, m]] = h[[m, i]]
        h[:, [i, m]] = h[:, [m, i]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        # Rows below lose u times row m, so column m gains u times the columns behind it.
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    # det(t - H) of the leading blocks, each from the ones before.
    blocks = [np.zeros(d + 1, np.int64)]
    blocks[0][0] = 1
    for k in range(d):
        own = np.roll(blocks[k], 1)
        own = (own - int(h[k, k]) * blocks[k] % p) % p
        below = 1
        for i in range(k - 1, -1, -1):
            below = below * int(h[i + 1, i]) % p
            if not below:
                break
            own = (own - int(h[i, k]) * below % p * blocks[i] % p) % p
        blocks.append(own)
    return blocks[d].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(t - M), the leading one last; the residues are found by Spark tasks."""
    primes = primes_for(coefficient_bound(matrix))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("p").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int64()), pa.array([modular_polynomial(matrix, p) for p in own], pa.list_(pa.int64()))],
                names=["p", "residues"],
            )

    tasks = max(1, min(len(primes) // 4, spark.sparkContext.defaultParallelism))
    listed = spark.createDataFrame([(i, p) for i, p in enumerate(primes)], "i long, p long")
    # As many rows as primes, of one number per dimension.
    found = listed.repartitionByRange(tasks, "i").select("p").mapInArrow(rows, "p long, residues array<long>").collect()
    whole = prod(primes)
    sums = [0] * (len(matrix) + 1)
    for r in found:
        rest = whole // r["p"]
        factor = rest * pow(rest, -1, r["p"])
        sums = [s + factor * v for s, v in zip(sums, r["residues"])]
    signed = [s % whole for s in sums]
    return [s - whole if 2 * s > whole else s for s in signed]


# --- Roots ----------------------------------------------------------------------------------------


def roots_beyond(poly: list[int], at: int) -> int:
    """How many roots of a polynomial with real roots only are larger than ``at``, repeated ones included.

    It is the number of sign changes among the coefficients of the polynomial shifted to that point.
    """
    shifted = list(poly)
    for i in range(len(poly) - 1):
        for j in range(len(poly) - 2, i - 1, -1):
            shifted[j] += at * shifted[j + 1]
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _is_positive(poly: list[int], at: int) -> int:
    value = 0
    for c in reversed(poly):
        value = value * at + c
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], most: int, bits: int = ROOT_BITS) -> tuple[list[int], int]:
    """(floors, s): the ``most`` largest positive roots lie in (floor, floor + 1] / 2^s.

    ``poly`` has no root below zero; ``s`` makes the largest root ``bits`` bits long. Equal roots come as
    often as they are repeated.
    """
    d = len(poly) - 1
    ceiling = 1 << max(c.bit_length() for c in [-poly[d - 1] if d else 0, 1])  # the trace bounds every root
    s = max(0, bits - ceiling.bit_length() + 1)
    scaled = [c << (s * (d - k)) for k, c in enumerate(poly)]
    top = ceiling << s
    counts = {0: roots_beyond(scaled, 0), top: 0}

    def beyond(at: int) -> int:
        if at not in counts:
            counts[at] = roots_beyond(scaled, at)
        return counts[at]

    found = []
    for j in range(1, min(most, counts[0]) + 1):
        lo = max(a for a, c in counts.items() if c >= j)
        hi = min(a for a, c in counts.items() if c < j)
        while hi - lo > 1 and beyond(lo) - beyond(hi) > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if beyond(mid) >= j else (lo, mid)
        odd = 1 if j % 2 == 0 else -1
        while hi - lo > 1:  # one root is left, and its side is told by the sign at the middle
            mid = (lo + hi) // 2
            sign = _is_positive(scaled, mid)
            lo, hi = (mid, hi) if sign and sign == odd else (lo, mid)
        found.append(lo)
    return found, s


# --- Components -----------------------------------------------------------------------------------


def null_vectors(matrix: list[list[int]], root: int, s: int, many: int, digits: int = DIGITS) -> list[list[float]]:
    """``many`` orthonormal eigenvectors of the root in (root, root + 1] / 2^s by inverse iteration.

    The shift is the middle of that range. It is no integer, so it is no eigenvalue, and the matrix less
    the shift can be eliminated.
    """
    d = len(matrix)
    with localcontext() as context:
        context.prec = digits
        shift = Decimal(2 * root + 1) / (Decimal(2) ** (s + 1))
        table = np.array([[Decimal(v) for v in row] for row in matrix], dtype=object)
        table[np.arange(d), np.arange(d)] -= shift
        order, factors = [], []
        for k in range(d):
            i = k + max(range(d - k), key=lambda r: abs(table[k + r, k]))
            table[[i, k]] = table[[k, i]]
            factor = table[k + 1 :, k] / table[k, k]
            table[k + 1 :, k:] -= factor[:, None] * table[k, k:]
            order.append(i)
            factors.append(factor)

        def solved(b: np.ndarray) -> np.ndarray:
            b = b.copy()
            for k in range(d):
                b[[order[k], k]] = b[[k, order[k]]]
                b[k + 1 :] -= factors[k] * b[k]
            for k in range(d - 1, -1, -1):
                b[k] = (b[k] - table[k, k + 1 :].dot(b[k + 1 :])) / table[k, k] if k < d - 1 else b[k] / table[k, k]
            return b

        def clean(v: np.ndarray) -> np.ndarray:
            for _ in range(2):
                for other in found:
                    v = v - other * other.dot(v)
            return v / v.dot(v).sqrt()

        found: list[np.ndarray] = []
        rng = np.random.default_rng(1)
        for _ in range(many):
            v = clean(np.array([Decimal(int(x)) for x in rng.integers(1, 1000, d)], dtype=object))
            for _ in range(3):
                v = clean(solved(v))
            found.append(v if max(v, key=abs) > 0 else -v)
        return [[float(c) for c in v] for v in found]


@dataclass
class Whitening:
    """The fitted transform: ``vectors[k]`` is a component, ``scales[k]`` the root of its eigenvalue."""

    n: int
    #: Sums of x.
    sums: list[int]
    vectors: list[list[float]]
    scales: list[float]
    explained: list[float]

    def apply(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Deviations and whitened coordinates of rows of x less its shift."""
        less = np.array([v - self.n * SHIFT for v in self.sums], dtype=object)
        reach = max(int(np.abs(y).max(initial=0)), 1) * self.n + max(map(abs, less), default=0)
        if reach * reach * y.shape[1] < 1 << 63:
            away = y * self.n - less.astype(np.int64)
            deviations = (away * away).sum(axis=1)
        else:  # beyond 64 bits the sum itself may fail, as it has no place in a long
            away = y.astype(object) * self.n - less
            deviations = (away * away).sum(axis=1)
        centred = away.astype(np.float64) / self.n
        return deviations, centred @ np.array(self.vectors).T / np.array(self.scales)


def fit(spark: SparkSession, rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The transform of the distinct integer vectors in ``rows`` (x).

    Components are numbered by falling eigenvalue; those of eigenvalue zero cannot be whitened and are left
    out, so there may be fewer than ``components``, or none at all.
    """
    n, less, matrix = scatter(rows)
    sums = [s + n * SHIFT for s in less]
    trace = sum(matrix[i][i] for i in range(len(matrix)))
    if not trace:
        return Whitening(n, sums, [], [], [])
    poly = characteristic_polynomial(spark, matrix)
    if poly[-2] != -trace:
        raise ArithmeticError("the polynomial does not have the matrix's trace")
    roots, s = largest_roots(poly, components)
    clusters = [(r, roots.count(r)) for r in sorted(set(roots), reverse=True)]

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("i").to_pylist():
                vectors = null_vectors(matrix, *clusters[i][:1], s, clusters[i][1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * len(vectors), pa.int64()), pa.array(vectors, pa.list_(pa.float64()))], names=["i", "v"]
                )

    listed = spark.createDataFrame([(i,) for i in range(len(clusters))], "i long")
    spread = listed.repartitionByRange(max(1, min(len(clusters), spark.sparkContext.defaultParallelism)), "i")
    # One row per component, of one number per dimension.
    found = sorted(spread.mapInArrow(rows_of, "i long, v array<double>").collect(), key=lambda r: r["i"])
    with localcontext() as context:
        context.prec = DIGITS
        values = [Decimal(2 * clusters[r["i"]][0] + 1) / (Decimal(2) ** (s + 1)) for r in found]
        scales = [float(v.sqrt() / n) for v in values]
        explained = [float(v / trace) for v in values]
    return Whitening(n, sums, [list(r["v"]) for r in found], scales, explained)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry, without its sign, of the whitened ``rows``' covariance less the identity."""
    k = len(model.scales)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                _, white = model.apply(_matrix(batch.column("x")))
                total += np.vstack([white.T @ white, white.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], names=["i", "v"])

    if not k:
        return 0.0
    # As many rows as components squared.
    found = rows.mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    total = np.array([r["v"] for r in found]).reshape(k + 1, k) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: key, component (from 1), n, deviation, whitened, explained, identity_error.

    ``integer_vectors`` says which rows are usable. An empty table, or one whose usable vectors are all equal,
    has no component and gives no rows. Keys may be null or repeated; other columns are ignored.
    """
    spark = rows.sparkSession
    whole = integer_vectors(rows, key, vector)
    distinct = materialise(whole.select("x").distinct(), "distinct_vectors")
    model = fit(spark, distinct, components)
    error = identity_error(distinct, model)
    k = len(model.scales)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows if k else 0, 4096):
                own = batch.slice(at, 4096)
                deviations, white = model.apply(_matrix(own.column("x")))
                n = own.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        own.column("key").take(pa.array(np.repeat(np.arange(n), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                        pa.array(np.full(n * k, model.n), pa.int64()),
                        pa.array(np.repeat(deviations, k), pa.int64()),
                        pa.array(white.ravel()),
                        pa.array(np.tile(model.explained, n)),
                    ],
                    names=["key", "component", "n", "deviation", "whitened", "explained"],
                )

    made = whole.mapInArrow(rows_of, WHITENED).withColumnRenamed("key", key)
    return made.withColumn("identity_error", F.lit(error))

"""Distributed order statistics: cumulative counts over a score without a one-task sort.

``score_ladder`` is the base of quantiles, curves, AUC and threshold choice. A first pass sketches
bucket edges; the ladder then collapses equal scores (so a score shared by a third of the rows
costs one row), prefix-sums the bucket totals, and accumulates inside each bucket. The edges only
steer the work: they enter the plan as constants, and with any edges every count is exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_BUCKETS = 4096
ROWS_PER_BUCKET = 50_000
_ACCURACY = 10_000


def literals(values: Iterable[float]) -> str:
    """SQL array of doubles (one parse instead of one call per element)."""
    one = lambda v: f"{v!r}D" if math.isfinite(v) else f"double('{v!r}')"
    return "cast(array(" + ", ".join(one(float(v)) for v in values) + ") as array<double>)"


def leading(sorted_values: Column, size: int, test: Callable[[Column], Column]) -> Column:
    """How many leading elements pass ``test``, which must hold for a prefix only.

    A binary search over powers of two; positions past the end are null and fail.
    """
    steps = [1 << k for k in reversed(range(max(size, 1).bit_length()))]

    def probe(found: Column, jump: Column) -> Column:
        there = F.get(sorted_values, found + jump - 1)
        return F.when(there.isNotNull() & test(there), found + jump).otherwise(found)

    # Never null, so a join on it adds no null filter that would repeat the search at the scan.
    return F.coalesce(F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), probe), F.lit(0))


def upper_bound(sorted_values: Column, size: int, value: Column) -> Column:
    """How many of ``sorted_values`` (at most ``size``) are <= ``value``, by binary search."""
    return leading(sorted_values, size, lambda there: there <= value)


def attach(df: DataFrame, small: DataFrame, names: Sequence[str]) -> DataFrame:
    """Give every row the values of a one-row frame, through a scalar subquery."""
    packed = small.select(F.struct(*names).alias("v")).scalar()
    return df.withColumn("_row", packed).select(
        *df.columns, *(F.col("_row")[n].alias(n) for n in names)
    )


def bucket_edges(scores: DataFrame) -> list[float]:
    """At most ``MAX_BUCKETS`` - 1 increasing edges that cut ``scores`` into similar parts.

    One pass with a quantile sketch per task; only the sketch travels. A sketch merges in arrival
    order and may differ between runs, hence it is read once and handed on as constants.
    """
    grid = literals(i / MAX_BUCKETS for i in range(1, MAX_BUCKETS))
    row = scores.agg(
        F.count(F.lit(1)).alias("n"),
        F.expr(f"percentile_approx(score, {grid}, {_ACCURACY})").alias("grid"),
    ).first()
    wanted = min(MAX_BUCKETS, row["n"] // ROWS_PER_BUCKET)
    if wanted < 2:
        return []
    stride = MAX_BUCKETS // wanted
    return sorted(set(row["grid"][stride - 1 :: stride]))


def score_ladder(
    df: DataFrame, score: str, positive: Column | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """One row per (group, distinct score) with running counts, scores ascending.

    Columns: ``by``, ``score``, ``n`` rows and ``pos`` positives at this score, ``cum_n`` and
    ``cum_pos`` up to and including it, ``total_n`` and ``total_pos`` per group; the three ``pos``
    columns only with a ``positive`` condition. Null and NaN scores are left out. Groups share the
    edges, so no (group, bucket) part is larger than its bucket.
    """
    by = list(by)
    # Adding zero folds -0.0 into 0.0.
    value = F.col(score).cast("double") + F.lit(0.0)
    counts = [F.count(F.lit(1)).alias("n")]
    tallies = {"n": "total_n"}
    columns = [*by, value.alias("score")]
    if positive is not None:
        columns.append(positive.cast("bigint").alias("_pos"))
        counts.append(F.sum("_pos").alias("pos"))
        tallies["pos"] = "total_pos"
    valid = df.select(*columns).where(F.col("score").isNotNull() & ~F.isnan("score"))
    edges = bucket_edges(valid)
    distinct = valid.groupBy(*by, "score").agg(*counts)
    slot = upper_bound(F.expr(literals(edges)), len(edges), F.col("score"))
    placed = distinct.withColumn("_bucket", slot)
    totals = placed.groupBy(*by, "_bucket").agg(*(F.sum(c).alias(f"_{c}") for c in tallies))
    whole = Window.partitionBy(*by or [F.lit(0)])
    upto = whole.orderBy("_bucket")
    offsets = totals.select(
        *by,
        "_bucket",
        *((F.sum(f"_{c}").over(upto) - F.col(f"_{c}")).alias(f"_{c}") for c in tallies),
        *(F.sum(f"_{c}").over(whole).alias(total) for c, total in tallies.items()),
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy("score").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # One row per bucket without groups, so a bounded broadcast; with groups Spark sizes the join.
    side = offsets if by else F.broadcast(offsets)
    return placed.join(side, [*by, "_bucket"]).select(
        *by,
        "score",
        *tallies,
        *((F.col(f"_{c}") + F.sum(c).over(inside)).alias(f"cum_{c}") for c in tallies),
        *tallies.values(),
    )


def ladder_quantiles(ladder: DataFrame, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated quantiles of a ladder: one (group, q_index, q, value) row per prob.

    ``rung`` is the ladder row just at or below the value. Only the rungs that hold a wanted rank
    leave the scan, at most two per prob and group.
    """
    by, columns = list(by), ladder.columns
    order = sorted(range(len(probs)), key=lambda i: probs[i])
    ordered = F.expr(literals(probs[i] for i in order))
    places = F.expr(f"array({', '.join(map(str, order))})")
    # A rung covers ranks [low, high]; prob p asks for the ranks around (total_n - 1) * p.
    span = F.col("total_n") - 1
    low, high = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    first = leading(ordered, len(order), lambda p: F.ceil(span * p) < low)
    last = leading(ordered, len(order), lambda p: F.floor(span * p) <= high)
    hit = (
        ladder.withColumn("_first", first)
        .withColumn("_last", last)
        .where(F.col("_last") > F.col("_first"))
        .withColumn(
            "_hit",
            F.explode(
                F.slice(
                    F.arrays_zip(ordered.alias("p"), places.alias("i")),
                    F.col("_first") + 1,
                    F.col("_last") - F.col("_first"),
                )
            ),
        )
        .withColumn("_h", span * F.col("_hit.p"))
    )
    floor_rank, ceil_rank = F.floor("_h"), F.ceil("_h")
    carried = [c for c in ("n", "pos", "cum_n", "cum_pos", "total_n", "total_pos") if c in columns]
    lower = F.when(floor_rank.between(low, high), F.struct("score", *carried))
    wanted = hit.groupBy(*by, F.col("_hit.i").alias("q_index"), F.col("_hit.p").alias("q")).agg(
        F.max(lower).alias("_a"),
        F.max(F.when(ceil_rank.between(low, high), F.col("score"))).alias("_b"),
        F.max(F.col("_h") - floor_rank).alias("_f"),
    )
    low_score = F.col("_a.score")
    value = low_score + (F.col("_b") - low_score) * F.col("_f")
    return wanted.select(
        *by, "q_index", "q", value.alias("value"), F.col("_a").alias("rung")
    )


def quantiles(df: DataFrame, score: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles of ``score``; see :func:`ladder_quantiles`."""
    return ladder_quantiles(score_ladder(df, score, by=by), probs, by).drop("rung")


def median(df: DataFrame, score: str, name: str = "median") -> DataFrame:
    """One-row frame with the exact median."""
    return quantiles(df, score, [0.5]).agg(F.max("value").alias(name))

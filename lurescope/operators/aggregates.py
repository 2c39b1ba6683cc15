"""Counts, mixes and summaries used by the readiness reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .metrics import ratio
from .ranking import attach, quantiles

# Fixed value: majority share above which resampling is suggested.
IMBALANCE = 0.70


def per_source_counts(df: DataFrame, source: str = "source", label: str = "label") -> DataFrame:
    """Rows, phishing (0) and legitimate (1) rows per source."""
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(label) == 0).alias("phishing_0"),
        F.count_if(F.col(label) == 1).alias("legit_1"),
    )


def mix(df: DataFrame, column: str) -> DataFrame:
    """Value counts with their share of all rows."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return attach(counts, total, ["_total"]).select(
        column, "n", (F.col("n") / F.col("_total")).alias("share")
    )


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """Class counts (0 safe, 1 phishing), majority share and the resampling flag."""
    counts = df.agg(
        F.count_if(F.col(label) == 0).alias("safe_0"),
        F.count_if(F.col(label) == 1).alias("phishing_1"),
    )
    majority = ratio(
        F.greatest("safe_0", "phishing_1").cast("double"), F.col("safe_0") + F.col("phishing_1")
    )
    return counts.withColumn("majority_fraction", majority).withColumn(
        "resampling_advised", F.col("majority_fraction") > IMBALANCE
    )


def score_summary(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max per score column."""
    long = df.unpivot([], list(scores), "model", "score") if len(scores) > 1 else df.select(
        F.lit(scores[0]).alias("model"), F.col(scores[0]).alias("score")
    )
    basic = long.groupBy("model").agg(
        F.count("score").alias("n"),
        F.avg("score").alias("mean"),
        F.stddev_samp("score").alias("std"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
    )
    points = quantiles(long, "score", [0.25, 0.5, 0.75], ["model"]).groupBy("model").agg(
        *(
            F.max(F.when(F.col("q_index") == i, F.col("value"))).alias(name)
            for i, name in enumerate(("q25", "median", "q75"))
        )
    )
    return basic.join(points, "model").select(
        "model", "n", "mean", "std", "min", "q25", "median", "q75", "max"
    )


def score_separation(df: DataFrame, scores: Sequence[str], target: str) -> DataFrame:
    """Mean score of phishing and legitimate rows, their difference and whether it is positive."""
    cells = []
    for s in scores:
        phish = F.avg(F.when(F.col(target) == 1, F.col(s)))
        legit = F.avg(F.when(F.col(target) == 0, F.col(s)))
        cells.append(
            F.struct(
                F.lit(s).alias("model"), phish.alias("phish_mean"), legit.alias("legit_mean")
            ).alias(s)
        )
    rows = df.agg(*cells).select(F.explode(F.array(*scores)).alias("r")).select("r.*")
    return rows.withColumn("diff", F.col("phish_mean") - F.col("legit_mean")).withColumn(
        "correct_direction", F.col("diff") > 0
    )


def casing_stats(df: DataFrame, text: str, cased_from: float = 0.5) -> DataFrame:
    """Rows, share of rows with an ASCII capital, mean uppercase share, and the cased advice."""
    from ..functions.text import has_capital, uppercase_share

    rows = df.where(F.col(text).isNotNull())
    out = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(has_capital(F.col(text)).cast("double")).alias("has_upper"),
        F.avg(uppercase_share(F.col(text))).alias("upper_share"),
    )
    return out.withColumn("cased_advised", F.col("has_upper") >= cased_from)


# Reported quantiles and length caps of the token profile.
LENGTH_PROBS = (0.50, 0.75, 0.90, 0.95, 0.99)
LENGTH_CAPS = (128, 256, 384, 512)


def clipped_histogram(df: DataFrame, column: str, high: float = 600.0, bins: int = 60) -> DataFrame:
    """(bin, low, high, n): equal-width bins from the smallest value to ``high``; larger ones count in the last."""
    rows = df.where(F.col(column).isNotNull()).select(F.least(F.col(column).cast("double"), F.lit(high)).alias("_v"))
    ends = rows.agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"))
    placed = attach(rows, ends, ["_low", "_high"])
    width = F.when(F.col("_high") > F.col("_low"), (F.col("_high") - F.col("_low")) / bins).otherwise(1.0 / bins)
    slot = F.least(F.floor((F.col("_v") - F.col("_low")) / width), F.lit(bins - 1)).cast("int")
    counts = placed.groupBy(slot.alias("bin"), F.col("_low").alias("start"), width.alias("width")).agg(
        F.count(F.lit(1)).alias("n")
    )
    low = F.col("start") + F.col("bin") * F.col("width")
    return counts.select("bin", low.alias("low"), (low + F.col("width")).alias("high"), "n")


def token_length_profile(df: DataFrame, tokens: str) -> DataFrame:
    """Quantiles and maximum of a token-count column and the share of rows within each cap.

    Counts are integers with few distinct values, so the exact quantiles come from a small ladder.
    """
    base = df.agg(
        F.count(tokens).alias("n"),
        F.max(tokens).alias("max_tokens"),
        *(F.avg((F.col(tokens) <= c).cast("double")).alias(f"within_{c}") for c in LENGTH_CAPS),
    )
    points = quantiles(df, tokens, LENGTH_PROBS).agg(
        *(
            F.max(F.when(F.col("q_index") == i, F.floor("value"))).alias(f"p{round(p * 100)}")
            for i, p in enumerate(LENGTH_PROBS)
        )
    )
    names = [f"p{round(p * 100)}" for p in LENGTH_PROBS]
    return attach(base, points, names)

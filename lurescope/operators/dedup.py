"""Deduplication and conflict removal by grouping.

Everything here is a hash aggregation with map-side combine, so a key that holds a third of all
rows is reduced before it is shuffled. Buffers of numbers keep Spark on hash aggregation; carrying a
string column from the first row (``keep_first``) makes it sort instead, so carry a number where possible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

_ID_BITS = 54


def order_key(priority: Column, row_id: Column) -> Column:
    """One long that orders by source priority first and row id second."""
    in_range = (row_id >= 0) & (row_id < F.lit(1 << _ID_BITS)) & priority.between(0, 511)
    packed = F.shiftleft(priority.cast("bigint"), _ID_BITS).bitwiseOR(row_id.cast("bigint"))
    return F.when(in_range, packed).otherwise(F.raise_error(F.lit("row id or priority out of range")))


def keep_first(df: DataFrame, keys: Sequence[str], order: str, carry: Sequence[str] = ()) -> DataFrame:
    """The first row per key in ``order``; ``carry`` columns come from that row."""
    picked = [F.min_by(c, order).alias(c) for c in carry]
    out = df.groupBy(*keys).agg(F.min(order).alias(order), *picked)
    return out.select(*[c for c in df.columns if c in {*keys, order, *carry}])


def group_urls(union: DataFrame) -> DataFrame:
    """One row per URL with its label range, best source priority and row count.

    Only labelled rows count, both for the label and for the source a URL is credited to.
    """
    return union.where(F.col("label").isNotNull()).groupBy("url").agg(
        F.min("label").alias("label"),
        F.max("label").alias("label_max"),
        F.min("priority").alias("priority"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def conflicting_urls(union: DataFrame) -> DataFrame:
    """URLs that carry more than one label."""
    grouped = group_urls(union).where(F.col("label") != F.col("label_max"))
    return grouped.select("url", "n_rows")


def url_corpus(union: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Drop conflicting URLs entirely, keep one row per other URL with its best source."""
    kept = group_urls(union).where(F.col("label") == F.col("label_max"))
    names = F.array(*[F.lit(s) for s in sources])
    return kept.select("url", "label", F.get(names, F.col("priority")).alias("source"))

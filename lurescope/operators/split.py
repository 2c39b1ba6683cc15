"""Seeded stratified splitting and sampling without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import broadcast_if_small

MAX_BROADCAST_STRATA = 100_000


def seeded_hash(key: Column | str, seed: int = 42) -> Column:
    """Reproducible order for sampling: the same on every partitioning and engine."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))


def _cut_points(keyed: DataFrame) -> DataFrame:
    """Per stratum the hash at which train ends and the hash at which validation ends.

    A histogram over the first 16 hash bits locates the two buckets in which the quotas end; only
    rows of those buckets are ranked. No task ever sees a whole stratum.
    """
    histogram = keyed.groupBy("_s", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("_s")
    edges = (
        histogram.withColumn("_upto", F.sum("_n").over(whole.orderBy("_bucket")))
        .withColumn("_total", F.sum("_n").over(whole))
        .withColumn("_before", F.col("_upto") - F.col("_n"))
        .withColumn("_train", F.expr("(_total * 8) div 10"))
        .withColumn("_val", F.expr("_train + (_total - _train) div 2"))
    )

    def holds(quota: str) -> Column:
        return (F.col("_before") < F.col(quota)) & (F.col(quota) <= F.col("_upto"))

    edges = edges.where(holds("_train") | holds("_val")).select(
        "_s", "_bucket", "_before", "_train", "_val"
    )
    ranked = (
        keyed.join(broadcast_if_small(edges, MAX_BROADCAST_STRATA), ["_s", "_bucket"])
        .groupBy("_s", "_bucket", "_before", "_train", "_val", "_h")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn(
            "_rank",
            F.col("_before") + F.sum("_c").over(Window.partitionBy("_s", "_bucket").orderBy("_h")),
        )
    )

    def end(quota: str) -> Column:
        # The bare bucket prefix sorts before every hash of its bucket; it is the answer when a
        # repeated key would overrun the quota with the first hash already.
        inside = F.when(F.col("_rank") <= F.col(quota), F.col("_h"))
        return F.max(inside.when(F.col("_before") < F.col(quota), F.col("_bucket")))

    return ranked.groupBy("_s").agg(end("_train").alias("_train_end"), end("_val").alias("_val_end"))


def stratified_split(df: DataFrame, key: str, stratum: str, seed: int = 42) -> DataFrame:
    """Append ``split``: 80 % train, then half of the rest each to val and test, per stratum.

    ``key`` identifies a row; rows that share a key always land in the same split. The order
    within a stratum is by seeded hash, so the result does not depend on partitioning. Once the
    cut table (one row per stratum) is known, tagging the data is a map without a shuffle.
    """
    code = F.coalesce(F.col(stratum).cast("string"), F.lit("\x00"))
    hashed = seeded_hash(key, seed)
    keyed = df.select(code.alias("_s"), hashed.alias("_h")).withColumn(
        "_bucket", F.substring("_h", 1, 4)
    )
    cuts = broadcast_if_small(_cut_points(keyed), MAX_BROADCAST_STRATA)
    split = (
        F.when(F.col("_h") <= F.col("_train_end"), "train")
        .when(F.col("_h") <= F.col("_val_end"), "val")
        .otherwise("test")
    )
    tagged = df.withColumn("_s", code).withColumn("_h", hashed)
    return tagged.join(cuts, "_s", "left").withColumn("split", split).select(*df.columns, "split")


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows with the smallest seeded hash (a take-ordered plan, no full sort)."""
    return df.orderBy(seeded_hash(key, seed), key).limit(n)


def sample_per_class(df: DataFrame, key: str, by: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows per class; the rank filter prunes inside each input partition first."""
    window = Window.partitionBy(by).orderBy(seeded_hash(key, seed), key)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")

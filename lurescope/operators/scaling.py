"""Train-fitted standard scaling. The fitted state is a one-row frame with the feature list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F



def fit_scaler(train: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population deviation per feature in one aggregation; zero deviation becomes 1."""
    stats = train.agg(
        *(F.avg(f).alias(f"_m{i}") for i, f in enumerate(features)),
        *(F.stddev_pop(f).alias(f"_s{i}") for i, f in enumerate(features)),
    )
    deviation = lambda i: F.when(F.col(f"_s{i}") == 0, 1.0).otherwise(F.col(f"_s{i}"))
    return stats.select(
        F.lit(list(features)).alias("features"),
        F.array(*(F.col(f"_m{i}") for i in range(len(features)))).alias("mean"),
        F.array(*(deviation(i) for i in range(len(features)))).alias("std"),
    )


def scaler_rows(state: DataFrame) -> DataFrame:
    """The state as one (position, feature, mean, std) row per feature."""
    zipped = F.arrays_zip("features", "mean", "std")
    return state.select(F.posexplode(zipped).alias("position", "z")).select(
        "position", F.col("z.features").alias("feature"), "z.mean", "z.std"
    )


def apply_scaler(df: DataFrame, state: DataFrame, features: Sequence[str]) -> DataFrame:
    """``(x - mean) / std`` for every feature, never refitted: a map with constants.

    The state is read here, so its lineage is not repeated in the plan of ``df``. Its feature list
    must equal ``features``: the two URL feature spaces and their subsets are not
    interchangeable.
    """
    fitted = load_scaler(state, features)
    scaled = {f: (F.col(f) - mean) / std for f, mean, std in fitted}
    return df.select(*(scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns))


def load_scaler(state: DataFrame, features: Sequence[str]) -> list[tuple[str, float, float]]:
    """Read the fitted numbers (two per feature) and check which features they belong to."""
    row = state.first()
    if list(row["features"]) != list(features):
        raise ValueError(f"scaler was fitted on {row['features']}, not on {list(features)}")
    return list(zip(row["features"], row["mean"], row["std"]))


def mean_square(features: Sequence[str]) -> Column:
    """Mean squared scaled value: a model-free distance from the training mean."""
    total = F.lit(0.0)
    for f in features:
        total = total + F.col(f) * F.col(f)
    return total / len(features)


def feature_health(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: non-null, null, NaN and infinite values, in one aggregation."""
    packed = df.agg(
        *(
            F.struct(
                F.lit(f).alias("feature"),
                F.count(f).alias("n_values"),
                F.count_if(F.col(f).isNull()).alias("n_null"),
                F.count_if(F.isnan(f)).alias("n_nan"),
                F.count_if(F.abs(F.col(f)) == float("inf")).alias("n_inf"),
            ).alias(f"_h{i}")
            for i, f in enumerate(features)
        )
    )
    rows = F.explode(F.array(*(F.col(f"_h{i}") for i in range(len(features)))))
    return packed.select(rows.alias("r")).select("r.*")


def feature_means(df: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    """One (feature, mean) row per feature from one aggregation."""
    wide = df.agg(*(F.avg(f).alias(f) for f in features))
    return wide.unpivot([], list(features), "feature", name)


def feature_shift(train: DataFrame, other: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean of each scaled feature on both sides and the shift between them."""
    a = feature_means(train, features, "train_mean")
    b = feature_means(other, features, "eval_mean")
    return a.join(F.broadcast(b), "feature").withColumn("shift", F.col("eval_mean") - F.col("train_mean"))

"""Isolation forest after Liu, Ting and Zhou (2008): sampling and growth on Spark, small state.

The forest is a node table with at most ``trees * (2 * samples - 1)`` rows, a bound set by
the parameters and not by the data; scoring collects and broadcasts exactly that.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ranking import attach

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, path double, "
    "n_samples int, max_samples int"
)
_SPAN = 1 << 32


def average_path(n):
    """Expected path length of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    full = 2 * (np.log(safe - 1) + 0.5772156649) - 2 * (safe - 1) / safe
    return np.where(n > 2, full, np.where(n == 2, 1.0, 0.0))


def _draw(*parts: Column | str) -> Column:
    """32 reproducible bits of the parts: the first eight digits of their md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("bigint")


def _bits(*parts: object) -> int:
    """:func:`_draw` in Python."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def wanted_rows(samples: int) -> float:
    """Expected candidates per tree: enough that fewer than ``samples`` are as good as impossible."""
    return samples + 10 * math.sqrt(samples) + 20


def _tree_samples(df: DataFrame, key: str, features: Sequence[str], trees: int, samples: int, seed: int) -> DataFrame:
    """Candidate rows per tree: a few more than ``samples`` each, every row equally likely.

    One hash decides whether a row is a candidate at all; only those few rows draw once per
    tree. On small input both draws pass every row.
    """
    counted = attach(df.select(key, *features), df.agg(F.count(F.lit(1)).alias("_n")), ["_n"])
    per_tree = F.least(F.lit(1.0), wanted_rows(samples) / F.greatest("_n", F.lit(1)))
    any_tree = F.least(F.lit(1.0), per_tree * trees)
    name, salt = F.col(key).cast("string"), F.lit(str(seed))
    chosen = counted.where(_draw(name, salt, F.lit("row")) < any_tree * _SPAN)
    draws = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: _draw(name, t.cast("string"), salt) < per_tree / any_tree * _SPAN,
    )
    return chosen.withColumn("tree", F.explode(draws)).select(
        "tree",
        F.md5(F.concat_ws("|", name, F.col("tree").cast("string"), salt, F.lit("order"))).alias("_order"),
        F.col(key).alias("_key"),
        *features,
    )


def _grow(x: np.ndarray, tree: int, seed: int, limit: int) -> list[tuple]:
    """Nodes (node, feature, threshold, left, right, path) of one tree; leaves point to themselves.

    The root is 1 and the children of i are 2i and 2i + 1. Feature and cut of a node are drawn from
    the md5 of tree, node and seed, so any engine can grow the same tree.
    """
    nodes = []
    pending = [(1, np.arange(len(x)), 0)]
    while pending:
        at, rows, depth = pending.pop()
        part = x[rows]
        spread = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or len(spread) == 0:
            nodes.append((at, 0, np.inf, at, at, depth + float(average_path(len(rows)))))
            continue
        feature = int(spread[_bits(tree, at, seed, "feature") * len(spread) // _SPAN])
        values = part[:, feature]
        low, high = values.min(), values.max()
        cut = low + (high - low) * (_bits(tree, at, seed, "cut") / _SPAN)
        below = values <= cut
        nodes.append((at, feature, cut, 2 * at, 2 * at + 1, 0.0))
        pending += [(2 * at, rows[below], depth + 1), (2 * at + 1, rows[~below], depth + 1)]
    return sorted(nodes)


def fit_forests(
    df: DataFrame, key: str, features: Sequence[str], settings: Sequence[tuple[int, int]], seed: int = 42
) -> DataFrame:
    """Node table for several (trees, samples) settings, grown in one job.

    A tree index draws one sample of the largest size; smaller settings use its first rows, and
    fewer trees are a prefix of more. Each index grows in its own group of about ``samples`` rows.
    Rows with a null or NaN feature are left out. Trees depend only on keys, values and seed.
    """
    features = list(features)
    usable = df.dropna(subset=features)
    drawn = _tree_samples(usable, key, features, max(t for t, _ in settings), max(n for _, n in settings), seed)
    depth_of = {n: max(t for t, m in settings if m == n) for _, n in settings}

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_order", "_key"])
        tree = int(group["tree"].iloc[0])
        parts = []
        for samples, trees in depth_of.items():
            if tree >= trees:
                continue
            x = group[features].head(samples).to_numpy(float)
            limit = max(1, math.ceil(math.log2(samples)))
            nodes = _grow(x, tree, seed, limit)
            out = pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "path"])
            out.insert(0, "tree", tree)
            out["n_samples"], out["max_samples"] = len(x), samples
            parts.append(out)
        return pd.concat(parts)

    return drawn.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def select_forest(nodes: DataFrame, trees: int, samples: int) -> DataFrame:
    """The node table of one setting."""
    return nodes.where((F.col("max_samples") == samples) & (F.col("tree") < trees))


def fit_forest(df: DataFrame, key: str, features: Sequence[str], trees: int = 200, samples: int = 512, seed: int = 42) -> DataFrame:
    """Node table of one forest; see :func:`fit_forests`."""
    return fit_forests(df, key, features, [(trees, samples)], seed)


def _arrays(nodes: pd.DataFrame) -> dict[str, np.ndarray]:
    trees = {t: i for i, t in enumerate(sorted(nodes["tree"].unique()))}
    rows, cols = nodes["tree"].map(trees).to_numpy(), nodes["node"].to_numpy()
    shape = (len(trees), int(cols.max()) + 1)
    packed = {}
    for name, kind in (("feature", np.int32), ("threshold", float), ("left", np.int32), ("right", np.int32), ("path", float)):
        table = np.zeros(shape, dtype=kind)
        table[rows, cols] = nodes[name].to_numpy()
        packed[name] = table
    packed["norm"] = average_path(nodes.groupby("tree")["n_samples"].first().max())
    return packed


def score_matrix(x: np.ndarray, forest: dict[str, np.ndarray], chunk: int = 2048) -> np.ndarray:
    """Anomaly scores of a feature matrix: all trees of a chunk of rows step down together.

    Leaves point to themselves, so the walk ends when no row moves.
    """
    out = np.empty(len(x))
    lanes = np.arange(forest["feature"].shape[0])
    norm = max(float(forest["norm"]), 1e-12)
    for start in range(0, len(x), chunk):
        part = x[start : start + chunk]
        at = np.ones((len(part), len(lanes)), dtype=np.int32)
        rows = np.arange(len(part))[:, None]
        while True:
            go_left = part[rows, forest["feature"][lanes, at]] <= forest["threshold"][lanes, at]
            down = np.where(go_left, forest["left"][lanes, at], forest["right"][lanes, at])
            if (down == at).all():
                break
            at = down
        out[start : start + chunk] = 2.0 ** (-forest["path"][lanes, at].mean(axis=1) / norm)
    return out


def score_forests(df: DataFrame, features: Sequence[str], forests: dict[str, DataFrame]) -> DataFrame:
    """Append one score column per named forest; higher is more anomalous, in (0, 1).

    All forests are scored in a single Arrow pass over the rows.
    """
    spark, features = df.sparkSession, list(features)
    state = spark.sparkContext.broadcast({n: _arrays(f.toPandas()) for n, f in forests.items()})
    schema = ", ".join(f"`{n}` double" for n in forests)

    @F.pandas_udf(schema)
    def scores(values: pd.DataFrame) -> pd.DataFrame:
        x = values.to_numpy(float)
        return pd.DataFrame({n: score_matrix(x, f) for n, f in state.value.items()})

    packed = scores(F.struct(*[F.col(f).cast("double") for f in features]))
    return df.withColumn("_scores", packed).select(*df.columns, *(F.col(f"_scores.{n}") for n in forests))


def score_forest(df: DataFrame, features: Sequence[str], forest: DataFrame, out: str = "score") -> DataFrame:
    return score_forests(df, features, {out: forest})

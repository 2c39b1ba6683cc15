"""Evaluate fitted models on messages: per-URL scores, the maximum per message, ranking quality.

A scorer is a function (frame, name) -> frame that appends one score column; higher is more anomalous.
Feature scorers read scaled feature columns, so an ablation sets features to 0, their training mean, and
scores again with the same fitted state.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..models import autoencoder, context, iforest, ngram, reconstruction
from ..operators import aggregates, metrics
from ..operators.joint import max_per_message
from ..session import materialise

Scorer = Callable[[DataFrame, str], DataFrame]


def forest_scorer(forest: DataFrame, features: Sequence[str]) -> Scorer:
    return lambda df, name: iforest.score_forest(df, features, forest, name)


def codec_scorer(codec) -> Scorer:
    return lambda df, name: reconstruction.score_codec(df, codec, name)


def bigram_scorer(bigrams: DataFrame, url: str = "url") -> Scorer:
    """Scores the text itself; frames keep all their columns."""
    def score(df: DataFrame, name: str) -> DataFrame:
        first, *rest = df.columns
        return ngram.score_bigrams(df, first, url, bigrams, rest, name)
    return score


def network_scorer(network) -> Scorer:
    return lambda df, name: autoencoder.score_network(df, network, name)


def context_scorer(tree, url: str = "url") -> Scorer:
    """Scores the text itself; frames keep all their columns."""
    def score(df: DataFrame, name: str) -> DataFrame:
        first, *rest = df.columns
        return context.score_contexts(df, first, url, tree, rest, name)
    return score


def url_scores(urls: DataFrame, scorers: Mapping[str, Scorer], keep: Sequence[str]) -> DataFrame:
    """``keep`` and one column per scorer for every row with a URL; rows without one get nulls."""
    for name, scorer in scorers.items():
        urls = scorer(urls, name)
    real = {n: F.when(F.col("url").isNotNull(), F.col(n)).alias(n) for n in scorers}
    return urls.select(*keep, *real.values())


def message_scores(
    urls: DataFrame, scorers: Mapping[str, Scorer], key: str = "email_id", label: str = "label"
) -> DataFrame:
    """(key, label, one column per scorer): the highest URL score, or the median where there is no URL.

    ``urls`` has one row per URL and, for messages without one, a row with a null URL. Scores are
    stored once, because the medians and the maxima both read them.
    """
    scored = materialise(url_scores(urls, scorers, [key, label, "url"]), "url-scores")
    return max_per_message(scored, key, list(scorers), [label])


def model_report(scores: DataFrame, models: Sequence[str], target: str = "label") -> DataFrame:
    """(model, auc_roc, auc_pr, inverted) for every score column."""
    long = scores.unpivot([target], list(models), "model", "score")
    areas = metrics.areas(long, "score", target, ["model"])
    return areas.select("model", "auc_roc", "auc_pr", (F.col("auc_roc") < 0.5).alias("inverted"))


def ablation_report(
    urls: DataFrame, scorers: Mapping[str, Scorer], feature_sets: Mapping[str, Sequence[str]],
    key: str = "email_id", label: str = "label",
) -> DataFrame:
    """(feature_set, model, auc_roc, auc_pr) with each set's features at their training mean.

    All sets are scored in one pass, as copies of the rows that differ in the neutral features.
    """
    names = F.array(*map(F.lit, feature_sets))
    copies = urls.withColumn("feature_set", F.explode(names))
    touched = sorted({f for dropped in feature_sets.values() for f in dropped})
    neutral = {
        f: F.when(F.col("feature_set").isin(*[n for n, d in feature_sets.items() if f in d]), 0.0).otherwise(F.col(f))
        for f in touched
    }
    scored = url_scores(copies.withColumns(neutral), scorers, [key, label, "url", "feature_set"])
    scored = materialise(scored, "ablation")
    best = materialise(max_per_message(scored, key, list(scorers), [label], by=["feature_set"]), "ablation-best")
    long = best.unpivot(["feature_set", label], list(scorers), "model", "score")
    return metrics.areas(long, "score", label, ["feature_set", "model"])


def held_out_check(rows: DataFrame, scorers: Mapping[str, Scorer], target: str) -> DataFrame:
    """``model_report`` of corpus rows that take the same scoring path as messages do."""
    scored = url_scores(rows, scorers, [target])
    return model_report(materialise(scored, "held-out"), list(scorers), target)


def semantic_report(scores: DataFrame, models: Sequence[str], target: str = "label", threshold: float = 0.5) -> DataFrame:
    """One row per text model: summary of its scores, then F1, AUC, AP and FPR at ``threshold``.

    The scores are stored first, as each part of the report reads them.
    """
    scores = materialise(scores.select(target, *models), "semantic-scores")
    long = scores.unpivot([target], list(models), "model", "score")
    cells = metrics.with_rates(metrics.confusion(long, "score", target, threshold, ["model"]))
    areas = metrics.areas(long, "score", target, ["model"])
    summary = aggregates.score_summary(scores, list(models))
    return summary.join(cells.select("model", "f1", F.col("false_positive_rate").alias("fpr")), "model").join(areas, "model")

"""Messages and their URLs: explosion, per-message scores, completeness, fusion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.urls import extract_urls
from .ranking import quantiles


def message_urls(messages: DataFrame, key: str, body: str, carry: Sequence[str] = (), keep_empty: bool = False) -> DataFrame:
    """One row per URL of a message: (key, carry, url_index, url).

    With ``keep_empty`` a message without URL gives one row with index 0 and a null URL.
    """
    found = messages.select(key, *carry, extract_urls(F.col(body)).alias("_urls"))
    explode = F.posexplode_outer if keep_empty else F.posexplode
    rows = found.select(key, *carry, explode("_urls").alias("url_index", "url"))
    return rows.withColumn("url_index", F.coalesce("url_index", F.lit(0)))


def placeholder_zeros(urls: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mark rows of URL-less messages and set their scaled features to 0, the training mean."""
    empty = F.col("url").isNull()
    return urls.withColumn("is_null_url", empty).withColumns(
        {f: F.when(empty, 0.0).otherwise(F.col(f)) for f in features}
    )


def max_per_message(
    urls: DataFrame, key: str, scores: Sequence[str], carry: Sequence[str] = (), neutral: str = "median", by: Sequence[str] = ()
) -> DataFrame:
    """Highest URL score per message, and per ``by``, from rows that keep URL-less messages (null URL).

    ``neutral`` fills messages without URL: ``median`` takes the median over all URL scores,
    ``zero`` takes 0. One hash aggregation per message key; no join. The median is computed here
    and enters as a constant, so ``urls`` should be stored scores rather than a scoring plan.
    """
    real = {s: F.when(F.col("url").isNotNull(), F.col(s)) for s in scores}
    best = urls.groupBy(key, *carry, *by).agg(*(F.max(real[s]).alias(s) for s in scores))
    return _fill(best, urls.where(F.col("url").isNotNull()), scores, neutral, by)


def attach_max(
    messages: DataFrame, urls: DataFrame, key: str, scores: Sequence[str], neutral: str = "median"
) -> DataFrame:
    """:func:`max_per_message` for two separate tables: a left join on the message key."""
    best = urls.groupBy(key).agg(*(F.max(s).alias(s) for s in scores))
    return _fill(messages.join(best, key, "left"), urls, scores, neutral)


def _fill(frame: DataFrame, urls: DataFrame, scores: Sequence[str], neutral: str, by: Sequence[str] = ()) -> DataFrame:
    if neutral == "zero":
        return frame.fillna(0.0, list(scores))
    if neutral != "median":
        raise ValueError("neutral is 'median' or 'zero'")
    long = urls.select(*by, *(F.col(s).cast("double").alias(s) for s in scores)).unpivot(list(by), list(scores), "_model", "_score")
    medians = quantiles(long, "_score", [0.5], [*by, "_model"])
    if by:
        # One row per value of ``by``, which are settings of one report.
        wide = medians.groupBy(*by).pivot("_model", list(scores)).agg(F.first("value"))
        middle = wide.select(*by, *(F.col(f"`{s}`").alias(f"_{s}") for s in scores))
        return frame.join(F.broadcast(middle), list(by), "left").select(
            *(F.coalesce(c, f"_{c}").alias(c) if c in scores else F.col(c) for c in frame.columns)
        )
    medians = medians.collect()
    return frame.fillna({r["_model"]: r["value"] for r in medians if r["value"] is not None})


def completeness(messages: DataFrame, urls: DataFrame, key: str) -> DataFrame:
    """Row-conservation check: message rows, distinct keys on both sides, missing and stray keys.

    Both tables are first reduced to one row per key, so a key with very many URLs costs one row.
    """
    sides = messages.groupBy(key).agg(F.count(F.lit(1)).alias("m"), F.lit(0).cast("bigint").alias("u"))
    other = urls.groupBy(key).agg(F.lit(0).cast("bigint").alias("m"), F.count(F.lit(1)).alias("u"))
    per_key = sides.unionByName(other).groupBy(key).agg(F.sum("m").alias("m"), F.sum("u").alias("u"))
    return per_key.agg(
        F.sum("m").alias("n_messages"),
        F.count_if(F.col("m") > 0).alias("n_message_keys"),
        F.sum("u").alias("n_url_rows"),
        F.count_if(F.col("u") > 0).alias("n_url_keys"),
        F.count_if((F.col("m") > 0) & (F.col("u") == 0)).alias("n_missing"),
        F.count_if((F.col("m") == 0) & (F.col("u") > 0)).alias("n_stray"),
    )


def url_presence(messages: DataFrame, n_urls: str = "n_urls") -> DataFrame:
    """Share of messages with a URL and mean URLs per message."""
    return messages.agg(
        F.avg((F.col(n_urls) > 0).cast("double")).alias("url_presence_rate"),
        F.avg(F.col(n_urls).cast("double")).alias("avg_urls_per_message"),
    )


def assemble_scores(base: DataFrame, key: str, parts: Sequence[DataFrame]) -> DataFrame:
    """Join score tables on the message key, one row per key on each side.

    All sides hash by the same key, so Spark shuffles each side once and reuses the layout.
    """
    for part in parts:
        base = base.join(part, key, "left")
    return base


def joint_diagnostics(per_message: DataFrame, n_urls: str, label: str, score: str) -> DataFrame:
    """One row of coverage, label and URL-less checks (labels 0 = phishing, 1 = legitimate)."""
    empty = F.col(n_urls) == 0
    neutral = F.when(empty, F.col(score))
    out = per_message.agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.coalesce(F.sum(n_urls), F.lit(0)).cast("bigint").alias("n_urls"),
        F.count(score).alias("n_scored"),
        F.count_if(empty).alias("n_no_url"),
        F.avg(empty.cast("double")).alias("no_url_share"),
        F.count_if(F.col(label) == 0).alias("n_phish"),
        F.count_if(F.col(label) == 1).alias("n_legit"),
        F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("n_unlabelled"),
        # All URL-less messages share one neutral score exactly when min equals max.
        (F.min(neutral) == F.max(neutral)).alias("neutral_constant"),
        F.min(score).alias("score_min"),
        F.max(score).alias("score_max"),
        F.stddev_samp(score).alias("score_std"),
    )
    phish = F.col("n_phish") / (F.col("n_phish") + F.col("n_legit"))
    share = F.when(F.col("n_phish") + F.col("n_legit") > 0, phish)
    return out.withColumn("phish_fraction", share).withColumn(
        "phish_plausible", (F.col("phish_fraction") > 0.2) & (F.col("phish_fraction") < 0.8)
    )


def fuse_scores(
    scores: DataFrame, key: str, semantic: Sequence[str], anomaly: Sequence[str],
    weight: float = 0.5, suspicious_from: float = 0.4, phishing_from: float = 0.6,
) -> DataFrame:
    """Every semantic x anomaly pair of score columns as a weighted mean with a three-way verdict."""
    cells = F.array(
        *(
            F.struct(
                F.lit(s).alias("semantic"), F.lit(a).alias("anomaly"),
                (F.col(s) * weight + F.col(a) * (1 - weight)).alias("fused"),
            )
            for s in semantic
            for a in anomaly
        )
    )
    rows = scores.select(key, F.explode(cells).alias("c")).select(key, "c.*")
    verdict = (
        F.when(F.col("fused") >= phishing_from, "phishing")
        .when(F.col("fused") >= suspicious_from, "suspicious")
        .otherwise("legitimate")
    )
    return rows.withColumn("verdict", verdict)

"""Joint corpus: redacted text and URL features of the same messages, linked by message id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.text import clean_text, redact_text
from ..functions.url_basic import FEATURES as BASIC_FEATURES, with_basic_features
from ..functions.url_enriched import feature_names, with_enriched_features
from ..functions.urls import extract_urls
from ..operators.joint import message_urls, placeholder_zeros
from ..operators.scaling import apply_scaler


def text_table(messages: DataFrame, key: str = "email_id", body: str = "body", label: str = "label") -> DataFrame:
    """(key, text, label, n_urls); URLs are counted in the raw body, before redaction."""
    return messages.select(
        key,
        redact_text(clean_text(F.col(body))).alias("text"),
        label,
        F.size(extract_urls(F.col(body))).cast("bigint").alias("n_urls"),
    )


def url_table(messages: DataFrame, scaler: DataFrame, key: str = "email_id", body: str = "body") -> DataFrame:
    """(key, url_index, is_null_url, scaled basic features); every message has at least one row.

    Features are scaled with the given state, never refitted. A message without URL gets one row
    of zeros, the training mean in scaled space.
    """
    rows = message_urls(messages, key, body, keep_empty=True)
    scaled = apply_scaler(with_basic_features(rows, "url"), scaler, BASIC_FEATURES)
    marked = placeholder_zeros(scaled, BASIC_FEATURES)
    return marked.select(key, "url_index", "is_null_url", *BASIC_FEATURES)


def readiness_joint(messages: DataFrame, key: str = "email_id", body: str = "body", label: str = "label") -> DataFrame:
    """One row: messages, URLs, URL-less messages, classes, presence rate, mean URLs."""
    rows = messages.select(label, F.size(extract_urls(F.col(body))).alias("n_urls"))
    return rows.agg(
        F.count(F.lit(1)).alias("loaded_messages"),
        F.coalesce(F.sum("n_urls"), F.lit(0)).alias("total_urls"),
        F.count_if(F.col("n_urls") == 0).alias("null_url_messages"),
        F.count_if(F.col(label) == 0).alias("label_0"),
        F.count_if(F.col(label) == 1).alias("label_1"),
        F.count_if(F.col(label).isNull()).alias("unlabelled"),
        F.round(F.avg((F.col("n_urls") > 0).cast("double")), 4).alias("url_presence_rate"),
        F.round(F.avg("n_urls"), 2).alias("avg_urls_per_message"),
    )


def scaled_message_urls(
    messages: DataFrame, scaler: DataFrame, carry: Sequence[str] = (), exclude: Sequence[str] = (),
    key: str = "email_id", body: str = "body",
) -> DataFrame:
    """Scaled enriched features of every URL; URL-less messages keep one row with a null URL."""
    rows = message_urls(messages, key, body, carry, keep_empty=True)
    return apply_scaler(with_enriched_features(rows, "url", exclude), scaler, feature_names(exclude))

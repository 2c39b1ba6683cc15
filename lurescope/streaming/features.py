"""Scoring columns on a stream. The text, URL and scaling operators are stateless maps, so they
run unchanged on a streaming frame; no windowed or stateful operator is involved."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import clean_text, redact_text
from ..functions.url_enriched import with_enriched_features
from ..operators.joint import message_urls


def redact_stream(messages: DataFrame, body: str = "body") -> DataFrame:
    """Replace the body of each arriving message by its cleaned and redacted text."""
    return messages.withColumn(body, redact_text(clean_text(F.col(body))))


def url_feature_stream(messages: DataFrame, key: str = "email_id", body: str = "body") -> DataFrame:
    """Enriched features of every URL in each arriving message."""
    return with_enriched_features(message_urls(messages, key, body), "url")

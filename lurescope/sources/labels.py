"""Per-source label rules.

URL sources use 0 = phishing, 1 = legitimate. Message sources use the opposite. Every rule
below is explicit about its convention; a value no rule covers becomes null or the given default.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.charclass import SPACE

# Label texts of the supported sources.
URL_TYPES = {"phishing": 0, "legitimate": 1}
MESSAGE_TYPES = {"Safe Email": 0, "Phishing Email": 1}
UNLABELLED = -1


def strip(text: Column) -> Column:
    """Drop Unicode whitespace at both ends."""
    return F.regexp_replace(text, f"(?U)^[{SPACE}]+|[{SPACE}]+$", "")


def lookup(value: Column, mapping: Mapping[str, int], default: int | None = None) -> Column:
    """Exact lookup in a small literal mapping."""
    result = F.lit(default).cast("int")
    for key, code in mapping.items():
        result = F.when(value == key, code).otherwise(result)
    return result.cast("int")


def urls_int_label(df: DataFrame, url: str = "URL", label: str = "label", source: str = "a") -> DataFrame:
    """Source with a 0/1 integer label; rows without a readable label are dropped."""
    code = F.col(label).try_cast("int")
    return df.select(
        F.col(url).alias("url"), code.alias("label"), F.lit(source).alias("source")
    ).where(F.col("label").isNotNull())


def urls_text_label(df: DataFrame, url: str = "url", label: str = "type", source: str = "b") -> DataFrame:
    """Source with a text label in any case and padding; other labels are dropped."""
    code = lookup(F.lower(strip(F.col(label))), URL_TYPES)
    return df.select(
        F.col(url).alias("url"), code.alias("label"), F.lit(source).alias("source")
    ).where(F.col("label").isNotNull())


def urls_nullable_label(df: DataFrame, url: str = "URL", label: str = "ClassLabel", source: str = "c") -> DataFrame:
    """Source with a numeric label that may be missing; fractions are truncated."""
    code = F.col(label).try_cast("double").try_cast("int")
    return df.select(
        F.col(url).alias("url"), code.alias("label"), F.lit(source).alias("source")
    ).where(F.col("label").isNotNull())


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of (url, label, source) frames; position in the list is the source priority."""
    tagged = [f.withColumn("priority", F.lit(i)) for i, f in enumerate(frames)]
    combined = tagged[0]
    for frame in tagged[1:]:
        combined = combined.unionByName(frame)
    return combined.withColumn("url", strip(F.coalesce("url", F.lit(""))))


def messages(df: DataFrame, text: str = "Email Text", label: str = "Email Type", *, row_id: str) -> DataFrame:
    """Message source 1 as (row_id, text, label_raw); a stray index column is ignored.

    ``row_id`` names the column that orders rows: which of equal texts is first must not depend on
    how files are split.
    """
    return df.select(
        F.col(f"`{row_id}`").cast("bigint").alias("row_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").alias("label_raw")
    )


def flip_label(label: Column) -> Column:
    """1 = phishing to 0 = phishing; unlabelled becomes -1."""
    return F.coalesce(F.lit(1) - label.cast("int"), F.lit(UNLABELLED))


def mapped_label(label: Column, mapping: Mapping[str, int]) -> Column:
    """Trimmed label looked up in ``mapping``; anything else becomes -1."""
    return lookup(strip(label.cast("string")), mapping, UNLABELLED)


def collapse_label(category: Column, attack: Sequence[str], safe: Sequence[str]) -> Column:
    """Fine category to 1 (attack) or 0 (safe); null for an unknown category."""
    return F.when(category.isin(*attack), 1).when(category.isin(*safe), 0)


def is_phishing(label: Column) -> Column:
    """Detection target for the 0 = phishing convention; null for an unlabelled row."""
    return F.when(label == 0, 1).when(label == 1, 0)

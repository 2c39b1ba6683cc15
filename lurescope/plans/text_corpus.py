"""Message corpus: clean, deduplicate, redact, encode labels, and report on every stage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from ..functions.text import MIN_CHARS, TOKENS, clean_text, with_redaction, within_length
from ..operators.metrics import ratio
from ..operators.aggregates import IMBALANCE
from ..sources.labels import MESSAGE_TYPES, lookup

COUNTS = tuple(f"n_{t[1:-1].lower()}" for t in TOKENS)


def _cleaned(messages: DataFrame, labels: Mapping[str, int]) -> DataFrame:
    return messages.where(F.col("text").isNotNull()).select(
        "row_id", "text", lookup(F.col("label_raw"), labels).alias("label")
    )


def clean_corpus(
    messages: DataFrame, labels: Mapping[str, int] = MESSAGE_TYPES, counts: bool = False,
    min_chars: int = MIN_CHARS, max_chars: int | None = None,
) -> DataFrame:
    """(row_id, text, label) from (row_id, text, label_raw), optionally with redaction counts.

    Equal raw texts have equal cleaned texts and the same length verdict, so deduplicating once
    on the cleaned text keeps the same first rows as deduplicating before and after cleaning:
    one shuffle instead of two. A duplicate takes the label of its first row, valid or not;
    rows without a usable label leave last. Texts that only become equal by redaction stay. Bounds are
    in code points and inclusive; without ``max_chars`` no text is too long.
    """
    rows = _cleaned(messages, labels).where(within_length(F.col("text"), min_chars, max_chars))
    first = (
        rows.select("row_id", clean_text(F.col("text")).alias("text"), "label")
        .groupBy("text")
        .agg(
            F.min("row_id").alias("row_id"),
            F.min_by("label", "row_id").alias("label"),
            # Length as an aggregate, so the filter below cannot repeat the cleaning at the scan.
            F.max(F.length("text")).alias("_n"),
        )
        .where((F.col("_n") >= min_chars) & F.col("label").isNotNull())
    )
    out = with_redaction(first, "text", counts=counts)
    return out.select("row_id", "text", "label", *(COUNTS if counts else ()))


def _digest(text) -> list:
    """A 128-bit digest and the length, which stand for a text where texts are only counted."""
    return [F.md5(text), F.length(text)]


def readiness_text(
    messages: DataFrame, labels: Mapping[str, int] = MESSAGE_TYPES, min_chars: int = MIN_CHARS, max_chars: int | None = None
) -> DataFrame:
    """One row with the rows removed per stage, redaction counts, class balance, final rows.

    Every message is cleaned and its redactions counted where it is read; from there on digests and
    counts travel, never texts. Two nested groupings (raw text, then cleaned text) carry the stage
    counts along. Redactions are counted on every deduplicated text, labelled or not.
    """
    text = F.col("text")
    stage = F.when(text.isNull(), "null").when(~within_length(text, min_chars, max_chars), "length").otherwise("kept")
    staged = messages.select(
        "row_id", lookup(F.col("label_raw"), labels).alias("label"), stage.alias("stage"),
        *(d.alias(f"_raw{i}") for i, d in enumerate(_digest(text))),
        F.when(stage == "kept", clean_text(text)).alias("text"),
    )
    counted = with_redaction(staged, "text", out="_redacted").drop("_redacted")
    slim = counted.select(
        "row_id", "label", "stage", "_raw0", "_raw1",
        *(d.alias(f"_clean{i}") for i, d in enumerate(_digest(F.col("text")))), *COUNTS,
    )
    raw = slim.groupBy("stage", "_raw0", "_raw1", "_clean0", "_clean1").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("row_id").alias("row_id"),
        F.min_by("label", "row_id").alias("label"),
        *(F.max(c).alias(c) for c in COUNTS),
    )
    grouped = raw.groupBy("stage", "_clean0", "_clean1").agg(
        F.sum("rows").alias("rows"),
        F.count(F.lit(1)).alias("distinct_raw"),
        F.min_by("label", "row_id").alias("label"),
        *(F.max(c).alias(c) for c in COUNTS),
    )
    grouped = grouped.withColumn("final", (F.col("stage") == "kept") & (F.col("_clean1") >= min_chars))
    final, label = F.col("final"), F.col("label")

    def total(condition, value):
        return F.coalesce(F.sum(F.when(condition, value)), F.lit(0)).cast("bigint")

    is_null = F.col("stage") == "null"
    report = grouped.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("loaded_rows"),
        total(is_null, F.col("rows")).alias("removed_null_bodies"),
        total(~is_null, F.col("rows") - F.col("distinct_raw")).alias("removed_exact_duplicates"),
        total(F.col("stage") == "length", F.col("distinct_raw")).alias("removed_length_outliers"),
        total(
            F.col("stage") == "kept", F.col("distinct_raw") - F.when(final, 1).otherwise(0)
        ).alias("removed_post_clean_empty_or_dup"),
        *(total(final, F.col(c)).alias(f"redacted_{c[2:]}") for c in COUNTS),
        F.count_if(final & label.isNull()).alias("removed_unlabelled"),
        F.count_if(final & (label == 0)).alias("safe_0"),
        F.count_if(final & (label == 1)).alias("phishing_1"),
    )
    size = F.col("safe_0") + F.col("phishing_1")
    share = ratio(F.greatest("safe_0", "phishing_1").cast("double"), size)
    return report.withColumns({"majority_fraction": share, "final_rows": size}).withColumn(
        "resampling_advised", F.col("majority_fraction") > IMBALANCE
    )


def cross_source_dedup(corpora: Mapping[str, DataFrame]) -> DataFrame:
    """Union of (row_id, text) corpora in priority order, one row per text with its first source."""
    from ..operators.dedup import order_key

    names = list(corpora)
    frames = [
        corpora[name].select(
            "text", order_key(F.lit(i), F.col("row_id")).alias("_order"), F.lit(i).alias("_source"), "row_id"
        )
        for i, name in enumerate(names)
    ]
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame)
    kept = union.groupBy("text").agg(
        F.min_by("_source", "_order").alias("_source"),
        F.min_by("row_id", "_order").alias("row_id"),
        F.count(F.lit(1)).alias("n_copies"),
        (F.min("_source") != F.max("_source")).alias("cross_source"),
    )
    source = F.get(F.array(*map(F.lit, names)), F.col("_source"))
    return kept.select("row_id", source.alias("source"), "text", "n_copies", "cross_source")


def source_exclusion(corpus: DataFrame, excluded: str, source: str = "source") -> DataFrame:
    """Rows before, after and removed when one source is dropped."""
    hit = F.coalesce(F.col(source) == excluded, F.lit(False))
    return corpus.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count_if(~hit).alias("rows_after"),
        F.count_if(hit).alias("rows_removed"),
    )

"""The 18 basic URL features (a second, not interchangeable feature space)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .charclass import ALNUM, DIGIT, LETTER, SPACE
from .url_enriched import count_of
from .urls import split_url, stages

# Feature names in their stable column order.
FEATURES = (
    "URLLength", "DomainLength", "IsDomainIP", "TLDLength", "NoOfSubDomain", "HasObfuscation",
    "NoOfObfuscatedChar", "ObfuscationRatio", "NoOfLettersInURL", "LetterRatioInURL",
    "NoOfDegitsInURL", "DegitRatioInURL", "NoOfEqualsInURL", "NoOfQMarkInURL",
    "NoOfAmpersandInURL", "NoOfOtherSpecialCharsInURL", "SpacialCharRatioInURL", "IsHTTPS",
)
_LEAD = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://"


def with_basic_features(df: DataFrame, url: str) -> DataFrame:
    """Append the basic features of column ``url`` as doubles, in their stable order."""
    raw, trim, ok = F.col("_b_url"), F.col("_b_trim"), F.col("_b_ok")
    body = F.col("_b_body")
    staged = stages(
        df,
        {"_b_url": F.coalesce(F.col(url), F.lit(""))},
        {
            "_b_trim": F.regexp_replace(raw, f"(?U)^[{SPACE}]+|[{SPACE}]+$", ""),
            "_b_cut": F.substring(raw, F.lit(1), F.length(raw) - 1),
        },
        {"_b_abs": F.when(trim.rlike(_LEAD), trim).otherwise(F.concat(F.lit("http://"), trim))},
    )
    staged = split_url(staged, F.col("_b_abs"), "_b_")
    # A malformed authority falls back to the text between scheme and the first / ? or #.
    netloc = F.when(ok, F.col("_b_netloc")).otherwise(
        F.regexp_extract("_b_abs", _LEAD + "([^/?#]*)", 1)
    )
    scheme = F.when(ok, F.col("_b_scheme")).otherwise(
        F.lower(F.substring_index("_b_abs", "://", 1))
    )
    staged = stages(
        staged,
        {
            "_b_host": F.substring_index(F.substring_index(netloc, "@", -1), ":", 1),
            "_b_https": (scheme == "https").cast("int"),
            "_b_len": F.length("_b_cut"),
            "_b_body": F.regexp_replace(F.regexp_replace("_b_cut", _LEAD, ""), r"(?i)^www\.", ""),
        },
        {
            "_b_letters": F.regexp_count(body, F.lit(f"[{LETTER}]")),
            "_b_digits": F.regexp_count(body, F.lit(f"[{DIGIT}]")),
            "_b_special": F.regexp_count(body, F.lit(f"[^{ALNUM}]")),
            "_b_obf": F.regexp_count(body, F.lit("%[0-9a-fA-F]{2}"))
            + F.regexp_count(body, F.lit(r"[^\x00-\x7F]")),
            "_b_eq": count_of(body, "="),
            "_b_qm": count_of(body, "?"),
            "_b_amp": count_of(body, "&"),
        },
    )
    host, size = F.col("_b_host"), F.col("_b_len")

    def share(name: str):
        return F.when(size > 0, F.col(name) / size).otherwise(0.0)

    values = {
        "URLLength": size,
        "DomainLength": F.length(host),
        "IsDomainIP": host.rlike(r"(?U)^\d{1,3}(\.\d{1,3}){3}$").cast("int"),
        "TLDLength": F.length(F.substring_index(host, ".", -1)),
        "NoOfSubDomain": F.greatest(count_of(host, ".") - 1, F.lit(0)),
        "HasObfuscation": (F.col("_b_obf") > 0).cast("int"),
        "NoOfObfuscatedChar": F.col("_b_obf"),
        "ObfuscationRatio": share("_b_obf"),
        "NoOfLettersInURL": F.col("_b_letters"),
        "LetterRatioInURL": share("_b_letters"),
        "NoOfDegitsInURL": F.col("_b_digits"),
        "DegitRatioInURL": share("_b_digits"),
        "NoOfEqualsInURL": F.col("_b_eq"),
        "NoOfQMarkInURL": F.col("_b_qm"),
        "NoOfAmpersandInURL": F.col("_b_amp"),
        "NoOfOtherSpecialCharsInURL": F.col("_b_special")
        - F.col("_b_eq") - F.col("_b_qm") - F.col("_b_amp"),
        "SpacialCharRatioInURL": share("_b_special"),
        "IsHTTPS": F.col("_b_https"),
    }
    keep = [F.col(c) for c in df.columns]
    return staged.select(*keep, *(values[n].cast("double").alias(n) for n in FEATURES))

"""The 24 enriched lexical and structural URL features as JVM column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .charclass import CONSONANT_RUN, DIGIT, LETTER
from .urls import split_url, stages

# Default word lists of the enriched feature set.
KEYWORDS = (
    "login", "verify", "secure", "account", "update", "bank", "confirm",
    "signin", "password", "submit", "click",
)
BRANDS = (
    "paypal", "apple", "microsoft", "amazon", "google", "facebook", "netflix",
    "ebay", "instagram", "whatsapp", "linkedin", "dropbox", "chase",
)
SHORTENERS = (
    "bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly",
    "adf.ly", "bit.do", "cutt.ly", "shorturl.at", "rebrand.ly",
)
# Feature names in their stable column order.
FEATURES = (
    "url_entropy", "domain_entropy", "vowel_ratio", "consonant_run_max", "digit_run_max",
    "char_class_transitions", "char_class_transition_ratio", "suspicious_keyword_count",
    "has_suspicious_keyword", "brand_in_path_not_domain", "hyphen_count_domain",
    "digit_ratio_domain", "subdomain_depth", "path_depth", "is_ip_host", "has_port",
    "has_at_symbol", "percent_encoding_count", "percent_encoding_ratio", "is_shortener",
    "has_punycode", "domain_to_url_len_ratio", "num_dots", "has_https",
)


@dataclass(frozen=True)
class Lexicon:
    """Word lists a deployment may replace."""

    keywords: Sequence[str] = KEYWORDS
    brands: Sequence[str] = BRANDS
    shorteners: Sequence[str] = SHORTENERS


def feature_names(exclude: Sequence[str] = ()) -> list[str]:
    """Feature names in order without the excluded ones."""
    unknown = set(exclude) - set(FEATURES)
    if unknown:
        raise ValueError(f"unknown features: {sorted(unknown)}")
    return [name for name in FEATURES if name not in exclude]


def shannon_entropy(text: Column) -> Column:
    """Bits per code point; 0 for the empty string.

    Uses ``log2 n - sum(k log2 k) / n`` over the distinct code points, so the work per string is
    its length times its alphabet: fine for URLs, not meant for message bodies.
    """
    size = F.length(text)

    def weigh(total: Column, char: Column) -> Column:
        count = size - F.length(F.replace(text, char, F.lit("")))
        return total + count * F.log2(count.cast("double"))

    spread = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), weigh)
    return F.when(size > 0, F.greatest(F.log2(size.cast("double")) - spread / size, F.lit(0.0))).otherwise(0.0)


def longest_match(text: Column, pattern: str) -> Column:
    runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def count_of(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    gap = F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))
    return gap if len(literal) == 1 else gap / F.lit(len(literal))


def _any(conditions: list[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def with_enriched_features(
    df: DataFrame, url: str, exclude: Sequence[str] = (), lexicon: Lexicon = Lexicon()
) -> DataFrame:
    """Append the enriched features of column ``url`` as doubles, in their stable order."""
    raw, ok, dom = F.col("_f_url"), F.col("_f_ok"), F.col("_f_dom")
    absolute = F.when(raw.contains("://"), raw).otherwise(F.concat(F.lit("http://"), raw))
    staged = split_url(df.withColumn("_f_url", F.coalesce(F.col(url), F.lit(""))), absolute, "_f_")
    turns = F.regexp_count(dom, F.lit(f"[{LETTER}]+|[{DIGIT}]+|[^{LETTER}{DIGIT}]+")) - 1
    staged = stages(
        staged,
        {
            "_f_host": F.when(ok, F.lower("_f_netloc")).otherwise(""),
            "_f_lpath": F.when(ok, F.lower("_f_path")).otherwise(""),
            "_f_low": F.lower(raw),
            "_f_n": F.length(raw),
            "_f_pct": count_of(raw, "%"),
        },
        {
            "_f_bare": F.substring_index("_f_host", ":", 1),
            "_f_hits": sum((count_of(F.col("_f_low"), k) for k in lexicon.keywords), F.lit(0)),
        },
        {"_f_dom": F.regexp_replace("_f_bare", r"^www\.", "")},
        {"_f_dn": F.length(dom), "_f_turns": F.greatest(turns, F.lit(0))},
    )
    host, bare = F.col("_f_host"), F.col("_f_bare")
    path, turns, hits = F.col("_f_lpath"), F.col("_f_turns"), F.col("_f_hits")
    size = F.greatest(F.col("_f_n"), F.lit(1))
    dom_size = F.greatest(F.col("_f_dn"), F.lit(1))
    values = {
        "url_entropy": shannon_entropy(raw),
        "domain_entropy": shannon_entropy(dom),
        "vowel_ratio": F.regexp_count(raw, F.lit("[aeiouAEIOU]"))
        / F.greatest(F.regexp_count(raw, F.lit(f"[{LETTER}]")), F.lit(1)),
        "consonant_run_max": longest_match(dom, CONSONANT_RUN),
        "digit_run_max": longest_match(raw, f"[{DIGIT}]+"),
        "char_class_transitions": turns,
        "char_class_transition_ratio": turns / dom_size,
        "suspicious_keyword_count": hits,
        "has_suspicious_keyword": (hits > 0).cast("int"),
        "brand_in_path_not_domain": _any(
            [path.contains(b) & ~dom.contains(b) for b in lexicon.brands]
        ).cast("int"),
        "hyphen_count_domain": count_of(dom, "-"),
        "digit_ratio_domain": F.regexp_count(dom, F.lit(f"[{DIGIT}]")) / dom_size,
        "subdomain_depth": F.greatest(count_of(dom, ".") - 1, F.lit(0)),
        "path_depth": count_of(path, "/"),
        "is_ip_host": bare.rlike(r"(?U)^\d{1,3}(\.\d{1,3}){3}$").cast("int"),
        "has_port": (host.contains(":") & ~host.startswith("http")).cast("int"),
        "has_at_symbol": raw.contains("@").cast("int"),
        "percent_encoding_count": F.col("_f_pct"),
        "percent_encoding_ratio": F.col("_f_pct") / size,
        "is_shortener": dom.isin(*lexicon.shorteners).cast("int"),
        "has_punycode": bare.contains("xn--").cast("int"),
        "domain_to_url_len_ratio": F.col("_f_dn") / size,
        "num_dots": count_of(raw, "."),
        "has_https": (ok & (F.col("_f_scheme") == "https")).cast("int"),
    }
    keep = [F.col(c) for c in df.columns]
    return staged.select(
        *keep, *(values[name].cast("double").alias(name) for name in feature_names(exclude))
    )

"""URL extraction and URL splitting as staged projections.

Two splitting rules exist because the two feature sets define "host" differently. Each stage
adds helper columns that the next stage reads, so a shared piece is computed once per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .charclass import SPACE

# Fixed value: what counts as a URL inside a message body.
BODY_URL = rf"""(?U)https?://[^{SPACE}<>"']+|www\.[^{SPACE}<>"']+"""

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_HEX = "[0-9a-fA-F]{1,4}"
_IPV6 = (
    rf"^(?:(?:{_HEX}:){{7}}{_HEX}"
    rf"|(?!(?:[^:]*:){{8,}}[^:]+:)(?!(?:.*{_HEX}(?::|$)){{9,}})"
    rf"(?:(?:{_HEX}:){{1,7}}|:)(?:(?::{_HEX}){{1,7}}|:))$"
)
# Schemes whose last path segment may carry ";parameters".
_WITH_PARAMS = (
    "", "ftp", "hdl", "prospero", "http", "imap", "https", "shttp", "rtsp", "rtsps", "rtspu", "sip",
    "sips", "mms", "sftp", "tel",
)
_DOTTED_TAIL = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"


def extract_urls(body: Column) -> Column:
    """All URLs of a body in order of appearance, as an array (empty for a null body)."""
    return F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(BODY_URL), F.lit(0))


def _is_ipv6(text: Column) -> Column:
    bare = F.regexp_replace(text, "%[^%]+$", "")
    plain = F.regexp_replace(bare, _DOTTED_TAIL, "0:0")
    groups = F.regexp_count(plain, F.lit(_HEX))
    return plain.rlike(_IPV6) & F.when(plain.contains("::"), groups <= 7).otherwise(groups == 8)


def _brackets_ok(netloc: Column) -> Column:
    """Square brackets are either absent or the first pair holds an IP literal."""
    inner = F.regexp_extract(netloc, r"\[([^\]]*)", 1)
    literal = F.when(
        inner.startswith("v"), inner.rlike(r"^v[a-fA-F0-9]+\..+$")
    ).otherwise(_is_ipv6(inner))
    opened, closed = netloc.contains("["), netloc.contains("]")
    return F.when(~opened & ~closed, True).when(opened & closed, literal).otherwise(False)


def split_url(df: DataFrame, text: Column, prefix: str) -> DataFrame:
    """Add ``<prefix>scheme``, ``netloc``, ``path`` and ``ok`` for an absolute-ised URL string.

    Leading control characters and blanks are stripped and tabs and line breaks dropped before
    splitting; the path keeps everything up to the query but the parameters of its last segment.
    """
    p = prefix
    tidy = F.regexp_replace(F.regexp_replace(text, r"^[\x00-\x20]+", ""), r"[\t\r\n]", "")
    scheme, full, netloc = F.col(f"{p}scheme"), F.col(f"{p}full"), F.col(f"{p}netloc")
    return stages(
        df,
        {f"{p}tidy": tidy},
        {
            f"{p}scheme": F.lower(F.regexp_extract(f"{p}tidy", _SCHEME, 1)),
            f"{p}rest": F.regexp_replace(f"{p}tidy", _SCHEME, ""),
        },
        {
            f"{p}netloc": F.regexp_extract(f"{p}rest", r"^//([^/?#]*)", 1),
            f"{p}full": F.regexp_extract(f"{p}rest", r"^(?://[^/?#]*)?([^?#]*)", 1),
        },
        {
            f"{p}ok": _brackets_ok(netloc),
            f"{p}path": F.when(
                scheme.isin(*_WITH_PARAMS) & full.contains(";"), F.regexp_replace(full, r";[^/]*$", "")
            ).otherwise(full),
        },
    )


def stages(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    """Add columns step by step; a step may read what earlier ones added."""
    for step in steps:
        df = df.withColumns(step)
    return df

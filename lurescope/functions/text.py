"""Text column functions: cleaning, redaction, casing and length."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Tuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .batches import bounds
from .charclass import SPACE

# Redaction tokens and patterns, in the order they are applied.
REDACTIONS: tuple[tuple[str, str], ...] = (
    ("<SSN>", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("<CARD>", r"\b(?:\d[ -]*?){13,16}\b"),
    ("<PHONE>", r"(?:\+?\d{1,3}[\s.-]?)?(?:\(?\d{3}\)?[\s.-]?)\d{3}[\s.-]?\d{4}"),
    ("<EMAIL>", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("<URL>", r"https?://\S+|www\.\S+"),
)
# A text without a match of its probe cannot match the pattern. The probes are plain substring
# searches or patterns without word boundaries, and spare most texts the costly search.
_PROBES = {
    "<SSN>": lambda t: t.rlike(r"\p{Nd}{3}-\p{Nd}{2}-\p{Nd}{4}"),
    "<CARD>": lambda t: t.rlike(r"(?:\p{Nd}[ -]*){13}"),
    "<PHONE>": lambda t: t.rlike(rf"(?U)\d{{3}}[{SPACE}.-]?\d{{4}}"),
    "<EMAIL>": lambda t: t.contains("@"),
    "<URL>": lambda t: t.contains("http") | t.contains("www."),
}
# Length bounds in code points, both inclusive. The upper one is only used where asked for.
MIN_CHARS, MAX_CHARS = 10, 50_000

TOKENS = tuple(token for token, _ in REDACTIONS)


def _unicode(pattern: str) -> str:
    spaced = pattern.replace(r"\S", f"[^{SPACE}]").replace(r"[\s.-]", f"[{SPACE}.-]")
    return "(?U)" + spaced


def clean_text(text: Column) -> Column:
    r"""Literal ``\n`` ``\t`` ``\r`` and any whitespace run become one space; null becomes ''."""
    unescaped = F.regexp_replace(F.coalesce(text, F.lit("")), r"\\[ntr]", " ")
    return F.trim(F.regexp_replace(unescaped, f"(?U)[{SPACE}]+", " "))


def _step(text: Column, token: str, pattern: str) -> Column:
    """One redaction. The one-element transform binds the text, so that probe, replacement and
    fallback share one evaluation of the steps before."""

    def replace(bound: Column) -> Column:
        changed = F.regexp_replace(bound, _unicode(pattern), token)
        return F.when(_PROBES[token](bound), changed).otherwise(bound)

    return F.transform(F.array(text), replace)[0]


def redact_identifiers(text: Column) -> Column:
    """All redactions but the URL one (the last), each on the output of the one before."""
    for token, pattern in REDACTIONS[:-1]:
        text = _step(text, token, pattern)
    return text


def redact_urls(text: Column) -> Column:
    return _step(text, *REDACTIONS[-1])


def redact_text(text: Column) -> Column:
    """Replace SSN-, card-, phone-, e-mail- and URL-shaped substrings by their tokens."""
    return redact_urls(redact_identifiers(text))


def _occurrences(text: Column, literal: str) -> Column:
    removed = F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))
    return (removed / F.lit(len(literal))).cast("bigint")


def _matches(text: Column, pattern: str) -> Column:
    """Number of matches, from two lengths; no array of matches is built."""
    return F.length(F.regexp_replace(text, pattern, "x")) - F.length(F.regexp_replace(text, pattern, ""))


def with_redaction(df: DataFrame, text: str, out: str = "text", counts: bool = True) -> DataFrame:
    """Add redacted ``out`` and, with ``counts``, one ``n_<token>`` column per redaction.

    Each pattern runs once per row. No pattern but the URL one can consume a token, so the first
    four counts are the tokens gained between input and the pre-URL text.
    """
    staged = df.withColumn("_ids", redact_identifiers(F.col(text)))
    if counts:
        columns = {
            f"n_{token[1:-1].lower()}": _occurrences(F.col("_ids"), token)
            - _occurrences(F.col(text), token)
            for token in TOKENS[:-1]
        }
        columns["n_url"] = _matches(F.col("_ids"), _unicode(REDACTIONS[-1][1])).cast("bigint")
        staged = staged.withColumns(columns)
    return staged.withColumn(out, redact_urls(F.col("_ids"))).drop("_ids")


def within_length(text: Column, low: int = MIN_CHARS, high: int | None = None) -> Column:
    """Length in code points between both bounds; no upper bound unless given."""
    long_enough = F.length(text) >= low
    return long_enough if high is None else long_enough & (F.length(text) <= high)


def has_capital(text: Column) -> Column:
    return text.rlike("[A-Z]")


def uppercase_share(text: Column) -> Column:
    """Uppercase letters over letters; 0 for text without letters."""
    letters = F.length(text) - F.length(F.regexp_replace(text, r"\p{L}+", ""))
    capitals = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))
    return F.when(letters > 0, capitals / letters).otherwise(0.0)


def token_count(text: Column) -> Column:
    """Number of whitespace-separated tokens."""
    return F.length(F.regexp_replace(F.regexp_replace(text, f"(?U)[^{SPACE}]+", "x"), f"(?U)[{SPACE}]+", ""))


def redact_columns(df: DataFrame, columns: Sequence[str], redactor=None) -> DataFrame:
    """Redact chosen string columns of a table and leave every other column as it is.

    ``redactor`` maps a pandas Series of text to a Series of the same length and runs on slices of
    Arrow batches of the chosen columns (the place for a named-entity pass). One with a method
    ``redact_column(df, column)`` redacts the frame itself. Without one the built-in patterns are
    used and the plan stays inside the JVM.
    """
    columns = list(columns)
    if redactor is None:
        return df.withColumns({c: redact_text(F.col(c)) for c in columns})
    if hasattr(redactor, "redact_column"):
        for c in columns:
            df = redactor.redact_column(df, c)
        return df

    if not columns:
        return df
    kind = pa.struct([(str(i), pa.string()) for i in range(len(columns))])

    def redacted(texts: pa.Array) -> pa.Array:
        return pa.Array.from_pandas(redactor(texts.to_pandas()), type=pa.string())

    @F.arrow_udf(", ".join(f"`{i}` string" for i in range(len(columns))))
    def run(batches: Iterator[Tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            # A single column comes without a tuple.
            own = [batch] if isinstance(batch, pa.Array) else list(batch)
            for at, many in bounds(own):
                yield pa.StructArray.from_arrays([redacted(c.slice(at, many)) for c in own], fields=list(kind))

    name = "_redacted"
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    wide = df.withColumn(name, run(*(F.col(c) for c in columns)))
    return wide.withColumns({c: F.col(name)[str(i)] for i, c in enumerate(columns)}).drop(name)

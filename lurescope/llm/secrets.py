"""Secret scan: three fixed patterns and a token-efficiency test for random strings.

Ordinary words and names take few tokens for their length under a byte-pair vocabulary, random
strings take many. Runs of secret-like characters with few characters per token are reported as kind
``random``, unless they are digests (pure hexadecimal of a usual digest length), UUIDs, or
identifiers (words joined by separators, perhaps with a number). A run of letters is a word only if it
has as many characters per token as words have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lurescope.llm import arrow_text, byte_bpe

#: The base patterns. Group 2 of the first needs 6 characters, the others a total length.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)

MIN_LENGTH = 20
MAX_CHARS_PER_TOKEN = 1.9
#: Runs of fewer letters are too short for a judgement, alone or with others.
LEAST_JUDGED = 3
LEAST_ALONE = 8

_ANY_BASE = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+|[^A-Za-z0-9]+")

SPAN = "array<struct<kind:string,start:int,end:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def is_identifier(run: str) -> bool:
    """Words, perhaps numbered: at most one change between letters and digits per separator-free part."""
    for part in re.split(r"[^A-Za-z0-9]+", run):
        pieces = _PARTS.findall(part)
        words = [p for p in pieces if p[0].isalpha()]
        numbers = [p for p in pieces if p[0].isdigit()]
        if len(numbers) > 1 or numbers and words and min(map(len, words)) < 3 or any(len(n) > 12 for n in numbers):
            return False
        if len(words) > 1 and sum(map(len, words)) < 4 * len(words):
            return False
    return True


def has_words(run: str, encoding, most: float) -> bool:
    """Whether the letter runs are words: the long ones each, and all but the shortest together."""
    letters = [p for p in _PARTS.findall(run) if p[0].isalpha() and len(p) >= LEAST_JUDGED]
    tokens = [len(encoding.encode_ordinary(p)) for p in letters]
    if any(len(p) >= LEAST_ALONE and len(p) <= most * n for p, n in zip(letters, tokens)):
        return False
    return not letters or sum(map(len, letters)) > most * sum(tokens)


def is_known(run: str, encoding, most: float) -> bool:
    """A digest, a UUID or an identifier made of words."""
    if _UUID.fullmatch(run) or len(run) in DIGEST_LENGTHS and _DIGEST.fullmatch(run):
        return True
    return is_identifier(run) and has_words(run, encoding, most)


def random_spans(text: str, encoding, run_pattern: re.Pattern, most: float) -> list[tuple[int, int, int]]:
    return [
        (m.start(), 3, m.end())
        for m in run_pattern.finditer(text)
        if len(m[0]) <= most * len(encoding.encode_ordinary(m[0])) and not is_known(m[0], encoding, most)
    ]


def find_secrets(
    docs: DataFrame,
    text: str = "text",
    name: str = "secrets",
    min_length: int = MIN_LENGTH,
    max_chars_per_token: float = MAX_CHARS_PER_TOKEN,
) -> DataFrame:
    """``docs`` with a column of spans (kind, start, end) in code points, sorted by start, then kind.

    A null or empty text has no spans. Rows, repeated ones too, and all other columns stay.
    """
    run_pattern = re.compile(r"[A-Za-z0-9+/_=.~-]{%d,}" % min_length)
    hint = r"%s|[A-Za-z0-9+/_=.~-]{%d}" % (_ANY_BASE, min_length)

    @F.pandas_udf(SPAN)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = byte_bpe.rank_encoding(byte_bpe.vocabulary_path(f"{byte_bpe.VOCABULARY}.tiktoken"))
        for texts in batches:
            strings = arrow_text.plain(pa.array(texts, pa.string(), from_pandas=True))
            hits = pc.match_substring_regex(strings, hint).to_numpy(zero_copy_only=False)
            spans: list[list] = [[] for _ in range(len(strings))]
            for i in hits.nonzero()[0]:
                own = strings[int(i)].as_py()
                found = base_spans(own) + random_spans(own, encoding, run_pattern, max_chars_per_token)
                spans[i] = [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(found)]
            yield pd.Series(spans)

    return docs.withColumn(name, scan(F.col(text)))


def written(spans, kinds: tuple[str, ...]):
    """kind:start:end of the spans of these kinds, comma-joined."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark`` and ``n_chars`` counted anew.

    Overlapping spans become one mark; texts without secrets, and nulls, keep all their columns' values.
    """

    @F.pandas_udf("string")
    def replaced(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = texts.astype(object).copy()
        for i, (t, s) in enumerate(zip(texts, spans)):
            if t is None or not len(s):
                continue
            parts, at = [], 0
            for span in s:
                if span["start"] >= at:
                    parts += [t[at : span["start"]], mark]
                at = max(at, span["end"])
            out.iloc[i] = "".join([*parts, t[at:]])
        return out

    found = find_secrets(docs, name="__spans")
    hit = F.size("__spans") > 0
    texts = found.withColumn("text", F.when(hit, replaced("text", "__spans")).otherwise(F.col("text")))
    counted = texts.withColumn("n_chars", F.when(hit, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return counted.drop("__spans")

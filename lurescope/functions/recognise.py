"""Recognise names from a user's table and checksummed numbers in texts, with spans and scores.

A table of at most ``PART`` names is searched all at once by an Aho-Corasick automaton, which each worker
builds. A larger one never travels whole: the pieces of the texts that a bounded filter lets through are
joined with it. Card and account numbers count only if their check digits are right. The result is a column
of spans, or a redactor for ``redact_columns``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache, cached_property
from typing import Tuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .batches import bounds

SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
RAW = "array<struct<a:int,b:int,c:double,d:string>>"
#: Most names in one automaton; more are joined.
PART = 200_000
#: Bits of the filter of a larger table, as a power of two, and how many each name sets. More names than it
#: is made for let more pieces through to the join, never fewer.
FILTER_BITS, PROBES = 26, 3
#: Most bytes of text whose pieces are looked up at once.
_PIECES_BYTES = 1 << 18
NUMBER_SCORE = 1.0
_CARD = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])")
_ACCOUNT = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![0-9A-Za-z])")

Found = tuple[int, int, float, str]


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay the same."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def has_luhn_digit(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    doubled = [2 * int(d) - 9 * (int(d) > 4) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def has_account_digits(account: str) -> bool:
    """Whether an international account number leaves 1 modulo 97, its first four characters moved to the end."""
    return 15 <= len(account) <= 34 and int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def numbers(text: str) -> list[Found]:
    """Spans of card numbers and of international account numbers with right check digits.

    An account number may run into further capitals; the longest beginning that ends with a word and is
    right counts.
    """
    found = [
        (m.start(), m.end(), NUMBER_SCORE, "card") for m in _CARD.finditer(text) if has_luhn_digit(re.sub("[ -]", "", m[0]))
    ]
    for m in _ACCOUNT.finditer(text):
        ends = [m.end(), *(m.start() + i for i in range(len(m[0]) - 1, 14, -1) if m[0][i] == " ")]
        right = [e for e in ends if has_account_digits(text[m.start() : e].replace(" ", ""))]
        found += [(m.start(), e, NUMBER_SCORE, "account") for e in right[:1]]
    return found


class NameTable:
    """Names with kind and score; the automaton is built where it is first used and never sent."""

    def __init__(self, names: Sequence[str], kinds: Sequence[str], scores: Sequence[float]):
        self.rows = list(zip(names, kinds, scores))

    def __getstate__(self):
        return {"rows": self.rows}

    @cached_property
    def automaton(self):
        import ahocorasick

        made, best = ahocorasick.Automaton(), {}
        for name, kind, score in self.rows:
            key = folded(name)
            best[key] = max(best.get(key, (-1.0, "")), (score, kind))
        for key, (score, kind) in best.items():
            made.add_word(key, (len(key), score, kind))
        if best:
            made.make_automaton()
        return made if best else None

    def find(self, text: str) -> list[Found]:
        """All occurrences that no letter or digit touches, nested ones too."""
        if self.automaton is None or not text:
            return []
        out = []
        for last, (length, score, kind) in self.automaton.iter(folded(text)):
            start, end = last + 1 - length, last + 1
            if not (start and text[start - 1].isalnum()) and not (end < len(text) and text[end].isalnum()):
                out.append((start, end, score, kind))
        return out


@cache
def _alnum() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class Spelled:
    """Folded texts side by side, with their words and a hash of any piece of them."""

    def __init__(self, texts: Sequence[str]):
        codes = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.lengths = np.array([len(t) for t in texts], dtype=np.int64)
        self.begins = 1 + np.cumsum(self.lengths + 1) - (self.lengths + 1)
        self.alnum = _alnum()[codes]
        edges = np.flatnonzero(self.alnum[1:] != self.alnum[:-1]) + 1
        self.word_begins, self.word_ends = edges[0::2], edges[1::2]
        powers = np.cumprod(np.full(len(codes), _BASE, dtype=np.uint64))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers)))
        self.inverses = np.cumprod(np.full(len(codes), _INVERSE, dtype=np.uint64))

    def slots(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The filter's bits of every piece, one row for each probe."""
        h = (self.sums[ends] - self.sums[starts]) * self.inverses[starts]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        low, step = h, (h >> np.uint64(32)) | np.uint64(1)
        return np.stack([(low + np.uint64(i) * step) & np.uint64((1 << FILTER_BITS) - 1) for i in range(PROBES)])

    def shapes(self) -> np.ndarray:
        """For every text: characters before its first word, words, and characters after its last."""
        ends = self.begins + self.lengths
        first, last = np.searchsorted(self.word_begins, self.begins), np.searchsorted(self.word_begins, ends)
        shapes = np.stack([self.lengths, last - first, np.zeros_like(ends)], axis=1)
        own = last > first
        shapes[own, 0] = self.word_begins[first[own]] - self.begins[own]
        shapes[own, 2] = ends[own] - self.word_ends[last[own] - 1]
        return shapes

    def of_shape(self, before: int, words: int, after: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all pieces of so many words, with so many other characters before and after,
        that no letter or digit touches. Pieces without a word have ``before`` characters."""
        if words:
            starts = self.word_begins[: max(0, len(self.word_begins) - words + 1)] - before
            ends = self.word_ends[words - 1 :] + after
        else:
            starts = np.arange(1, max(1, len(self.alnum) - before))
            ends = starts + before
        inside = (starts >= 1) & (ends < len(self.alnum))
        starts, ends = starts[inside], ends[inside]
        apart = ~(self.alnum[starts - 1] | self.alnum[ends])
        return starts[apart], ends[apart]

    def owners(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The text in which each piece starts, and whether it ends there too."""
        owner = np.searchsorted(self.begins, starts, side="right") - 1
        return owner, (starts >= self.begins[owner]) & (ends <= self.begins[owner] + self.lengths[owner])


class PieceFilter:
    """Shapes of the names and a bit table of their hashes: which pieces of a text may be names."""

    def __init__(self, shapes: Sequence[tuple[int, int, int]], bits: np.ndarray):
        self.shapes, self.bits = list(shapes), bits

    def pieces(self, texts: Sequence[str]) -> Iterator[tuple[int, int, int, str]]:
        """(text, start, end, piece) of every piece of the folded texts that may be a name."""
        made = Spelled(texts)
        for kind in self.shapes:
            starts, ends = made.of_shape(*kind)
            if not len(starts):
                continue
            slots = made.slots(starts, ends).astype(np.int64)
            known = ((self.bits[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1)).all(axis=0)
            starts, ends = starts[known], ends[known]
            owner, whole = made.owners(starts, ends)
            for i, a, b in zip(owner[whole].tolist(), (starts - made.begins[owner])[whole].tolist(), (ends - made.begins[owner])[whole].tolist()):
                yield i, a, b, texts[i][a:b]


def apart(found: list[Found]) -> list[Found]:
    """Spans that don't overlap: from the left, of those with one start the longest, then the surest."""
    out: list[Found] = []
    for span in sorted(found, key=lambda s: (s[0], -s[1], -s[2], s[3])):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


class Names:
    """A table of names as ``name_parts`` makes it: one broadcast part, or rows to join and their filter."""

    def __init__(self, parts: int, table=None, pieces=None, rows: DataFrame | None = None):
        self.parts, self.table, self.pieces, self.rows = parts, table, pieces, rows

    def __len__(self) -> int:
        return self.parts

    def __getstate__(self):
        return {**self.__dict__, "rows": None}


def _folded(texts: pa.Array) -> list[str]:
    return [folded(t or "") for t in texts.to_pylist()]


def _filter(rows: DataFrame) -> PieceFilter:
    """The filter of folded names; the driver gets its shapes and at most 2 ** (FILTER_BITS - 6) words of bits."""

    def slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, many in bounds([batch.column(0)], _PIECES_BYTES):
                own = batch.column(0).slice(at, many).to_pylist()
                made = Spelled(own)
                slots = made.slots(made.begins, made.begins + made.lengths).astype(np.int64)
                # One row a name and probe; each shape of the slice goes with one of them.
                kinds = np.unique(made.shapes(), axis=0).tolist()
                yield pa.record_batch({
                    "word": pa.array((slots >> 6).ravel()), "bit": pa.array((np.uint64(1) << (slots & 63).astype(np.uint64)).view(np.int64).ravel()),
                    "shape": pa.array(kinds + [None] * (slots.size - len(kinds)), pa.list_(pa.int32())),
                })

    made = rows.select("name").mapInArrow(slotted, "word long, bit long, shape array<int>")
    words = made.groupBy("word").agg(F.bit_or("bit").alias("bits"), F.collect_set("shape").alias("shapes")).toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), dtype=np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    shapes = {tuple(k) for own in words["shapes"].to_pylist() for k in own}
    return PieceFilter(sorted(shapes), bits)


def name_parts(names: DataFrame, name: str = "name", kind: str = "kind", score: str | None = None, part: int = PART) -> Names:
    """The table for ``recognise`` and ``redactor``; null and blank names are left out.

    Up to ``part`` names are broadcast; of more only a filter of fixed size is, and the names stay rows. Its
    length tells how many times ``part`` the table is. ``score`` names a column between 0 and 1; without one
    every name has 0.85.
    """
    spark = names.sparkSession
    sure = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.85)
    rows = names.where(F.trim(name) != "").select(F.col(name).alias("name"), F.coalesce(kind, F.lit("name")).alias("kind"), sure.alias("score")).distinct()
    many = max(1, -(-rows.count() // part))
    if many == 1:
        own = rows.toArrow()
        return Names(1, table=spark.sparkContext.broadcast(NameTable(*(own[c].to_pylist() for c in ("name", "kind", "score")))))

    @F.arrow_udf("string")
    def fold(texts: pa.Array) -> pa.Array:
        return pa.array(_folded(texts), pa.string())

    best = rows.withColumn("name", fold("name")).groupBy("name").agg(F.max(F.struct("score", "kind")).alias("best"))
    kept = materialise(best.select("name", "best.score", "best.kind"), "names")
    return Names(many, pieces=spark.sparkContext.broadcast(_filter(kept)), rows=kept)


def _free(df: DataFrame, wanted: str) -> str:
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def _joined(df: DataFrame, text: str, names: Names, found: str) -> DataFrame:
    """``df`` with ``found``: the names in the text, as an array, or null.

    The texts' pieces go to the names, and what is found comes back to all texts with the same SHA-256, so
    that rows need no key of their own.
    """
    pieces = names.pieces

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, many in bounds([batch.column(1)], _PIECES_BYTES):
                own, keys = _folded(batch.column(1).slice(at, many)), batch.column(0).slice(at, many)
                rows = list(pieces.value.pieces(own))
                yield pa.record_batch({
                    "key": keys.take(pa.array([r[0] for r in rows], pa.int64())),
                    **{c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate((("a", pa.int32()), ("b", pa.int32()), ("name", pa.string())), 1)},
                })

    key = _free(df, "_key")
    digest = F.unhex(F.sha2(F.col(text), 256))
    cuts = df.where(F.length(text) > 0).select(digest.alias("key"), F.col(text).alias("text")).mapInArrow(cut, "key binary, a int, b int, name string")
    hits = cuts.join(names.rows, "name").groupBy(F.col("key").alias(key)).agg(
        F.collect_set(F.struct("a", "b", F.col("score").alias("c"), F.col("kind").alias("d"))).alias(found)
    )
    return df.withColumn(key, digest).join(hits, key, "left").drop(key)


def _found(df: DataFrame, text: str, names: Names) -> tuple[DataFrame, Column, list[str]]:
    """``df``, the column with the names found by a join (null if none was needed), and columns to drop."""
    if names.table is not None:
        return df, F.lit(None).cast(RAW), []
    column = _free(df, "_found")
    return _joined(df, text, names, column), F.col(column), [column]


def _spans(text: str, found, table, with_numbers: bool, least: float) -> list[Found]:
    """The spans of one text: names found before, or those of a broadcast table, and numbers."""
    own = [(f["a"], f["b"], f["c"], f["d"]) for f in found or []] + (table.value.find(text) if table is not None else [])
    return apart([f for f in own + (numbers(text) if with_numbers else []) if f[2] >= least])


def recognise(df: DataFrame, text: str, parts: Names, out: str = "spans", with_numbers: bool = True, least: float = 0.0) -> DataFrame:
    """``df`` with ``out``: spans (kind, start, end, score) in code points, in order and without overlap.

    ``parts`` comes from ``name_parts``. Spans under the score ``least`` don't count. A null text has no
    spans; a column named ``out`` is replaced, all others stay.
    """
    table = parts.table

    @F.arrow_udf(SPAN)
    def resolved(batches: Iterator[Tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for texts, found in batches:
            for at, many in bounds([texts]):
                rows = zip(texts.slice(at, many).to_pylist(), found.slice(at, many).to_pylist())
                spans = [_spans(t or "", f, table, with_numbers, least) for t, f in rows]
                yield pa.array([[dict(zip(("kind", "start", "end", "score"), (k, a, b, s))) for a, b, s, k in row] for row in spans], kind)

    wide, found, extra = _found(df, text, parts)
    needed = with_numbers or table is not None
    return wide.withColumn(out, resolved(F.col(text) if needed else F.lit(None).cast("string"), found)).drop(*extra)


class Redactor:
    """Puts <KIND> in place of every span, for ``redact_columns``; null texts stay null."""

    def __init__(self, parts: Names, with_numbers: bool, least: float):
        self.parts, self.with_numbers, self.least = parts, with_numbers, least

    def _redacted(self, text: str, found=None) -> str:
        done, at = [], 0
        for start, end, _, kind in _spans(text, found, self.parts.table, self.with_numbers, self.least):
            done += [text[at:start], f"<{kind.upper()}>"]
            at = end
        return "".join([*done, text[at:]])

    def __call__(self, texts: pd.Series) -> pd.Series:
        """For a table that is one broadcast part; larger ones need ``redact_column``."""
        if self.parts.table is None:
            raise ValueError("this table of names is joined: give the redactor to redact_columns")
        return texts.map(self._redacted, na_action="ignore")

    def redact_column(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with the column redacted, by a join where the table of names is large."""
        redacted = self._redacted

        @F.arrow_udf("string")
        def run(batches: Iterator[Tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for texts, found in batches:
                for at, many in bounds([texts]):
                    rows = zip(texts.slice(at, many).to_pylist(), found.slice(at, many).to_pylist())
                    yield pa.array([None if t is None else redacted(t, f) for t, f in rows], pa.string())

        wide, found, extra = _found(df, column, self.parts)
        return wide.withColumn(column, run(F.col(column), found)).drop(*extra)


def redactor(parts: Names, with_numbers: bool = True, least: float = 0.0) -> Redactor:
    """A redactor for ``redact_columns`` that puts <KIND> in place of every span; null texts stay null."""
    return Redactor(parts, with_numbers, least)

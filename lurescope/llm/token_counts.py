"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both agree.

A text of at most ``CHUNK`` characters is one chunk. A longer one is cut into chunks that begin every
``CHUNK`` characters and reach ``OVERLAP`` characters into the next; they are spread over the cluster and
encoded with offsets by the tokenizers library. Two neighbours are spliced at a position of their overlap
that is

- proven stable: the characters around it alone force the pattern that cuts text into words to cut
  there, wherever its search began, so no token crosses it and tokens on either side do not depend on
  the other side;
- common: a token boundary in both encodings.

With positions p(1) < p(2) < ... a text has as many tokens as chunk i has from p(i) to p(i + 1), summed over
i. That sum is the last chunk's total plus, for each splice, the left chunk's tokens before it less the
right chunk's, so chunks are reduced to numbers by a grouped sum. Texts with an overlap that has no such
position go through another round with wider overlaps, at the latest until one chunk holds the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lurescope.llm import arrow_text, byte_bpe
from lurescope.session import materialise

CHUNK = 1 << 16
OVERLAP = 256
#: By how much overlaps grow from round to round, and chunks at least to this many overlaps.
WIDEN = 8
CHUNK_OVERLAPS = 4
LIMIT = 1024
#: The space characters that every reading of the pattern's \s has, and those that some may have.
_SURE_SPACES = "\t\n\x0b\x0c\r "
_UNSURE_SPACES = "\x1c\x1d\x1e\x1f\x85\xa0 ᠎           ​    　﻿"

#: Stands for the end of the text, where the last chunk tells all its tokens.
NO_BORDER = -1
PIECES = "digest string, chunk int, last boolean, piece string, overlap int"
BORDERS = "digest string, border int, position long, before long, after long, total long"


@lru_cache(maxsize=1 << 14)
def kind(char: str) -> str:
    """s, l, n or o for space, letter, number, other; ? where Unicode versions may differ."""
    if char in _SURE_SPACES:
        return "s"
    then, now = unicodedata.ucd_3_2_0.category(char), unicodedata.category(char)
    if char in _UNSURE_SPACES or now == "Cn" or "Z" in (then[0], now[0]):
        return "?"
    kinds = [c[0].lower() if c[0] in "LN" else "o" for c in (then, now)]
    return kinds[0] if then != "Cn" and kinds[0] == kinds[1] else "?"


def is_stable(before: str, after: str) -> bool:
    """Whether a word always ends between two characters, whatever comes before and after them.

    Words are a contraction, letters, numbers or other characters with at most one blank in front, or
    space. So a word ends before a space that follows no space, where the kind changes between letters,
    numbers and others (but for an apostrophe, which may begin a contraction), and behind a space that is
    not a blank.
    """
    left, right = kind(before), kind(after)
    if "?" in (left, right) or left == right or before == " ":
        return False
    return not (before == "'" and right == "l")


def _longest_special(full) -> int:
    return max((len(t.content) for t in full.get_added_tokens_decoder().values()), default=0)


def boundaries(offsets: np.ndarray, piece: str, lo: int, hi: int, reach: int) -> tuple[list[int], list[int]]:
    """The stable token boundaries of ``piece`` in lo..hi, and the number of tokens before each.

    Positions within ``reach``, the length of a special token, from lo or hi are left out, so that a special
    token around a position is whole for both chunks.
    """
    at = [p for p in range(max(1, lo + reach), min(len(piece), hi - reach + 1)) if is_stable(piece[p - 1], piece[p])]
    before = np.searchsorted(offsets[:, 0], at, side="left").tolist()
    whole = [(p, n) for p, n in zip(at, before) if n and offsets[n - 1, 1] <= p]
    return [p for p, _ in whole], [n for _, n in whole]


def _pieces(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """One row per chunk of every text of ``docs`` (digest, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in arrow_text.blocks(batches):
            for digest, text in zip(block.column("digest").to_pylist(), block.column("text").to_pylist()):
                n = max(1, -(-(len(text) - overlap) // chunk))
                for lo in range(0, n, 64):  # a batch of chunks at a time, so that no second copy of the text is held
                    own = range(lo, min(n, lo + 64))
                    yield pa.RecordBatch.from_pydict(
                        {
                            "digest": [digest] * len(own),
                            "chunk": pa.array(own, pa.int32()),
                            "last": [i == n - 1 for i in own],
                            "piece": [text[i * chunk : (i + 1) * chunk + overlap] for i in own],
                            "overlap": pa.array([overlap] * len(own), pa.int32()),
                        }
                    )

    return docs.select("digest", "text").mapInArrow(rows, PIECES)


def _borders(pieces: DataFrame, chunk: int, vocabulary: str) -> DataFrame:
    """What each chunk knows: tokens before the positions of its overlaps, and the last chunk's total."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = byte_bpe.tokenizer(byte_bpe.vocabulary_path(f"{vocabulary}.json"))
        reach = _longest_special(full)
        for batch in batches:
            for at in range(batch.num_rows):
                digest, i, last, piece, overlap = (column[at].as_py() for column in batch.columns)
                encoded = full.encode(piece, add_special_tokens=False)
                offsets = np.array(encoded.offsets, dtype=np.int64).reshape(-1, 2)
                known: list[tuple[int, int | None, int | None, int | None, int | None]] = []
                if i > 0:
                    known += [(i, i * chunk + p, None, n, None) for p, n in zip(*boundaries(offsets, piece, 0, overlap, reach))]
                if last:
                    known.append((NO_BORDER, None, None, None, len(offsets)))
                else:
                    own = boundaries(offsets, piece, chunk, chunk + overlap, reach)
                    known += [(i + 1, i * chunk + p, n, None, None) for p, n in zip(*own)]
                columns = [pa.array(c, pa.int64()) for c in zip(*known)] or [pa.array([], pa.int64())] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest] * len(known), pa.string()), columns[0].cast(pa.int32()), *columns[1:]],
                    names=["digest", "border", "position", "before", "after", "total"],
                )

    return pieces.mapInArrow(rows, BORDERS)


def spliced(docs: DataFrame, chunk: int, overlap: int, vocabulary: str) -> DataFrame:
    """(digest, n_tokens) of every distinct text of ``docs`` (digest, text); n_tokens is null where a splice failed."""
    pieces = _pieces(docs, chunk, overlap)
    # One number of each text's chunks to a task, so that one huge text is encoded by many.
    spread = pieces.repartition("digest", "chunk")
    chunks = docs.select("digest", F.greatest(F.lit(1), F.ceil((F.length("text") - overlap) / chunk)).alias("chunks"))
    known = _borders(spread, chunk, vocabulary)
    # Copies of a text give equal rows, which max makes one.
    met = known.groupBy("digest", "border", "position").agg(
        F.max("before").alias("before"), F.max("after").alias("after"), F.max("total").alias("total")
    )
    common = F.struct("position", (F.col("before") - F.col("after")).alias("added"))
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    per_border = met.groupBy("digest", "border").agg(
        F.coalesce(F.max("total"), F.min(F.when(both, common))["added"]).alias("added")
    )
    sums = per_border.groupBy("digest").agg(F.sum("added").alias("n"), F.count("added").alias("parts"))
    whole = chunks.distinct().join(sums, "digest", "left")
    return whole.select("digest", F.when(F.col("parts") == F.col("chunks"), F.col("n")).alias("n_tokens"))


def huge_counts(docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP, vocabulary: str = byte_bpe.VOCABULARY) -> DataFrame:
    """(digest, n_tokens) of every distinct text of ``docs`` (digest, text), in rounds of wider overlaps.

    ``overlap`` has to be more than twice the length of the longest special token to find any splice.
    """
    known, open_ = None, docs
    while True:
        found = materialise(spliced(open_, chunk, overlap, vocabulary), "spliced")
        done = found.where("n_tokens is not null")
        known = done if known is None else known.unionByName(done)
        failed = found.where("n_tokens is null").select("digest")
        if failed.isEmpty():
            return known
        overlap *= WIDEN
        chunk = max(chunk, CHUNK_OVERLAPS * overlap)
        open_ = docs.join(failed, "digest", "left_semi")


def with_counts(
    docs: DataFrame,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    limit: int = LIMIT,
    vocabulary: str = byte_bpe.VOCABULARY,
) -> DataFrame:
    """``docs`` with n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) of ``text``.

    Counts are those of the tokenizers library for the byte-level vocabulary, special strings read as its
    default does. A null text counts as empty: no bytes, no tokens. Rows, repeated ones too, and all other
    columns stay, but columns of these three names are replaced; an empty table gives no rows. A text without
    any stable position, such as one letter for a million times, ends up as a single chunk.
    """
    text = F.coalesce("text", F.lit(""))
    size = F.length(text)

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        parts = [np.zeros(0, np.int64)]
        for block in arrow_text.blocks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
            words = arrow_text.spaced_words(arrow_text.plain(block.column("text")))
            _, sizes = byte_bpe.encode_words(words.vocab, vocabulary)
            ends = np.concatenate(([0], np.cumsum(sizes[words.codes] if len(words.codes) else sizes)))
            parts.append(np.diff(ends[words.offsets]))
        return pa.array(np.concatenate(parts), pa.int64())

    digest = arrow_text.free_name(docs, "digest")
    small = docs.where(size <= chunk).withColumn("n_tokens", counted(text))
    huge = docs.where(size > chunk).withColumn(digest, F.sha2("text", 256))
    counts = huge_counts(huge.select(F.col(digest).alias("digest"), "text"), chunk, overlap, vocabulary)
    again = counts.select(F.col("digest").alias(digest), F.col("n_tokens").alias("__n"))
    told = huge.drop("n_tokens").join(again, digest).withColumnRenamed("__n", "n_tokens").drop(digest)
    every = small.unionByName(told)
    kept = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    return every.select(
        *(f"`{c}`" for c in kept),
        F.octet_length(text).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"),
    )

"""Arrow helpers shared by the text operators: bounded blocks and coded words.

A block is a slice of a task's rows whose texts hold at most ``BLOCK_BYTES`` bytes (one row, if a
single text is longer). Within a block every distinct word gets a small number, so per-word work is
done once per block and per-token work is numpy gathering.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

BLOCK_BYTES = 5 << 20
#: Characters that a regular expression's \s may match in any Unicode version.
SPACES = "\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_BEFORE_WORD = re.compile(f" (?=[^{SPACES}])")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name like ``wanted`` that ``df`` does not have, in either case of letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{wanted}"
    while name.lower() in taken:
        name += "_"
    return name


#: The C library's way to return freed memory, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system, so that a worker that lives on stays as small as what it holds."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def plain(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous string array, null texts read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.string()), "")


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut where a block's texts would pass ``most`` bytes."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            # What the last block took goes back, so that a worker that is used again stays small.
            pa.default_memory_pool().release_unused()
            at = to


@dataclass
class Words:
    """Documents as runs of word numbers: document i holds codes[offsets[i]:offsets[i + 1]]."""

    offsets: np.ndarray
    codes: np.ndarray
    vocab: pa.Array

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def document_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), self.lengths)


def _coded(lists: pa.ListArray, keep_empty: bool = False) -> Words:
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0] if len(offsets) else 0
    if not keep_empty and len(flat):
        keep = pc.not_equal(flat, "")
        kept = keep.to_numpy(zero_copy_only=False)
        if not kept.all():
            before = np.concatenate(([0], np.cumsum(kept)))
            flat, offsets = flat.filter(keep), before[offsets]
    coded = flat.dictionary_encode()
    return Words(offsets, coded.indices.to_numpy(zero_copy_only=False), coded.dictionary)


def lower_words(texts: pa.Array) -> Words:
    """A-Z lower-cased, cut at the six ASCII space characters."""
    return _coded(pc.ascii_split_whitespace(pc.ascii_lower(texts)))


def alnum_words(texts: pa.Array) -> Words:
    """A-Z lower-cased runs of a-z, 0-9 and everything beyond ASCII."""
    return _coded(pc.split_pattern_regex(pc.ascii_lower(texts), "[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+"))


def spaced_words(texts: pa.Array) -> Words:
    """Cut before every space that a non-space follows; the words of a text join to the text.

    At such a place byte-level BPE always starts a new word too, so words can be encoded alone.
    """
    lists = pc.split_pattern(texts, " ")
    words = _coded(lists, keep_empty=True)
    loose = pc.match_substring_regex(words.vocab, f"^(?:[{SPACES}]|$)").to_numpy(zero_copy_only=False)
    first = np.zeros(len(words.codes), dtype=bool)
    first[words.offsets[:-1]] = True
    if loose.any():
        odd = np.unique(words.document_of_word()[loose[words.codes] & ~first])
        if len(odd):  # a run of spaces: cut these texts one by one
            again = [_BEFORE_WORD.split(t) for t in texts.take(pa.array(odd)).to_pylist()]
            even = np.setdiff1d(np.arange(len(words)), odd)
            order = np.argsort(np.concatenate([even, odd]))
            both = pa.concat_arrays([lists.take(pa.array(even)), pa.array(again, lists.type)])
            words = _coded(both.take(pa.array(order)), keep_empty=True)
            first = np.zeros(len(words.codes), dtype=bool)
            first[words.offsets[:-1]] = True
    variant = 2 * words.codes.astype(np.int64) + ~first
    used = np.zeros(2 * len(words.vocab), dtype=bool)
    used[variant] = True
    number = np.cumsum(used) - 1
    chosen = np.flatnonzero(used)
    parts = words.vocab.take(pa.array(chosen // 2))
    spaces = pa.array(np.array(["", " "], dtype=object)[chosen % 2], pa.string())
    return Words(words.offsets, number[variant].astype(np.int32), pc.binary_join_element_wise(spaces, parts, ""))


def gathered(starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Indices that concatenate the runs starts[c] .. starts[c] + lengths[c] over all codes c."""
    sizes = lengths[codes]
    ends = np.cumsum(sizes)
    return np.repeat(starts[codes] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Document ranges of at most ``most`` units each (one document, if it is longer)."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, to
        at = to

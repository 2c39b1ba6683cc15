"""Hashes of word runs over a block of coded documents, without building the runs as strings."""

from __future__ import annotations

import numpy as np

from lurescope.llm.arrow_text import Words
from lurescope.llm.word_exchange import word_hashes

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of the result can serve as a hash."""
    v = values.astype(np.uint64)
    v = (v ^ (v >> np.uint64(30))) * _MIX_1
    v = (v ^ (v >> np.uint64(27))) * _MIX_2
    return v ^ (v >> np.uint64(31))


def run_hashes(words: Words, width: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes of all runs of ``width`` words and the offsets of each document's runs.

    A document of fewer words has its whole sequence as one run, or none; one without words has none.
    """
    hashes = mixed(word_hashes(words.vocab))
    own = hashes[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    lengths = words.lengths
    n_runs = np.maximum(lengths - width + 1, 0)
    if whole_if_short:
        n_runs = np.where((lengths > 0) & (n_runs == 0), 1, n_runs)
    offsets = np.concatenate(([0], np.cumsum(n_runs)))
    starts = np.repeat(words.offsets[:-1] - offsets[:-1], n_runs) + np.arange(offsets[-1])
    ends = np.repeat(words.offsets[1:], n_runs)
    total = np.zeros(len(starts), dtype=np.uint64)
    for j in range(width):
        inside = starts + j < ends
        at = np.minimum(starts + j, max(0, len(own) - 1))
        total = np.where(inside, (total + own[at]) * _STEP, total) if len(own) else total
    return mixed(total), offsets

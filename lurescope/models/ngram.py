"""Character bigram model: mean cross-entropy of a URL under add-one smoothed training counts.

Texts are read whole. Pairs are counted per Arrow batch before they are shuffled, so a pair that
occurs in every URL sends one row per batch; scoring looks pairs up in sorted arrays and needs no
shuffle, unless there are too many pairs for a task: then texts meet the losses of their pairs in a join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import local_copy
from .context import START, mean_losses

FLOOR = 1e-9
# Most pairs that scoring holds in every task.
MAX_PAIRS = 4_000_000
_SHIFT = 21
_START = (1 << _SHIFT) - 1  # above every code point: the context of a first character


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pair keys (previous << 21 | current) of all texts in a row, and the length of each text."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    before = np.concatenate(([_START], points[:-1])) if len(points) else points
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    before[starts] = _START
    return before << _SHIFT | points, lengths


def fit_bigrams(train: DataFrame, text: str) -> DataFrame:
    """(prev, cur, n) counts; at most the square of the alphabet. A first character has prev ''."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, _ = _pairs([t or "" for t in batch.column(0).to_pylist()])
            seen, n = np.unique(keys, return_counts=True)
            before, current = seen >> _SHIFT, seen & _START
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["" if b == _START else chr(b) for b in before.tolist()], pa.string()),
                    pa.array([chr(c) for c in current.tolist()], pa.string()),
                    pa.array(n, pa.int64()),
                ],
                names=["prev", "cur", "n"],
            )

    rows = train.select(text).mapInArrow(counted, "prev string, cur string, n long")
    return rows.groupBy("prev", "cur").agg(F.sum("n").alias("n"))


def _pair_losses(runs: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(run, loss) of runs of two characters, the tables joined by context."""
    symbols = bigrams.select("cur").distinct().count() + 1
    first = F.substring("run", 1, 1)
    wanted = runs.select("run", F.when(first == START, "").otherwise(first).alias("prev"), F.substring("run", 2, 1).alias("cur"))
    contexts = bigrams.groupBy("prev").agg(F.sum("n").alias("n_prev"))
    found = wanted.join(bigrams, ["prev", "cur"], "left").join(contexts, "prev", "left")
    p = (F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("n_prev", F.lit(0)) + symbols)
    return found.select("run", (-F.log(F.greatest(p, F.lit(FLOOR)))).alias("loss"))


def score_bigrams(df: DataFrame, key: str, text: str, bigrams: DataFrame, carry: Sequence[str] = (), out: str = "score") -> DataFrame:
    """(key, carry, out): mean of -ln p over the characters of ``text``; 0 for an empty or null one.

    ``p = (n(prev, cur) + 1) / (n(prev) + V)`` with V the training alphabet plus one symbol for
    everything unseen.
    """
    table = local_copy(bigrams, MAX_PAIRS)
    if table is None:
        return mean_losses(df, key, text, 2, lambda runs: _pair_losses(runs, bigrams), carry, out, MAX_PAIRS)
    rows = table.toPandas()
    before = np.array([ord(c) if c else _START for c in rows["prev"]], dtype=np.int64)
    current = np.array([ord(c) for c in rows["cur"]], dtype=np.int64)
    n = rows["n"].to_numpy(dtype=float)
    symbols = len(np.unique(current)) + 1
    contexts, which = np.unique(before, return_inverse=True)
    n_before = np.bincount(which, n, minlength=len(contexts))
    order = np.argsort(before << _SHIFT | current)
    # The last entry of each array stands for what training never saw.
    keys = np.append((before << _SHIFT | current)[order], np.iinfo(np.int64).max)
    seen = np.append(n[order], 0.0)
    contexts, totals = np.append(contexts, np.iinfo(np.int64).max), np.append(n_before, 0.0)
    model = df.sparkSession.sparkContext.broadcast((keys, seen, contexts, totals))

    def found(sorted_keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(sorted_keys, wanted)
        return np.where(sorted_keys[at] == wanted, values[at], 0.0)

    @F.pandas_udf("double")
    def loss(texts: pd.Series) -> pd.Series:
        keys, seen, contexts, totals = model.value
        pairs, lengths = _pairs(["" if t is None else t for t in texts])
        p = (found(keys, seen, pairs) + 1) / (found(contexts, totals, pairs >> _SHIFT) + symbols)
        row = np.repeat(np.arange(len(lengths)), lengths)
        sums = np.bincount(row, -np.log(np.maximum(p, FLOOR)), minlength=len(lengths))
        return pd.Series(sums / np.maximum(lengths, 1))

    return df.select(key, *carry, loss(F.col(text)).alias(out))

"""Variable-order character model: a tree of contexts with interpolated Kneser-Ney back-off.

A character is predicted from up to ``order`` characters before it. Counts of the longest contexts are
taken from the texts, batch by batch before they are shuffled; counts of a shorter context are the
number of different characters seen in front of it, so each level is a grouped count of the one above.
Tables are kept by (context, character), spread over the cluster by context. To score, the distinct runs
of the texts look their loss up level by level; texts then sum the losses of their own runs, through a
local copy of the runs if they are few and by a join if they are many. Nothing is refused or cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import local_copy, materialise

#: Stands in front of a text; no character of Unicode texts.
START = "￿"
#: Most runs that are scored through a copy in every task.
LOCAL_RUNS = 1 << 20
#: Characters worked on at once, and texts longer than that by themselves.
_TOGETHER = 1 << 20
DISCOUNT = 0.5


def runs_of(texts: list[str], width: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct runs of ``width`` characters that end at each character of the texts (with ``START`` in
    front), the run at each character in a row, and the length of each text."""
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    front = START * (width - 1)
    whole = "".join(front + t for t in texts)
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    starts = np.cumsum(lengths + width - 1) - lengths - (width - 1)
    # A run is named by the run that is shorter by one and the character behind it.
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    _, chars = np.unique(points, return_inverse=True)
    names = chars[at]
    for i in range(1, width):
        _, names = np.unique(names * (len(points) + 1) + chars[at + i], return_inverse=True)
    seen, first = np.unique(names, return_index=True)
    return [whole[p : p + width] for p in at[first].tolist()], names, lengths


def _slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) with a bounded number of characters together."""
    part, size, at = [], 0, 0
    for i, t in enumerate(texts):
        own = t or ""
        if part and size + len(own) > _TOGETHER:
            yield at, part
            part, size, at = [], 0, i
        part.append(own)
        size += len(own)
    if part:
        yield at, part


def counted(rows: DataFrame, text: str, width: int) -> DataFrame:
    """(run, n): the runs of ``width`` characters and how often each occurs."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _slices(batch.column(0).to_pylist()):
                runs, names, _ = runs_of(texts, width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs, pa.string()), pa.array(np.bincount(names, minlength=len(runs)), pa.int64())], names=["run", "n"]
                )

    return rows.select(text).mapInArrow(counts, "run string, n long").groupBy("run").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class ContextTree:
    """``levels[k]`` has (context, char, n, total, kinds) of contexts of k characters: how often the character,
    the context, and how many different characters follow it; ``discounts[k]`` is what each count gives up."""

    order: int
    levels: tuple[DataFrame, ...]
    discounts: tuple[float, ...]
    #: Different characters, and one more for all others.
    symbols: int


def _level(counts: DataFrame) -> DataFrame:
    """Counts (context, char, n) with their contexts' totals, stored by context."""
    totals = counts.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    return materialise(counts.join(totals, "context"), "contexts")


def fit_contexts(train: DataFrame, text: str, order: int = 5) -> ContextTree:
    """The tree of the texts' contexts of 0 to ``order`` characters; null texts are empty."""
    top = counted(train, text, order + 1)
    length = F.length("run")
    counts = top.select(F.substring("run", 1, order).alias("context"), F.substring(F.col("run"), length, F.lit(1)).alias("char"), "n")
    levels, discounts = [], []
    for k in range(order, -1, -1):
        level = _level(counts)
        once, twice = level.agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
        levels.append(level)
        discounts.append(once / (once + 2 * twice) if once else DISCOUNT)
        if k:
            shorter = level.select(F.substring(F.col("context"), F.lit(2), F.lit(max(k - 1, 0))).alias("context"), "char")
            counts = shorter.groupBy("context", "char").agg(F.count(F.lit(1)).alias("n"))
    symbols = levels[-1].count() + 1
    return ContextTree(order, tuple(levels[::-1]), tuple(discounts[::-1]), symbols)


def probabilities(runs: DataFrame, tree: ContextTree) -> DataFrame:
    """``runs`` (run) with ``p``, the probability of its last character after the others."""
    order = tree.order
    rows = runs.select("run", F.substring(F.col("run"), F.length("run"), F.lit(1)).alias("char"), (F.lit(1.0) / tree.symbols).alias("p"))
    for k, (level, discount) in enumerate(zip(tree.levels, tree.discounts)):
        context = F.substring(F.col("run"), F.lit(order - k + 1), F.lit(k)) if k else F.lit("")
        rows = rows.withColumn("context", context)
        known = level.select("context", "char", "n")
        contexts = level.select("context", "total", "kinds").distinct()
        rows = rows.join(known, ["context", "char"], "left").join(contexts, "context", "left")
        own = F.greatest(F.coalesce("n", F.lit(0)) - discount, F.lit(0.0))
        mixed = (own + discount * F.col("kinds") * F.col("p")) / F.col("total")
        rows = rows.select("run", "char", F.when(F.col("total").isNull(), F.col("p")).otherwise(mixed).alias("p"))
    return rows.select("run", "p")


def mean_losses(
    df: DataFrame, key: str, text: str, width: int, losses: Callable[[DataFrame], DataFrame], carry: Sequence[str], out: str, local: int
) -> DataFrame:
    """(key, carry, out): the mean over a text's characters of the loss of the run that ends there.

    ``losses`` gives (run, loss) for a frame of distinct runs. With more than ``local`` of them texts meet
    their runs in a join instead of holding them all.
    """
    stored = materialise(df.select(key, *carry, F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__row")), "texts")
    found = materialise(losses(counted(stored, "__text", width).select("run")), "losses")
    table = local_copy(found, local)
    if table is not None:
        return _by_copy(stored, key, carry, width, table, out)

    def own_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for at, texts in _slices(batch.column(1).to_pylist()):
                runs, names, lengths = runs_of(texts, width)
                size = max(1, len(runs))
                pairs, n = np.unique(np.repeat(np.arange(len(texts)), lengths) * size + names, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[at + pairs // size], pa.int64()), pa.array(runs, pa.string()).take(pa.array(pairs % size)), pa.array(n, pa.int64())],
                    names=["__row", "run", "n"],
                )

    parts = stored.select("__row", "__text").mapInArrow(own_runs, "__row long, run string, n long")
    sums = parts.join(found, "run").groupBy("__row").agg((F.sum(F.col("n") * F.col("loss")) / F.sum("n")).alias(out))
    return stored.drop("__text").join(sums, "__row", "left").select(key, *carry, F.coalesce(out, F.lit(0.0)).alias(out))


def _by_copy(stored: DataFrame, key: str, carry: Sequence[str], width: int, table: DataFrame, out: str) -> DataFrame:
    rows = table.toArrow()
    model = stored.sparkSession.sparkContext.broadcast((rows["run"].combine_chunks(), rows["loss"].to_numpy()))

    @F.arrow_udf("double")
    def loss(texts: pa.Array) -> pa.Array:
        runs, values = model.value
        parts = [np.zeros(0)]
        for _, own in _slices(texts.to_pylist()):
            seen, names, lengths = runs_of(own, width)
            each = values[pc.index_in(pa.array(seen, pa.string()), value_set=runs).to_numpy(zero_copy_only=False)[names]] if seen else names
            sums = np.bincount(np.repeat(np.arange(len(own)), lengths), each, minlength=len(own))
            parts.append(sums / np.maximum(lengths, 1))
        return pa.array(np.concatenate(parts), pa.float64())

    return stored.select(key, *carry, loss("__text").alias(out))


def score_contexts(
    df: DataFrame, key: str, text: str, tree: ContextTree, carry: Sequence[str] = (), out: str = "score", local: int = LOCAL_RUNS
) -> DataFrame:
    """(key, carry, out): mean of -ln p over the characters of ``text``; 0 for an empty or null one.

    Repeated rows stay; an empty table gives no rows. p is interpolated from the empty context, where unseen
    characters share the mass of one symbol, up to the longest context that training has seen.
    """
    losses = lambda runs: probabilities(runs, tree).select("run", (-F.log("p")).alias("loss"))
    return mean_losses(df, key, text, tree.order + 1, losses, carry, out, local)

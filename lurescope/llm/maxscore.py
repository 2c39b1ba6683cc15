"""Exact top-k inner products by MaxScore over shards of integer vectors.

A vector component is a term, its value an impact. Impacts may be negative, so a shard measures them
from the end of its range that is worst for the query: a query weight q and a component x contribute
q * (x - low) if q > 0 and |q| * (high - x) if q < 0, which is never negative, plus a constant per query
and shard. Terms are ordered by the most they can contribute in the shard. With dense vectors nearly all
are candidates and most terms essential, so bound pruning stands in for the split: the first terms, at
most ``STRIDE`` and no non-essential ones, are read for all vectors of the shard, and all others, essential
or not, largest bound first, only for vectors that can still compete. Shards work alone and their winners
are merged, so the result is exact.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

K = 5
#: Vectors of a shard, and queries that visit a shard together.
SHARD = 8192
QUERIES = 2048
#: Terms whose postings are read at once.
STRIDE = 8


def quantised(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """(key, terms): floor(scale * x) of every component, without vectors that are null or not finite.

    A null key takes no part either.
    """
    parts = F.col(column)
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    own = vectors.where(F.col(key).isNotNull() & parts.isNotNull() & finite)
    return own.select(F.col(key).cast("long").alias("key"), F.transform(parts, lambda x: F.floor(x.cast("double") * scale)).alias("terms"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal width; shorter vectors lack the last terms, which contribute nothing."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = lists.offsets.to_numpy()
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), dtype=np.int64)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = flat
    return out


class Shard:
    """Postings of a block of vectors by term, with the range of impacts of each term."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, width: int) -> None:
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        padded = np.zeros((len(values), width), dtype=np.int64)
        padded[:, : values.shape[1]] = values[order]
        self.low, self.high = padded.min(axis=0), padded.max(axis=0)
        # Products below 2**53 are exact as doubles, which numpy multiplies much faster.
        self.top = int(np.abs(padded).max(initial=0))
        self.postings = padded.T.copy()
        self.as_double = self.postings.astype(float)

    def best(self, query_key: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and scores of the k best of the shard, ties to the smaller key; never the query itself."""
        exact = self.top * int(np.abs(query).max(initial=0)) * max(1, len(query)) < 1 << 52
        postings, weights = (self.as_double, query.astype(float)) if exact else (self.postings, query)
        base = np.where(query > 0, query * self.low, query * self.high)
        bounds = np.where(query > 0, query * self.high, query * self.low) - base
        order = np.argsort(-bounds, kind="stable")
        # What the terms from each place in the order on can still add, over the constant part.
        rest = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)
        # A first threshold: whole scores of the vectors that lead on the strongest terms.
        lead = weights[order[:STRIDE]] @ postings[order[:STRIDE]]
        some = np.argpartition(-lead, min(4 * k, len(lead) - 1))[: 4 * k + 1]
        some = some[self.keys[some] != query_key]
        sure = np.sort(weights @ postings[:, some])[::-1]
        threshold = sure[k - 1] - base.sum() if len(sure) >= k else -1
        # Non-essential terms are the tail of the order that cannot reach the threshold by itself; beyond
        # the first stride they are treated like the essential ones.
        essential = min(len(order), max(1, int(np.searchsorted(-rest, -threshold, side="right"))))
        alive = np.flatnonzero(self.keys != query_key)
        done = min(essential, STRIDE)
        partial = (lead if done == STRIDE else weights[order[:done]] @ postings[order[:done]])[alive]
        partial = partial - base[order[:done]].sum()
        while True:
            keep = partial + rest[done] >= threshold
            alive, partial = alive[keep], partial[keep]
            if done == len(order) or not len(alive):
                break
            terms = order[done : done + STRIDE]
            partial = partial + weights[terms] @ postings[np.ix_(terms, alive)] - base[terms].sum()
            done += len(terms)
            if len(partial) > k:
                threshold = max(threshold, np.partition(partial, -k)[-k])
        scores = np.round(partial + base.sum()).astype(np.int64)
        top = np.lexsort((self.keys[alive], -scores))[:k]
        return self.keys[alive[top]], scores[top]


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` best of ``candidates`` for each of ``queries``, both (key, terms) as of ``quantised``.

    Columns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id and a vector is no
    candidate of its own key. Of rows that share a key each is a candidate; a query key is asked once per
    row. Vectors of unequal length count missing terms as 0. Empty tables give no rows.

    Queries are grouped into blocks, every block visits every shard, and a shard's winners meet by query.
    """
    n, asked = candidates.count(), queries.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-asked // QUERIES))
    dealt = candidates.select(
        F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        "key",
        "terms",
    )
    sent = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int").alias("block"),
        "key",
        "terms",
    )

    def visited(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            values, asked_values = _matrix(left["terms"]), _matrix(right["terms"])
            width = max(values.shape[1], asked_values.shape[1])
            shard = Shard(left["key"].to_numpy(), values, width)
            for key, query in zip(right["key"].to_numpy(), asked_values):
                found, scores = shard.best(int(key), np.pad(query, (0, width - len(query))), k)
                rows.append((np.full(len(found), key), found, scores))
        columns = [np.concatenate(c) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), columns)})

    winners = dealt.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(visited, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return winners.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

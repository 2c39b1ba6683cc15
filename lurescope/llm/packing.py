"""Best-fit packing by large-item matching.

Documents become token pieces of at most ``capacity``; a piece above a third of the capacity shares
its bin with at most one other such piece. The plan is made on the histogram of piece lengths, which
has at most ``capacity`` rows whatever the corpus: large lengths are paired greedily (longest first,
each with the longest that still fits), then smaller lengths, longest first, go to the tightest gap,
and only then open bins. Every step places whole runs of equal pieces, so the plan grows with the
number of lengths. Pieces find their place through their rank among equal lengths; ranks are counted
in salted groups, so a length that holds a third of all pieces is never in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from lurescope.llm import arrow_text, byte_bpe
from lurescope.session import materialise

CAPACITY = 2048
END_ID = 0
#: Pieces of one length that are ranked together by one task, about.
RANKED_TOGETHER = 1 << 19

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Token pieces of every text; a null text is empty and has the end id alone.

    A text of more than ``capacity`` tokens is cut so that all pieces but the first are full.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in arrow_text.blocks(batches):
            words = arrow_text.spaced_words(arrow_text.plain(block.column("text")))
            ids, sizes = byte_bpe.encode_words(words.vocab)
            starts = np.cumsum(sizes) - sizes
            keys = block.column("doc_id").to_pylist()
            rows: list[tuple] = []
            for lo, hi in arrow_text.slices(words.offsets, 1 << 18):
                codes = words.codes[words.offsets[lo] : words.offsets[hi]]
                flat = ids[arrow_text.gathered(starts, sizes, codes)].astype("<u4")
                ends = np.concatenate(([0], np.cumsum(sizes[codes])))[words.offsets[lo : hi + 1] - words.offsets[lo]]
                for i in range(lo, hi):
                    own = np.append(flat[ends[i - lo] : ends[i - lo + 1]], np.uint32(END_ID))
                    first = (len(own) - 1) % capacity + 1
                    begin, end, piece = 0, first, 0
                    while begin < len(own):
                        rows.append((keys[i], piece, begin, end - begin, zlib.crc32(own[begin:end].tobytes())))
                        begin, end, piece = end, end + capacity, piece + 1
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Slots (length, first rank, end rank, first bin, pieces per bin, offset) and the bin count.

    ``counts`` maps a piece length to the number of pieces that have it.
    """
    left = dict(counts)
    rank = dict.fromkeys(counts, 0)
    slots: list[tuple] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: (first bin, bins)
    bins = 0

    def place(length: int, first_bin: int, n_bins: int, each: int, offset: int) -> None:
        n = n_bins * each
        slots.append((length, rank[length], rank[length] + n, first_bin, each, offset))
        rank[length] += n
        left[length] -= n

    large = sorted((s for s in counts if 3 * s > capacity), reverse=True)
    for long in large:
        while left[long]:
            mate = next((s for s in large if s <= capacity - long and left[s] > (s == long)), None)
            n = left[long] if mate is None else left[long] // 2 if mate == long else min(left[long], left[mate])
            place(long, bins, n, 1, 0)
            if mate is not None:
                place(mate, bins, n, 1, long)
            gaps[capacity - long - (mate or 0)].append((bins, n))
            bins += n
    for small in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        gap = small
        while left[small]:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                each = min(capacity // small, left[small])
                gaps[capacity].append((bins, max(1, left[small] // each)))
                bins += gaps[capacity][-1][1]
                gap = capacity
            first, n = gaps[gap].pop()
            each = min(gap // small, left[small])
            used = min(n, left[small] // each)
            place(small, first, used, each, capacity - gap)
            gaps[gap - small * each].append((first, used))
            if used < n:
                gaps[gap].append((first + used, n - used))
            gap = small
    return slots, bins


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text) with its sequence and its place there.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Repeated rows are packed
    once each; an empty table gives no rows; other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, capacity), "pieces")
    # At most `capacity` rows, whatever the corpus.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, _ = plan_bins(counts, capacity)
    salts = max(1, -(-max(counts.values(), default=0) // RANKED_TOGETHER))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        salted.groupBy("length", "salt")
        .agg(F.count("*").alias("n"))
        .select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    )
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.join(shifts, ["length", "salt"]).withColumn("rank", F.col("shift") + F.row_number().over(own) - 1)
    # Bounded by the number of lengths and of pieces in a bin, see plan_bins.
    places = spark.createDataFrame(
        slots, "length long, first_rank long, end_rank long, first_bin long, each long, base long"
    )
    at = F.col("rank") - F.col("first_rank")
    return (
        ranked.join(F.broadcast(places), "length")
        .where("rank >= first_rank and rank < end_rank")
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("first_bin") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("base") + at % F.col("each") * F.col("length")).cast("long").alias("offset"),
        )
    )

"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits.

Every shingle is hashed once: its top bits name a bin, the rest compete for the bin's minimum. An empty
bin borrows the minimum of a bin that a fixed sequence of hash draws, depending on the bin and the
attempt alone, finds first among the filled ones. Each bin's value is mixed with the bin's number, so
that bins which share a minimum agree by chance independently; of the result the lowest bits are kept,
and likeness is corrected for the chance that unequal values agree in them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lurescope.llm import arrow_text
from lurescope.llm.shingles import mixed, run_hashes

SHINGLE = 5
BINS = 256
BITS = 4
_BIN_STEP = np.uint64(0xD6E8FEB86659FD93)
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def densified(minima: np.ndarray) -> np.ndarray:
    """Rows of bin minima with every empty bin filled from a bin that is not; empty rows stay."""
    n_bins = minima.shape[1]
    filled = minima != _EMPTY
    rows, bins = np.nonzero(~filled & filled.any(axis=1)[:, None])
    out, attempt = minima.copy(), 0
    while len(rows):
        draws = mixed(np.arange(n_bins, dtype=np.uint64) * np.uint64(0x100000001) + np.uint64(attempt + 1))
        source = (draws % np.uint64(n_bins)).astype(np.int64)[bins]
        hit = filled[rows, source]
        out[rows[hit], bins[hit]] = minima[rows[hit], source[hit]]
        rows, bins, attempt = rows[~hit], bins[~hit], attempt + 1
    return out


def packed_bits(values: np.ndarray, bits: int) -> np.ndarray:
    """The lowest ``bits`` bits of every value, packed row by row."""
    planes = (values[:, :, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).reshape(len(values), -1), axis=1)


def fingerprints(texts: pa.Array, bins: int = BINS, bits: int = BITS) -> list[bytes]:
    """Packed fingerprints of the word shingles of the texts; no bytes for a text without words."""
    words = arrow_text.lower_words(texts)
    hashes, offsets = run_hashes(words, SHINGLE)
    minima = np.full(len(texts) * bins, _EMPTY)
    document = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    bin_bits = bins.bit_length() - 1
    np.minimum.at(
        minima,
        document * bins + (hashes >> np.uint64(64 - bin_bits)).astype(np.int64),
        hashes & np.uint64((1 << (64 - bin_bits)) - 1),
    )
    values = mixed(densified(minima.reshape(len(texts), bins)) + np.arange(bins, dtype=np.uint64) * _BIN_STEP)
    dense = packed_bits(values, bits)
    return [dense[i].tobytes() if n else b"" for i, n in enumerate(np.diff(offsets))]


def likeness(a: bytes, b: bytes, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated Jaccard similarity in [0, 1]; 1 for equal fingerprints, 0 if just one has no words."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    different = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8))[: bins * bits]
    share = 1.0 - different.reshape(bins, bits).any(axis=1).mean()
    chance = 0.5**bits
    return float(min(1.0, max(0.0, (share - chance) / (1.0 - chance))))


def with_next(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` (key, text) grouped in runs of neighbouring keys, sorted within each task.

    Adds ``run`` and ``last``: every run ends with a copy (last = true) of the row that follows its own
    last row, the first run's first row behind the last run. Runs are cut at sketched quantiles and the
    first key of each run is known, so no task and no driver sees more than its runs.
    """
    spark = docs.sparkSession
    n_runs = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(key, [i / n_runs for i in range(1, n_runs)], 20 * n_runs)).first()[0]
    bounds = np.unique(np.array(cuts or [], dtype=np.int64))

    @F.pandas_udf("int")
    def run_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="right").astype(np.int32))

    # One row per run, as many as three times the shuffle partitions.
    firsts = docs.select(run_of(key).alias("run"), key).groupBy("run").agg(F.min(key).alias("first")).orderBy("run")
    found = [(r["run"], r["first"]) for r in firsts.collect()]
    before = {first: found[i - 1][0] for i, (_, first) in enumerate(found)}
    follows = np.array(sorted(before), dtype=np.int64)
    into = np.array([before[k] for k in follows.tolist()], dtype=np.int32)

    @F.pandas_udf("array<int>")
    def runs_of(keys: pd.Series) -> pd.Series:
        own = np.searchsorted(bounds, keys.to_numpy(), side="right").astype(np.int32)
        at = np.searchsorted(follows, keys.to_numpy())
        first = (at < len(follows)) & (follows[np.minimum(at, max(0, len(follows) - 1))] == keys.to_numpy())
        return pd.Series([[r, into[a]] if f else [r] for r, a, f in zip(own, at, first)])

    dealt = docs.select("*", F.posexplode(runs_of(key)).alias("copy", "run")).withColumn("last", F.col("copy") == 1)
    return dealt.drop("copy").repartition("run").sortWithinPartitions("run", "last", key, "text")


def edited_pairs(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    The edited text has the last half of its code points replaced by the first as many of the next
    document's, in ascending doc_id (then text); after the last comes the first. A null text is empty; a
    null doc_id sorts before all others and is given back as null; repeated rows follow each other; an
    empty table gives no rows; a single row follows itself; other columns are ignored.
    """
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    lowest = -(1 << 63)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []
        for block in arrow_text.blocks(batches):
            names = ("doc_id", "run", "last", "text")
            own = pending + list(zip(*(block.column(n).to_pylist() for n in names)))
            pending = own[-1:]
            pairs = [i for i in range(len(own) - 1) if own[i][1] == own[i + 1][1] and not own[i][2]]
            edited = []
            for i in pairs:
                text, after = own[i][3], own[i + 1][3]
                half = len(text) // 2
                edited.append(text[: len(text) - half] + after[:half])
            if not pairs:
                continue
            prints = fingerprints(pa.array([r[3] for r in own], pa.string()), bins, bits)
            changed = fingerprints(pa.array(edited, pa.string()), bins, bits)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None if own[i][0] == lowest else own[i][0] for i in pairs], pa.int64()),
                    pa.array([len(own[i][3]) for i in pairs], pa.int64()),
                    pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                    pa.array([prints[i].hex() for i in pairs]),
                    pa.array([c.hex() for c in changed]),
                    pa.array([likeness(prints[i], c, bins, bits) for i, c in zip(pairs, changed)]),
                    pa.array([likeness(prints[i], prints[i + 1], bins, bits) for i in pairs]),
                ],
                names=[c.split()[0] for c in schema.split(", ")],
            )

    keyed = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    return with_next(keyed).mapInArrow(rows, schema)

"""Character sequences: vocabulary from training URLs and index encoding, ragged or padded."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .ranking import attach

# Reserved indexes.
PAD, OOV, FIRST_INDEX = 0, 1, 2


def char_vocab(train: DataFrame, text: str) -> DataFrame:
    """(char, index) for every distinct character, in code point order from index 2.

    Each row first drops its own repeats, then partial aggregation leaves at most one row per
    character and task. The final ordering sees at most the number of Unicode code points.
    """
    chars = train.select(F.explode(F.array_distinct(F.split(text, ""))).alias("char"))
    distinct = chars.where(F.col("char") != "").distinct()
    order = Window.partitionBy(F.lit(0)).orderBy("char")
    return distinct.select(
        "char", (F.row_number().over(order) + F.lit(FIRST_INDEX - 1)).alias("index")
    )


def encode_chars(df: DataFrame, text: str, vocab: DataFrame, out: str = "seq", max_len: int | None = None) -> DataFrame:
    """Append the index sequence of the characters, as long as the text.

    With ``max_len`` sequences are padded with 0 to that length and longer ones cut; ``cut_report`` tells
    how many that are. A null text has no characters. The vocabulary has at most one row per Unicode code point; a character is found in it by
    binary search.
    """
    rows = vocab.select("char", "index").toPandas().sort_values("char", key=lambda c: c.map(ord))
    points = np.append(np.array([ord(c) for c in rows["char"]], dtype=np.int64), np.iinfo(np.int64).max)
    codes = np.append(rows["index"].to_numpy(dtype=np.int32), np.int32(OOV))

    @F.arrow_udf("array<int>")
    def encoded(texts: pa.Array) -> pa.Array:
        own = [t or "" for t in texts.to_pylist()]
        lengths = [len(t) for t in own]
        wanted = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        at = np.searchsorted(points, wanted)
        found = np.where(points[at] == wanted, codes[at], np.int32(OOV)).astype(np.int32)
        offsets = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found, pa.int32()))

    whole = df.withColumn(out, encoded(F.col(text)))
    if max_len is None:
        return whole
    head = F.slice(out, 1, max_len)
    return whole.withColumn(out, F.concat(head, F.array_repeat(F.lit(PAD), max_len - F.size(head))))


def pad_to_longest(df: DataFrame, text: str, seq: str = "seq") -> DataFrame:
    """Pad the sequences ``seq`` of the texts with 0 to the length of the longest text of ``df``; none is cut."""
    longest = df.agg(F.coalesce(F.max(F.length(text)), F.lit(0)).alias("_width"))
    padding = F.array_repeat(F.lit(PAD), F.col("_width") - F.coalesce(F.length(text), F.lit(0)))
    return attach(df, longest, ["_width"]).withColumn(seq, F.concat(seq, padding)).drop("_width")


def cut_report(df: DataFrame, text: str, max_len: int) -> DataFrame:
    """One row: texts, texts longer than ``max_len``, and the characters that padding to it cuts off."""
    over = F.length(text) - max_len
    return df.agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.count_if(over > 0).alias("n_cut"),
        F.coalesce(F.sum(F.when(over > 0, over)), F.lit(0)).cast("long").alias("characters_cut"),
    )

"""Look up a corpus-wide value for every distinct word of every block, and bring it back.

A word's global value (its count, its ids) needs one meeting place per distinct word. Sending one row
per word of every block would cost several times the text in shuffle, so a block sends one packed row
per word bucket: its distinct words in that bucket. A bucket's task sees each distinct word of the
corpus that belongs there once, works out its value, and answers every block in the order it asked.
A frequent word comes at most once from each block, so no bucket is hot.

``docs`` is read twice and must give the same blocks both times, as files do; blocks are named by
their content, so any difference ends the job with an error instead of wrong results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame

from lurescope.llm import arrow_text
from lurescope.llm.arrow_text import Words

Split = Callable[[pa.Array], Words]

ASKED = "block long, bucket int, words binary, weights binary"
ANSWERS = "block long, bucket int, answer binary"
#: Stands for a null doc_id within a block.
NO_KEY = -(1 << 63)
DOCUMENTS = "block long, doc_id binary, offsets binary, codes binary"


#: Larger blocks repeat fewer words; both reads of the documents must use the same.
EXCHANGE_BYTES = 10 << 20


def exchange_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return arrow_text.blocks(batches, most=EXCHANGE_BYTES)


def buckets_for(docs: DataFrame) -> int:
    """As many buckets as input partitions or shuffle partitions, so a bucket's size stays level."""
    own = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, own, docs.rdd.getNumPartitions())


def packed(values: np.ndarray) -> bytes:
    """Compressed by byte planes: the high bytes of small numbers take next to nothing."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.compress(values.dtype.str.encode().ljust(4) + planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = zstandard.decompress(data)
    kind = np.dtype(raw[:4].decode().strip())
    planes = np.frombuffer(raw, np.uint8, offset=4)
    planes = planes.reshape(kind.itemsize, len(planes) // kind.itemsize)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def packed_words(words: pa.Array) -> bytes:
    words = words.cast(pa.string())
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int32)
    body = b""
    if lengths.any():
        ends = np.frombuffer(words.buffers()[1], np.int32)[[words.offset, words.offset + len(words)]]
        body = words.buffers()[2][ends[0] : ends[1]]
    sizes = packed(lengths)
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.compress(body)


def unpacked_words(data: bytes) -> pa.Array:
    head = int.from_bytes(data[:4], "little")
    lengths = unpacked(data[4 : 4 + head])
    body = zstandard.decompress(data[4 + head :])
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets.tobytes()), pa.py_buffer(body))


def word_hashes(words: pa.Array) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter(map(digest, words.to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(words))


def keys_of(block: pa.RecordBatch) -> np.ndarray:
    return block.column("doc_id").cast(pa.int64()).fill_null(NO_KEY).to_numpy(zero_copy_only=False)


def key_column(keys: np.ndarray) -> pa.Array:
    return pa.array(keys, pa.int64(), mask=keys == NO_KEY)


def numbered(block: pa.RecordBatch, split: Split, n_buckets: int) -> tuple[int, Words, np.ndarray]:
    """The block's name, its words numbered bucket by bucket, and where each bucket begins."""
    words = split(arrow_text.plain(block.column("text")))
    hashes = word_hashes(words.vocab)
    bucket = (hashes % np.uint64(n_buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    number = np.empty(len(order), dtype=np.int32)
    number[order] = np.arange(len(order), dtype=np.int32)
    begins = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    name = xxhash.xxh3_64()
    for part in (keys_of(block), words.offsets, words.codes, hashes):
        name.update(np.ascontiguousarray(part).tobytes())
    codes = number[words.codes] if len(order) else words.codes
    named = int(np.uint64(name.intdigest()).astype(np.int64))
    return named, Words(words.offsets, codes, words.vocab.take(pa.array(order))), begins


def asked(
    docs: DataFrame,
    split: Split,
    n_buckets: int,
    weights: Callable[[pa.RecordBatch, Words], np.ndarray] | None = None,
) -> DataFrame:
    """One row per block and bucket: the distinct words, and their weights in the block if wanted."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in exchange_blocks(batches):
            name, words, begins = numbered(block, split, n_buckets)
            own = None if weights is None else weights(block, words)
            full = np.flatnonzero(np.diff(begins))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(full), name, np.int64)),
                    pa.array(full.astype(np.int32)),
                    pa.array([packed_words(words.vocab.slice(begins[b], begins[b + 1] - begins[b])) for b in full], pa.binary()),
                    pa.array([None if own is None else packed(own[begins[b] : begins[b + 1]]) for b in full], pa.binary()),
                ],
                names=["block", "bucket", "words", "weights"],
            )

    return docs.select("doc_id", "text").mapInArrow(rows, ASKED)


def document_rows(docs: DataFrame, split: Split, n_buckets: int) -> DataFrame:
    """One row per block: its documents as word numbers, in the numbering of ``asked``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in exchange_blocks(batches):
            name, words, _ = numbered(block, split, n_buckets)
            parts = [packed(keys_of(block)), packed(words.offsets), packed(words.codes)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name], pa.int64()), *(pa.array([p], pa.binary()) for p in parts)],
                names=["block", "doc_id", "offsets", "codes"],
            )

    return docs.select("doc_id", "text").mapInArrow(rows, DOCUMENTS)


def distinct_words(table: pa.Table) -> tuple[pa.Array, list[np.ndarray]]:
    """A bucket's distinct words, and each row's words as numbers among them."""
    parts = [unpacked_words(w.as_py()) for w in table.column("words")]
    coded = pa.chunked_array(parts, pa.string()).combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum([len(p) for p in parts])
    return coded.dictionary, np.split(codes, ends[:-1])


def joined(
    documents: DataFrame,
    answers: DataFrame,
    finish: Callable[..., pa.Table],
    schema: str,
    extra: bool = False,
) -> DataFrame:
    """Blocks brought together with their answers, in bucket order, and turned into rows.

    ``finish`` gets the doc_ids, the documents as word numbers, the answers and, if wanted, what the
    block's row has in ``extra``.
    """

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ordered = dict(sorted(zip(right.column("bucket").to_pylist(), right.column("answer").to_pylist())))
        out = []
        for row in left.to_pylist():
            words = Words(unpacked(row["offsets"]), unpacked(row["codes"]), None)
            if len(words.codes) and not ordered:
                raise RuntimeError("the documents changed between two reads; store them first")
            more = [row["extra"]] if extra else []
            out.append(finish(unpacked(row["doc_id"]), words, list(ordered.values()), *more))
        if not out:
            raise RuntimeError("the documents changed between two reads; store them first")
        return pa.concat_tables(out)

    return documents.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(meet, schema)

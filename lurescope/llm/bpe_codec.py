"""Byte-level BPE encoding and decoding through a table of distinct words.

Texts are split into words in the tasks that read them; every distinct word meets in its bucket and
is encoded there once for the whole corpus; the ids go back to the words' places in each block. To
decode, ids are joined with the id-to-piece table (one row per id of the fixed vocabulary, so a
bounded build side) and a text's pieces are put together in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lurescope.llm import arrow_text, byte_bpe, word_exchange
from lurescope.llm.arrow_text import Words

#: Token ids as 16 bits where the vocabulary allows it.
_SMALL = 1 << 16


def _answer(table: pa.Table) -> pa.Table:
    """Encode a bucket's distinct words once and give each block the ids of its own words."""
    vocab, codes = word_exchange.distinct_words(table)
    ids, sizes = byte_bpe.encode_words(vocab)
    starts = np.cumsum(sizes) - sizes
    kind = np.uint16 if ids.max(initial=0) < _SMALL else np.uint32
    answers = []
    for own in codes:
        flat = word_exchange.packed(ids[arrow_text.gathered(starts, sizes, own)].astype(kind))
        lengths = word_exchange.packed(sizes[own].astype(np.int32))
        answers.append(len(lengths).to_bytes(4, "little") + lengths + flat)
    return pa.table(
        {"block": table.column("block"), "bucket": table.column("bucket"), "answer": pa.array(answers, pa.binary())}
    )


def _ids_of_block(answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the block's words in order, and how many each word has."""
    ids, sizes = [np.zeros(0, np.uint16)], [np.zeros(0, np.int32)]
    for data in answers:
        head = int.from_bytes(data[:4], "little")
        sizes.append(word_exchange.unpacked(data[4 : 4 + head]))
        ids.append(word_exchange.unpacked(data[4 + head :]))
    return np.concatenate(ids), np.concatenate(sizes)


def encode(docs: DataFrame, finish: Callable[[np.ndarray, Words, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """Encode every text of ``docs`` (doc_id, text) and turn each block's ids into rows.

    ``finish`` gets the doc_ids, the documents as word numbers, all ids of the words in a row and how
    many each word has. A null text is an empty one; repeated rows and repeated doc_ids stay rows of
    their own; an empty table gives no rows; other columns are ignored.
    """
    n = word_exchange.buckets_for(docs)
    asked = word_exchange.asked(docs, arrow_text.spaced_words, n)
    answers = asked.groupBy("bucket").applyInArrow(_answer, word_exchange.ANSWERS)
    documents = word_exchange.document_rows(docs, arrow_text.spaced_words, n)

    def per_block(keys: np.ndarray, words: Words, answers: list[bytes]) -> pa.Table:
        ids, sizes = _ids_of_block(answers)
        return finish(keys, words, ids, sizes)

    return word_exchange.joined(documents, answers, per_block, schema)


def _texts(pieces: list[bytes], ids: np.ndarray, sizes: np.ndarray, between: bytes) -> list[bytes]:
    """The words' pieces, joined word by word."""
    parts = [pieces[i] for i in ids.tolist()]
    ends = np.cumsum(sizes).tolist()
    return [between.join(parts[a:b]) for a, b in zip([0, *ends], ends)]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and digests of the decimal ids and of the text decoded from them."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def finish(keys: np.ndarray, words: Words, ids: np.ndarray, sizes: np.ndarray) -> pa.Table:
        table = dict(byte_bpe.id_pieces())
        piece_of = [table.get(i, b"") for i in range(max(table) + 1)]
        number_of = [b"%d" % i for i in range(len(piece_of))]
        numbers, decoded = _texts(number_of, ids, sizes, b","), _texts(piece_of, ids, sizes, b"")
        n_tokens, id_digests, text_digests = [], [], []
        for lo, hi in zip(words.offsets[:-1], words.offsets[1:]):
            codes = words.codes[lo:hi]
            codes = codes[sizes[codes] > 0]
            n_tokens.append(int(sizes[codes].sum()))
            own = codes.tolist()
            id_digests.append(hashlib.sha256(b",".join([numbers[c] for c in own])).hexdigest())
            text = b"".join([decoded[c] for c in own]).decode("utf-8", "replace")
            text_digests.append(hashlib.sha256(text.encode()).hexdigest())
        return pa.table(
            {
                "doc_id": word_exchange.key_column(keys),
                "n_tokens": pa.array(n_tokens, pa.int64()),
                "ids_sha256": pa.array(id_digests, pa.string()),
                "decoded_sha256": pa.array(text_digests, pa.string()),
            }
        )

    return encode(docs, finish, schema)

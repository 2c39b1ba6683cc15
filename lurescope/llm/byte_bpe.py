"""Byte-level BPE ids of distinct words, equal to those of the tokenizers library.

Words of Latin characters are encoded with the rank form of the same vocabulary, which is several
times faster on single words; any other word, and any that may hold a special token, goes through
the tokenizers library itself. Where spaces are cut as in ``arrow_text.spaced_words`` the ids of a
text are the ids of its words.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k"
_CHUNK = 1 << 15


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def rank_encoding(path: str):
    """The vocabulary as a tiktoken encoding without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizers library's form, truncation and padding unused."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def encode_words(vocab: pa.Array, name: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the words in a row, and how many each word has."""
    ranks, full = rank_encoding(vocabulary_path(f"{name}.tiktoken")), tokenizer(vocabulary_path(f"{name}.json"))
    other = pc.match_substring_regex(vocab, "[^\\x00-ɏ]|<\\|").to_numpy(zero_copy_only=False)
    ids, sizes = [], []
    for at in range(0, len(vocab), _CHUNK):
        words = vocab.slice(at, _CHUNK).to_pylist()
        lists = [ranks.encode_ordinary(w) for w in words]
        for i in np.flatnonzero(other[at : at + _CHUNK]):
            lists[i] = full.encode(words[i], add_special_tokens=False).ids
        lengths = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        ids.append(np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(lengths.sum())))
        sizes.append(lengths)
    if not ids:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(sizes)


@lru_cache(maxsize=1)
def id_pieces(name: str = VOCABULARY) -> list[tuple[int, bytes]]:
    """Every id and the bytes it stands for; as many rows as the fixed vocabulary has.

    The vocabulary file writes each byte as one printable character; the 188 printable Latin-1
    characters stand for themselves and the others follow from U+0100 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    full = tokenizer(vocabulary_path(f"{name}.json"))
    special = {i: t.content for i, t in full.get_added_tokens_decoder().items()}
    return [
        (i, special[i].encode() if i in special else bytes(byte_of[c] for c in piece))
        for piece, i in full.get_vocab(with_added_tokens=True).items()
    ]

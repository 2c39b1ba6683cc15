"""Language ID by unigrams over subword pieces, with the segmentation summed out.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a word
is the sum over all its segmentations into pieces, worked out by the forward algorithm; a text's is the
product over its words. Piece probabilities are fitted by expectation maximisation on word counts by
language, which Spark aggregates over all learned texts; the expected piece counts of a round are summed
by Spark too, so only one number per piece and language reaches the driver.

Words are runs of letters in lower case; runs over ``LONGEST`` letters are cut there. Letters without a
piece have a small fixed probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lurescope.llm import arrow_text, byte_bpe
from lurescope.session import materialise

VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 2
LONGEST = 24
#: Longest piece looked for, in letters with the word mark.
WIDEST = 16
UNKNOWN_LETTER = 1e-7
UNKNOWN = "und"
#: Probability mass of the piece shares over all languages in each language's shares, in counts.
PRIOR = 100.0
_MARK = "▁"
_TOGETHER = 1 << 13


@lru_cache(maxsize=1)
def pieces(path: str) -> list[str]:
    """The vocabulary's ordinary pieces of letters and the word mark, lower-case ones."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    own = (model.id_to_piece(i) for i in range(n) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return sorted({p for p in own if p == p.lower() and p.lstrip(_MARK).isalpha() and len(p) <= WIDEST})


@lru_cache(maxsize=1)
def _trie(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted edges (node << 32 | letter), the node each leads to, and each node's piece or -1."""
    nodes: dict[str, int] = {"": 0}
    edges: dict[int, int] = {}
    own = pieces(path)
    for piece in own:
        for i, letter in enumerate(piece):
            if piece[: i + 1] not in nodes:
                nodes[piece[: i + 1]] = len(nodes)
            edges[nodes[piece[:i]] << 32 | ord(letter)] = nodes[piece[: i + 1]]
    keys = np.array(sorted(edges), dtype=np.int64)
    number = {p: i for i, p in enumerate(own)}
    ends = np.full(len(nodes), -1, dtype=np.int32)
    for text, node in nodes.items():
        ends[node] = number.get(text, -1)
    return keys, np.array([edges[k] for k in keys.tolist()], dtype=np.int32), ends


@dataclass
class Arcs:
    """Pieces that fit words of one length: ``by_start[s]`` holds (word rows, ends, piece numbers)."""

    n_words: int
    length: int
    by_start: list[list[tuple[np.ndarray, int, np.ndarray]]]


def arcs_of(letters: np.ndarray, path: str) -> Arcs:
    """All pieces that fit in words given as a table of code points."""
    keys, targets, ends = _trie(path)
    n, length = letters.shape
    by_start: list[list] = [[] for _ in range(length)]
    for start in range(length):
        rows, node = np.arange(n), np.zeros(n, dtype=np.int64)
        for end in range(start + 1, min(length, start + WIDEST) + 1):
            wanted = node << 32 | letters[rows, end - 1]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found = keys[at] == wanted
            if end == start + 1:
                # A letter that no piece begins with, or that is no piece: the small fixed probability.
                single = np.full(n, -1, dtype=np.int64)
                single[found] = ends[targets[at[found]]]
                by_start[start].append((np.arange(n), end, single))
                rows, node = rows[found], targets[at[found]].astype(np.int64)
                continue
            rows, node = rows[found], targets[at[found]].astype(np.int64)
            if not len(rows):
                break
            piece = ends[node]
            if (piece >= 0).any():
                by_start[start].append((rows[piece >= 0], end, piece[piece >= 0].astype(np.int64)))
    return Arcs(n, length, by_start)


def forward(arcs: Arcs, shares: np.ndarray) -> np.ndarray:
    """Prefix probabilities [position, word, column]; ``shares`` ends with the unknown letter's row."""
    total = np.zeros((arcs.length + 1, arcs.n_words, shares.shape[1]))
    total[0] = 1.0
    for start, fits in enumerate(arcs.by_start):
        for rows, end, piece in fits:
            total[end][rows] += total[start][rows] * shares[piece]
    return total


def expected_counts(arcs: Arcs, shares: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected piece counts over all segmentations [piece, column]; ``weights`` are word counts by column."""
    before = forward(arcs, shares)
    after = np.zeros_like(before)
    after[arcs.length] = 1.0
    for start in range(arcs.length - 1, -1, -1):
        for rows, end, piece in arcs.by_start[start]:
            after[start][rows] += shares[piece] * after[end][rows]
    scale = weights / np.maximum(before[arcs.length], 1e-300)
    counts = np.zeros_like(shares)
    for start, fits in enumerate(arcs.by_start):
        for rows, end, piece in fits:
            share = before[start][rows] * shares[piece] * after[end][rows] * scale[rows]
            for column in range(shares.shape[1]):
                counts[:, column] += np.bincount(piece % len(shares), share[:, column], minlength=len(shares))
    return counts


def letter_words(texts: pa.Array) -> arrow_text.Words:
    """Runs of letters in lower case."""
    return arrow_text._coded(pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\pL\pM]+"))


def _tables(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, code points) of words of one length each; a long word gives several rows."""
    by_length: dict[int, tuple[list[int], list[str]]] = {}
    for i, word in enumerate(words):
        marked = _MARK + word
        for at in range(0, len(marked), LONGEST):
            part = marked[at : at + LONGEST]
            own = by_length.setdefault(len(part), ([], []))
            own[0].append(i)
            own[1].append(part)
    for length, (numbers, parts) in by_length.items():
        for at in range(0, len(parts), _TOGETHER):
            some = parts[at : at + _TOGETHER]
            points = np.frombuffer("".join(some).encode("utf-32-le"), dtype="<u4").astype(np.int64)
            yield np.array(numbers[at : at + _TOGETHER]), points.reshape(len(some), length)


def word_scores(words: list[str], shares: np.ndarray, path: str) -> np.ndarray:
    """Natural log probability of every word by language, all segmentations summed."""
    out = np.zeros((len(words), shares.shape[1]))
    for numbers, letters in _tables(words):
        arcs = arcs_of(letters, path)
        logs = np.log(np.maximum(forward(arcs, shares)[arcs.length], 1e-300))
        np.add.at(out, numbers, logs)
    return out


@dataclass
class Model:
    languages: list[str]
    shares: np.ndarray
    path: str


def _word_counts(docs: DataFrame, languages: list[str]) -> DataFrame:
    """(word, language number, n) over all of ``docs`` (text, lang)."""
    number = {name: i for i, name in enumerate(languages)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in arrow_text.blocks(batches):
            words = letter_words(arrow_text.plain(block.column("text")))
            lang = np.array([number[x] for x in block.column("lang").to_pylist()], dtype=np.int64)
            pairs = words.codes.astype(np.int64) * len(languages) + lang[words.document_of_word()]
            seen, n = np.unique(pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    words.vocab.take(pa.array(seen // len(languages))),
                    pa.array((seen % len(languages)).astype(np.int32)),
                    pa.array(n.astype(np.int64)),
                ],
                names=["word", "language", "n"],
            )

    return docs.select("text", "lang").mapInArrow(rows, "word string, language int, n long").groupBy("word", "language").agg(F.sum("n").alias("n"))


def _normal(counts: np.ndarray) -> np.ndarray:
    """Shares by language, drawn to the shares over all languages; the last row is the unknown letter's."""
    total = counts[:-1].sum(axis=1, keepdims=True) + 1e-3
    shares = counts[:-1] + PRIOR * total / total.sum()
    shares = (1.0 - UNKNOWN_LETTER) * shares / shares.sum(axis=0)
    return np.concatenate([shares, np.full((1, counts.shape[1]), UNKNOWN_LETTER)])


def fit(docs: DataFrame, rounds: int = ROUNDS, path: str | None = None) -> Model:
    """A model from the texts of ``docs`` (text, lang) whose lang is not null.

    Null and empty texts teach nothing; the languages are the values of lang, in order. The driver holds
    one share per piece of the vocabulary and language.
    """
    path = path or byte_bpe.vocabulary_path(VOCABULARY)
    learned = docs.where("lang is not null")
    languages = sorted(r["lang"] for r in learned.select("lang").distinct().collect())
    size = len(pieces(path)) + 1
    shares = _normal(np.ones((size, len(languages))))
    if not languages:
        return Model([], shares, path)
    words = materialise(_word_counts(learned, languages), "word-counts")
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(shares)

        def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            counts = np.zeros_like(own)
            for batch in batches:
                language = batch.column("language").to_numpy()
                n = batch.column("n").to_numpy()
                texts = batch.column("word").to_pylist()
                for column in np.unique(language):
                    mine = np.flatnonzero(language == column)
                    for numbers, letters in _tables([texts[i] for i in mine]):
                        weights = n[mine][numbers].astype(float)[:, None]
                        some = expected_counts(arcs_of(letters, path), own[:, [column]], weights)
                        counts[:, column] += some[:, 0]
            piece, column = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(piece.astype(np.int32)), pa.array(column.astype(np.int32)), pa.array(counts[piece, column])],
                names=["piece", "language", "n"],
            )

        # One row per piece and language, a bounded number.
        sums = words.mapInArrow(expected, "piece int, language int, n double").groupBy("piece", "language").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros((size, len(languages)))
        counts[sums["piece"].to_numpy(), sums["language"].to_numpy()] = sums["n"].to_numpy()
        shares = _normal(counts)
    return Model(languages, shares, path)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, the prediction's posterior under equal priors.

    A null text, or one without letters, gets ``und`` and 0; so does every text if no language was
    learned. All other columns and rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    path = model.path

    @F.arrow_udf("struct<lang_pred:string,lang_score:double>")
    def predicted(texts: pa.Array) -> pa.Array:
        own = shared.value
        names, scores = [], []
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        for block in arrow_text.blocks(iter([batch])):
            words = letter_words(arrow_text.plain(block.column("text")))
            if not own.languages:
                names += [UNKNOWN] * len(words)
                scores += [0.0] * len(words)
                continue
            logs = word_scores(words.vocab.to_pylist(), own.shares, path)
            of = words.document_of_word()
            letters = pc.match_substring_regex(words.vocab, r"\pL").to_numpy(zero_copy_only=False)
            total = np.stack(
                [np.bincount(of, logs[words.codes, c] if len(of) else None, minlength=len(words)) for c in range(len(own.languages))],
                axis=1,
            )
            best = total.argmax(axis=1)
            posterior = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            some = np.bincount(of, letters[words.codes] if len(of) else None, minlength=len(words)) > 0
            names += [own.languages[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist())]
            scores += np.where(some, posterior, 0.0).tolist()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "lang_score"])

    # Declared nondeterministic only so that a filter on the result doesn't run the function twice.
    made = docs.withColumn("__lang", predicted.asNondeterministic()(F.col("text")))
    return made.withColumn("lang_pred", F.col("__lang.lang_pred")).withColumn("lang_score", F.col("__lang.lang_score")).drop("__lang")


def may_learn(key: str = "doc_id"):
    """True for the rows whose lang may be learned: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(key).cast("string")) % 3 != 1

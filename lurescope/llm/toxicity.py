"""Toxicity from the nearest labelled examples by exact TF-IDF cosine over a block-max inverted index.

A bounded sample of labelled documents is the example set. Terms are all words of that sample and, for
languages in which a stem's endings vary, the words' first 4 and 6 letters where at least two examples
share them; document frequencies of all terms are counted over all documents. Terms that no example
has can match nothing and have no weight. Examples are laid out in blocks with similar examples side
by side. The postings of the ``HEAD`` terms that most examples have (three quarters of what a text meets)
are dense tables by block, with their maxima; those of all other terms are lists. For a text the lists
are summed first, without pruning; with them the maxima bound what any example of a block can score,
so blocks that cannot enter the text's nearest ``k`` are skipped in the dense tables and the neighbours
are still exact. Neighbours vote by closeness, and a logistic curve fitted on the examples'
votes for each other calibrates them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lurescope.llm import arrow_text, word_exchange

#: Most labelled documents taken as examples, and most characters of their texts together. They bound
#: the index: three terms a word at most, and the dense tables hold EXAMPLES x HEAD weights (34 MB).
EXAMPLES = 4096
EXAMPLE_CHARS = 16 << 20
#: Word beginnings of these lengths are terms too, written with a mark that no word has.
PREFIXES = (4, 6)
_MARK = "^"
#: Terms with dense postings: those in most examples.
HEAD = 1024
NEIGHBOURS = 32
BLOCK = 64
THRESHOLD = 0.3
#: Texts that are compared at once, and postings that are summed at once.
_TOGETHER = 256
_POSTINGS = 1 << 20
#: Bytes of texts that are scored at once.
_SCORED_BYTES = 1 << 20
#: Words of examples whose terms are listed at once.
_ENTRIES = 1 << 16


@dataclass
class Sparse:
    """Rows of weights by term: row i has terms[offsets[i]:offsets[i + 1]]."""

    offsets: np.ndarray
    terms: np.ndarray
    weights: np.ndarray
    n_terms: int

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @staticmethod
    def of(rows: "np.ndarray | Sparse") -> "Sparse":
        if isinstance(rows, Sparse):
            return rows
        row, term = np.nonzero(rows)
        return Sparse(np.searchsorted(row, np.arange(len(rows) + 1)), term, rows[row, term], rows.shape[1])

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.offsets))

    def slice(self, lo: int, hi: int) -> "Sparse":
        a, b = self.offsets[lo], self.offsets[hi]
        return Sparse(self.offsets[lo : hi + 1] - a, self.terms[a:b], self.weights[a:b], self.n_terms)

    def only(self, wanted: np.ndarray) -> "Sparse":
        """The entries that are marked in ``wanted``, as unit rows."""
        row, weights = self.row_of()[wanted], self.weights[wanted]
        norms = np.sqrt(np.bincount(row, weights**2, minlength=len(self)))
        weights /= norms[row]
        return Sparse(np.searchsorted(row, np.arange(len(self) + 1)), self.terms[wanted], weights, self.n_terms)

    def ordered(self, order: np.ndarray) -> "Sparse":
        sizes = np.diff(self.offsets)
        at = arrow_text.gathered(self.offsets[:-1], sizes, order)
        offsets = np.concatenate(([0], np.cumsum(sizes[order])))
        return Sparse(offsets, self.terms[at], self.weights[at], self.n_terms)


def forms(vocab: pa.Array) -> list[pa.Array]:
    """The words, then their marked beginnings by length; null where a word is shorter."""
    sizes = pc.utf8_length(vocab)
    out = [vocab]
    for k in PREFIXES:
        begun = pc.binary_join_element_wise(_MARK, pc.utf8_slice_codeunits(vocab, 0, k), "")
        out.append(pc.if_else(pc.greater_equal(sizes, k), begun, pa.scalar(None, pa.string())))
    return out


def term_numbers(vocab: pa.Array, terms: pa.Array) -> np.ndarray:
    """One row per word: the places of its terms in ``terms``, -1 where there is none."""
    found = pc.index_in(pa.chunked_array(forms(vocab)), value_set=terms).combine_chunks()
    return found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).reshape(1 + len(PREFIXES), -1).T


def summed(document: np.ndarray, own: np.ndarray, counts: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count), sorted, of entries whose terms are the columns of ``own``."""
    n_terms = max(1, n_terms)
    known = own >= 0
    keys = (document[:, None] * n_terms + own)[known]
    order = np.argsort(keys)
    keys, many = keys[order], np.broadcast_to(counts[:, None], own.shape)[known][order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    totals = np.add.reduceat(many, first) if len(first) else many
    return keys[first] // n_terms, keys[first] % n_terms, totals


def term_counts(words: arrow_text.Words, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word or term, count), sorted; ``numbers`` has a column of numbers for each kind of term."""
    size = len(words.vocab)
    tokens = np.sort(words.document_of_word().astype(np.int64) * max(1, size) + words.codes)
    first = np.flatnonzero(np.diff(tokens, prepend=-1))
    pairs, counts = tokens[first], np.diff(first, append=len(tokens))
    own = numbers[pairs % max(1, size)] if size else np.zeros((0, numbers.shape[1]), np.int64)
    return summed(pairs // max(1, size), own, counts, int(numbers.max(initial=-1)) + 1)


def unit_rows(document: np.ndarray, term: np.ndarray, counts: np.ndarray, n: int, idf: np.ndarray) -> Sparse:
    """Unit TF-IDF rows, (1 + ln tf) * idf; empty rows for texts without any term."""
    raw = Sparse(np.searchsorted(document, np.arange(n + 1)), term, (1.0 + np.log(counts)) * idf[term], len(idf))
    return raw.only(np.ones(len(term), dtype=bool))


def vectors(words: arrow_text.Words, terms: pa.Array, idf: np.ndarray) -> Sparse:
    return unit_rows(*term_counts(words, term_numbers(words.vocab, terms)), len(words), idf)


@dataclass
class BlockMaxIndex:
    """Example vectors: ``postings[block, head term, slot]`` with ``maxima[block, head term]``, and for
    each other term t the examples and weights at starts[t] .. starts[t + 1]. ``head`` has a term's place
    among the head terms, -1 for the others."""

    keys: np.ndarray
    targets: np.ndarray
    head: np.ndarray
    postings: np.ndarray
    maxima: np.ndarray
    starts: np.ndarray
    examples: np.ndarray
    weights: np.ndarray

    @staticmethod
    def build(
        keys: np.ndarray, targets: np.ndarray, rows: np.ndarray | Sparse, laid_out: bool = False
    ) -> "BlockMaxIndex":
        """The index of examples, similar ones side by side, or as they come if they are ``laid_out`` already."""
        rows = Sparse.of(rows)
        n_head = min(HEAD, rows.n_terms)
        head = np.full(rows.n_terms, -1, dtype=np.int64)
        frequency = np.bincount(rows.terms, minlength=rows.n_terms)
        head[np.argsort(-frequency, kind="stable")[:n_head]] = np.arange(n_head)
        if not laid_out:
            order = _similar_side_by_side(rows, head, keys)
            keys, targets, rows = keys[order], targets[order], rows.ordered(order)
        postings, tail = np.zeros((-(-len(rows) // BLOCK), n_head, BLOCK)), []
        # Slice by slice, as a worker that lays out its index has little room beside it.
        for lo, hi in arrow_text.slices(rows.offsets, _ENTRIES):
            own = rows.slice(lo, hi)
            row, place = own.row_of() + lo, head[own.terms]
            common = place >= 0
            postings[row[common] // BLOCK, place[common], row[common] % BLOCK] = own.weights[common]
            tail.append((own.terms[~common].astype(np.int32), row[~common].astype(np.int32), own.weights[~common]))
        term, examples, weights = (np.concatenate(c) for c in zip(*tail)) if tail else (np.zeros(0, np.int32),) * 3
        by_term = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[by_term], np.arange(rows.n_terms + 1, dtype=np.int32))
        return BlockMaxIndex(keys, targets, head, postings, postings.max(axis=2), starts, examples[by_term], weights[by_term])

    @property
    def nbytes(self) -> int:
        return sum(v.nbytes for v in vars(self).values())

    def _listed(self, queries: Sparse) -> np.ndarray:
        """What the terms with lists add to the similarity of every query and slot."""
        n = len(self.postings) * BLOCK
        out = np.zeros((len(queries), n))
        sizes = np.diff(self.starts)
        many = np.concatenate(([0], np.cumsum(sizes[queries.terms])))[queries.offsets]
        for lo, hi in arrow_text.slices(many, _POSTINGS):
            own = queries.slice(lo, hi)
            at = arrow_text.gathered(self.starts[:-1], sizes, own.terms)
            each = sizes[own.terms]
            cells = np.repeat(own.row_of().astype(np.int64) * n, each) + self.examples[at]
            sums = np.bincount(cells, np.repeat(own.weights, each) * self.weights[at], minlength=(hi - lo) * n)
            out[lo:hi] = sums.reshape(hi - lo, n)
        return out

    def nearest(self, queries: np.ndarray | Sparse, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and example numbers of the ``k`` nearest of each row; 0 and -1 where there are fewer."""
        queries = Sparse.of(queries)
        parts = [self._nearest(queries.slice(a, min(len(queries), a + _TOGETHER)), k) for a in range(0, len(queries), _TOGETHER)]
        if not parts:
            return np.zeros((0, k)), np.zeros((0, k), np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _nearest(self, queries: Sparse, k: int) -> tuple[np.ndarray, np.ndarray]:
        best = np.zeros((len(queries), k))
        which = np.full((len(queries), k), -1, dtype=np.int64)
        if not len(self.postings):
            return best, which
        dense, listed = _dense(queries, self.head, self.postings.shape[1]), self._listed(queries)
        bounds = dense @ self.maxima.T + listed.reshape(len(queries), -1, BLOCK).max(axis=2)
        bounds *= 1 + 1e-12  # sums differ in their last digits with their order
        first = bounds.argmax(axis=1)

        def visit(block: int, rows: np.ndarray) -> None:
            scores = dense[rows] @ self.postings[block] + listed[rows, block * BLOCK : (block + 1) * BLOCK]
            better = scores.max(axis=1) > best[rows, -1]
            rows, scores = rows[better], scores[better]
            numbers = np.arange(block * BLOCK, (block + 1) * BLOCK)
            pool = np.concatenate([best[rows], scores], axis=1)
            names = np.concatenate([which[rows], np.where(scores > 0, numbers, -1)], axis=1)
            top = np.argsort(-pool, axis=1, kind="stable")[:, :k]
            best[rows] = np.take_along_axis(pool, top, axis=1)
            which[rows] = np.take_along_axis(names, top, axis=1)

        for block in np.unique(first):
            rows = np.flatnonzero((first == block) & (bounds[:, block] > 0))
            if len(rows):
                visit(int(block), rows)
        for block in range(bounds.shape[1]):
            rows = np.flatnonzero((first != block) & (bounds[:, block] > best[:, -1]))
            if len(rows):
                visit(block, rows)
        return best, which

    def nearest_others(self, rows: Sparse, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``nearest`` of the examples themselves, in the order of ``keys``, each without itself.

        A word that only the example itself has would have no weight in a new text, so it has none here.
        """
        shared = np.bincount(rows.terms, minlength=rows.n_terms)[rows.terms] > 1
        similarities, numbers = self.nearest(rows.only(shared), k + 1)
        own = numbers == np.arange(len(self.keys))[:, None]
        own[~own.any(axis=1), -1] = True  # among more equals than k: leave out the last instead
        return similarities[~own].reshape(-1, k), numbers[~own].reshape(-1, k)


def _similar_side_by_side(rows: Sparse, head: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The rows by their three heaviest head terms, so that a block's maxima stay close to its members."""
    row, place = rows.row_of(), head.astype(np.int32)[rows.terms]
    own = np.flatnonzero(place >= 0)
    row, place = row[own], place[own]
    by_weight = np.lexsort((place, -rows.weights[own], row))
    at = np.searchsorted(row[by_weight], np.arange(len(rows) + 1))
    heavy = np.full((3, len(rows)), -1, dtype=np.int64)
    for i in range(3):
        some = at[:-1] + i < at[1:]
        heavy[i, some] = place[by_weight[at[:-1][some] + i]]
    return np.lexsort((keys, *heavy[::-1]))


def _dense(rows: Sparse, head: np.ndarray, n_head: int) -> np.ndarray:
    """The head terms' weights as a table."""
    out = np.zeros((len(rows), n_head))
    place = head[rows.terms]
    out[rows.row_of()[place >= 0], place[place >= 0]] = rows.weights[place >= 0]
    return out


@dataclass
class Model:
    terms: pa.Array
    idf: np.ndarray
    index: BlockMaxIndex
    base_rate: float
    slope: float = 1.0
    shift: float = 0.0
    #: Calibrated scores of the examples, each from the others alone, by the order of ``index.keys``.
    left_out: np.ndarray | None = None
    #: Term counts of the examples, by the order of ``index.keys``.
    counts: Sparse | None = None

    def __getstate__(self) -> dict:
        """What travels to the workers: counts in place of the tables, which each worker lays out itself."""
        state = {k: v for k, v in vars(self).items() if k not in ("terms", "index", "counts")}
        state["terms"] = word_exchange.packed_words(self.terms)
        state["targets"], state["keys"] = self.index.targets, self.index.keys
        own = self.counts
        if own is not None:
            state["counts"] = [word_exchange.packed(v) for v in (own.offsets, own.terms.astype(np.int32), own.weights.astype(np.int32))]
        return state

    def __setstate__(self, state: dict) -> None:
        keys, targets, counts = state.pop("keys"), state.pop("targets"), state.pop("counts", None)
        terms = word_exchange.unpacked_words(state.pop("terms"))
        vars(self).update(state, terms=terms, counts=None)
        rows: np.ndarray | Sparse = np.zeros((0, 0))
        if counts is not None:
            offsets, term, many = map(word_exchange.unpacked, counts)
            weights = np.empty(len(term))
            for lo, hi in arrow_text.slices(offsets, _ENTRIES):
                own = Sparse(offsets, term, many, len(terms)).slice(lo, hi)
                weights[offsets[lo] : offsets[hi]] = unit_rows(own.row_of(), own.terms, own.weights, hi - lo, self.idf).weights
            rows = Sparse(offsets, term, weights, len(terms))
        self.index = BlockMaxIndex.build(keys, targets, rows, laid_out=True)
        del rows, counts
        arrow_text.give_back()

    def threshold(self, loss: float) -> float:
        """The score from which rejecting tells the examples apart best, left out one by one.

        At most the share ``loss`` of the examples without the mark may reach it; among such scores the
        one with the widest margin of caught over lost shares wins, moved halfway to the next score below.
        Infinite without examples of both kinds.
        """
        if self.left_out is None:
            return float("inf")
        order = np.argsort(-self.left_out, kind="stable")
        scores, marked = self.left_out[order], self.index.targets[order] > 0
        caught, lost = np.cumsum(marked) / marked.sum(), np.cumsum(~marked) / (~marked).sum()
        last = np.flatnonzero(np.diff(scores, append=-1.0) < 0)
        allowed = last[lost[last] <= loss]
        if not len(allowed):
            return float("inf")
        best = allowed[np.argmax(caught[allowed] - lost[allowed])]
        below = scores[best + 1] if best + 1 < len(scores) else 0.0
        return float((scores[best] + below) / 2)

    def votes(self, similarities: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Distance-weighted share of positive neighbours, drawn to the base rate as one more vote."""
        targets = np.append(self.index.targets, 0)[numbers]
        weights = np.where(numbers >= 0, 1.0 / (1e-3 + np.maximum(0.0, 1.0 - similarities)), 0.0)
        return ((weights * targets).sum(axis=1) + self.base_rate) / (weights.sum(axis=1) + 1.0)

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(self.slope * _logit(votes) + self.shift)))

    def evaluate(self, texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = []
        for block in arrow_text.blocks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), most=_SCORED_BYTES):
            rows = vectors(arrow_text.alnum_words(arrow_text.plain(block.column("text"))), self.terms, self.idf)
            parts.append(self.index.nearest(rows, k))
            del rows
            arrow_text.give_back()
        similarities, numbers = (np.concatenate(p) for p in zip(*parts))
        return self.votes(similarities, numbers), similarities, numbers


def _logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def fit_logistic(votes: np.ndarray, targets: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the curve from votes to probabilities; the identity without both classes."""
    if len(np.unique(targets)) < 2:
        return 1.0, 0.0
    x, slope, shift = _logit(votes), 1.0, 0.0
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-(slope * x + shift)))
        w = p * (1 - p)
        gradient = np.array([((p - targets) * x).sum() + 0.1 * (slope - 1.0), (p - targets).sum()])
        curve = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(curve, gradient)
        slope, shift = slope - float(step[0]), shift - float(step[1])
    return (slope, shift) if slope > 0 and np.isfinite(slope + shift) else (1.0, 0.0)


def _example_words(docs: DataFrame) -> DataFrame:
    """(doc_id, target, words, counts) with each document's distinct words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in arrow_text.blocks(batches):
            words = arrow_text.alnum_words(arrow_text.plain(block.column("text")))
            document, code, counts = term_counts(words, np.arange(len(words.vocab))[:, None])
            offsets = pa.array(np.searchsorted(document, np.arange(len(words) + 1)).astype(np.int32))
            lists = [words.vocab.take(pa.array(code)), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), block.column("target"), *(pa.ListArray.from_arrays(offsets, v) for v in lists)],
                names=["doc_id", "target", "words", "counts"],
            )

    return docs.mapInArrow(rows, "doc_id long, target int, words array<string>, counts array<long>")


def _document_frequency(docs: DataFrame, terms: pa.Array) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many each term is, over all of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(word_exchange.packed_words(terms))
    n_terms = len(terms)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, sums = word_exchange.unpacked_words(shared.value), 0, np.zeros(n_terms, np.int64)
        for block in arrow_text.blocks(batches):
            words = arrow_text.alnum_words(arrow_text.plain(block.column("text")))
            sums += np.bincount(term_counts(words, term_numbers(words.vocab, known))[1], minlength=n_terms)
            n += len(words)
        found = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(-1, found).astype(np.int32)), pa.array(np.append(n, sums[found]))], names=["term", "n"]
        )

    # One row per term of the examples.
    totals = docs.select("text").mapInArrow(rows, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(n_terms + 1)
    frequency[totals["term"].to_numpy()] = totals["n"].to_numpy()  # -1, the documents, is the last
    return int(frequency[-1]), frequency[:-1]


def _chosen(docs: DataFrame, labelled: DataFrame, examples: int, chars: int) -> DataFrame:
    """(doc_id, target, text) of the examples: at most ``examples`` documents and ``chars`` characters.

    Candidates come in the order of a hash of doc_id; one whose text no longer fits is left out.
    """
    spark = docs.sparkSession
    schema = "doc_id long, target int"
    clean = labelled.where("doc_id is not null and target is not null").groupBy("doc_id").agg(F.max("target").cast("int").alias("target"))
    # Both lists are bounded by ``examples``.
    drawn = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples).toArrow()
    own = docs.select("doc_id", "text").join(F.broadcast(spark.createDataFrame(drawn, schema)), "doc_id")
    texts = own.groupBy("doc_id", "target").agg(F.min("text").alias("text"))
    sizes = {r["doc_id"]: r["n"] for r in texts.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).collect()}
    kept, room = [], chars
    for key, target in zip(drawn["doc_id"].to_pylist(), drawn["target"].to_pylist()):
        if sizes.get(key, 0) <= room:
            room -= sizes.get(key, 0)
            kept.append((key, target))
    chosen = spark.createDataFrame(kept, schema)
    known = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return known.groupBy("doc_id", "target").agg(F.min("text").alias("text"))


def fit(
    docs: DataFrame,
    labelled: DataFrame,
    examples: int = EXAMPLES,
    neighbours: int = NEIGHBOURS,
    chars: int = EXAMPLE_CHARS,
) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labelled`` (doc_id, target 0 or 1).

    ``examples`` and ``chars`` bound the labelled documents used. Which are taken depends on a hash of
    doc_id; of several labels of a document the highest counts, null ones don't; of several texts of a
    doc_id the smallest. Without usable labels of both kinds every score is the base rate, 0 if there is none.
    """
    texts = _chosen(docs, labelled, examples, chars)
    # At most as many rows as examples, of one entry per distinct word; their characters are bounded too.
    made = _example_words(texts).orderBy("doc_id").toArrow().combine_chunks()
    targets = made["target"].to_numpy().astype(float)
    n, positive = len(targets), int(targets.sum())
    rate = positive / n if n else 0.0
    none = Model(pa.array([], pa.string()), np.zeros(0), BlockMaxIndex.build(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 0))), rate)
    if not 0 < positive < n:
        return none
    words = pa.chunked_array([c.flatten() for c in made["words"].chunks], pa.string()).combine_chunks().dictionary_encode()
    if not len(words):
        return none
    coded = pa.chunked_array(forms(words.dictionary)).combine_chunks().dictionary_encode()
    numbers = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = numbers.reshape(1 + len(PREFIXES), -1).T
    counts = pa.chunked_array([c.flatten() for c in made["counts"].chunks], pa.int64()).to_numpy()
    sizes = pc.list_value_length(made["words"]).to_numpy()
    ends, parts = np.concatenate(([0], np.cumsum(sizes))), []
    for lo, hi in arrow_text.slices(ends, _ENTRIES):
        own = slice(ends[lo], ends[hi])
        document = np.repeat(np.arange(lo, hi), sizes[lo:hi])
        part = summed(document, numbers[words.indices.to_numpy()[own]], counts[own], len(coded.dictionary))
        parts.append([column.astype(np.int32) for column in part])
    document, term, counts = (np.concatenate(column) for column in zip(*parts))
    # Words first, so their numbers are those below the dictionary's size; a beginning needs two examples.
    shared = np.bincount(term, minlength=len(coded.dictionary)) > 1
    shared[: len(words.dictionary)] = True
    number = np.cumsum(shared) - 1
    own = shared[term]
    document, term, counts = document[own], number[term[own]].astype(np.int32), counts[own]
    terms = coded.dictionary.filter(pa.array(shared))
    total, frequency = _document_frequency(docs, terms)
    idf = np.log((total + 1.0) / (frequency + 1.0)) + 1e-3
    del words, numbers, coded, parts, own  # the driver keeps counts, rows and the index
    rows = unit_rows(document, term, counts, made.num_rows, idf)
    index = BlockMaxIndex.build(made["doc_id"].to_numpy(), targets, rows)
    raw = Sparse(rows.offsets, term, counts, len(terms)).ordered(np.searchsorted(made["doc_id"].to_numpy(), index.keys))
    model = Model(terms, idf, index, rate, counts=raw)
    del rows, made, document, term, counts
    own = unit_rows(raw.row_of(), raw.terms, raw.weights, len(raw), idf)
    votes = model.votes(*index.nearest_others(own, neighbours))
    model.slope, model.shift = fit_logistic(votes, index.targets)
    model.left_out = model.calibrated(votes)
    return model


def score(
    docs: DataFrame,
    model: Model,
    neighbours: int = NEIGHBOURS,
    evidence: int = 3,
    into: tuple[str, str] = ("toxicity", "evidence"),
) -> DataFrame:
    """``docs`` with ``toxicity`` (calibrated, 0 to 1) and ``evidence``: the nearest examples.

    A text without any term of the examples, such as an empty or null one, gets the calibrated base rate
    and no evidence; an empty table gives no rows. Repeated rows score alike. All other columns stay; one
    that has a name of ``into`` already is replaced.
    """
    taken = arrow_text.free_name(docs, "scored")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "struct<toxicity:double,evidence:array<struct<doc_id:long,similarity:double,target:int>>>"

    @F.arrow_udf(kind)
    def evaluated(texts: pa.Array) -> pa.Array:
        own = shared.value
        votes, near, numbers = np.zeros(0), np.zeros((0, neighbours)), np.zeros((0, neighbours), np.int64)
        if len(own.index.keys) and len(texts):
            votes, near, numbers = own.evaluate(texts, neighbours)
        elif len(texts):
            votes = np.full(len(texts), own.base_rate)
            near, numbers = np.zeros((len(texts), 1)), np.full((len(texts), 1), -1)
        near, numbers = near[:, :evidence], numbers[:, :evidence]
        flat = numbers[numbers >= 0]
        items = pa.StructArray.from_arrays(
            [
                pa.array(own.index.keys[flat] if len(flat) else flat, pa.int64()),
                pa.array(near[numbers >= 0], pa.float64()),
                pa.array(own.index.targets[flat] if len(flat) else flat).cast(pa.int32()),
            ],
            names=["doc_id", "similarity", "target"],
        )
        offsets = np.concatenate(([0], np.cumsum((numbers >= 0).sum(axis=1)))).astype(np.int32)
        scores = own.calibrated(votes) if len(own.index.keys) else votes
        return pa.StructArray.from_arrays(
            [pa.array(scores, pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), items)],
            names=["toxicity", "evidence"],
        )

    scored = docs.withColumn(taken, evaluated(F.col("text")))
    return scored.withColumns({n: F.col(taken)[f] for n, f in zip(into, ("toxicity", "evidence"))}).drop(taken)


def may_learn(key: str = "doc_id"):
    """True for the rows whose labels may be learned: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.col(key).cast("string")) % 4 != 2


def fit_on_labels(docs: DataFrame, labels: DataFrame) -> Model:
    """``fit`` with the ``toxic`` marks of ``labels`` that may be learned."""
    return fit(docs, labels.where(may_learn()).select("doc_id", F.col("toxic").alias("target")))

"""Brown class-based bigram model: exchange clustering of all words, smoothed scores and perplexity.

A text is its words and one end, and every distinct word of the training texts belongs to a class of its
own choosing; the end keeps a class to itself. Clustering is distributed exchange (Uszkoreit and Brants,
2008): Spark counts, for every word, the classes of the words before and after it; every word then goes
to the class that raises the class bigram likelihood most, in parallel tasks that each hold a part of the
words and the table of classes, whose own moves change their copy of it. The counts are renewed and the
next sweep begins, until one raises the likelihood by less than ``RISE`` a token; the best sweep's classes
are kept. Only the table of classes and one of word endings by class reach the driver, whatever the corpus.

A word's probability is P(class | class before) * P(word | class). Class transitions are Witten-Bell
smoothed towards class shares; emissions add ``ADD`` to every count and keep a place for unseen words,
one in each class, so the probabilities of all words and of the unseen ones of each class sum to one. A
word that the training texts lack has the class of most training words with its last three characters
(of one of ``ENDINGS`` hashes of them).

The texts are read once and stored as word numbers. Every distinct word meets in one bucket, see
``word_exchange``: a bucket holds the words' counts and classes, answers every block of texts with the
classes of its words, and gets the block's counts by class back.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from lurescope.llm import arrow_text, word_exchange
from lurescope.llm.arrow_text import Words
from lurescope.llm.word_exchange import packed, unpacked
from lurescope.session import materialise, remove_stage, scratch_path

CLASSES = 64
ENDINGS = 1024
#: Natural log likelihood a training token that a sweep must bring for another one to follow.
RISE = 0.01
ADD = 0.1
FOLDS = 10
#: The end of a text has a class of its own and is the word before a text's first.
END_CLASS = 0
#: Counts by class looked at together in a sweep.
_TOGETHER = 1 << 14
#: Counts up to this look up what they change.
_SMALL = 8
#: Cells of a table of sums that travel together.
_SLICE = 2048


def held_out(key: int | None) -> bool:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 10, is 0."""
    return key is not None and zlib.crc32(str(key).encode()) % FOLDS == 0


def _training(keys: np.ndarray) -> np.ndarray:
    return np.array([not held_out(None if k == word_exchange.NO_KEY else k) for k in keys.tolist()], dtype=bool)


CODED = "block long, bucket int, words binary, weights binary, doc_id binary, offsets binary, codes binary"
#: A bucket: its blocks with the places of their words, and by word the training count, ending and class.
STATE = "bucket int, blocks array<long>, places array<binary>, counts binary, endings binary, classes binary"
ANSWERS = "block long, bucket int, classes binary, counts binary"
SENT = "block long, bucket int, keys binary, n binary"


def _coded(docs: DataFrame, n: int) -> DataFrame:
    """Blocks of texts as word numbers (bucket null), and each block's distinct words by bucket."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in word_exchange.exchange_blocks(batches):
            name, words, begins = word_exchange.numbered(block, arrow_text.lower_words, n)
            keys = word_exchange.keys_of(block)
            own = _training(keys)[words.document_of_word()]
            weights = np.bincount(words.codes[own], minlength=len(words.vocab)).astype(np.int64)
            full = np.flatnonzero(np.diff(begins))
            asked = [slice(begins[b], begins[b + 1]) for b in full]
            none, kind = [None] * len(full), pa.binary()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(full) + 1, name, np.int64)),
                    pa.array([*full.tolist(), None], pa.int32()),
                    pa.array([*(word_exchange.packed_words(words.vocab.slice(s.start, s.stop - s.start)) for s in asked), None], kind),
                    pa.array([*(packed(weights[s]) for s in asked), None], kind),
                    *(pa.array([*none, packed(part)], kind) for part in (keys, words.offsets, words.codes)),
                ],
                names=[c.split()[0] for c in CODED.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(rows, CODED)


def endings_of(words: pa.Array) -> np.ndarray:
    """The hash, below ``ENDINGS``, of each word's last three characters."""
    coded = pc.utf8_slice_codeunits(words, -3).dictionary_encode()
    hashed = [xxhash.xxh64_intdigest(e) % ENDINGS for e in coded.dictionary.to_pylist()]
    return np.array(hashed, dtype=np.int16)[coded.indices.to_numpy(zero_copy_only=False)]


def _opened(classes: int):
    """A bucket's first state: training words by ending, others ``classes`` + ending."""

    def opened(table: pa.Table) -> pa.Table:
        vocab, places = word_exchange.distinct_words(table)
        counts = np.zeros(len(vocab), dtype=np.int64)
        for own, weights in zip(places, table.column("weights")):
            counts[own] += unpacked(weights.as_py())
        endings = endings_of(vocab)
        first = np.where(counts > 0, 1 + endings % (classes - 1), classes + endings).astype(np.int16)
        # Copies of a block ask alike, once is enough.
        own = dict(zip(table.column("block").to_pylist(), places))
        parts = (packed(v) for v in (counts, endings, first))
        return _state(table.column("bucket")[0].as_py(), list(own), [packed(p) for p in own.values()], *parts)

    return opened


def _state(bucket: int, blocks: list[int], places: list[bytes], counts: bytes, endings: bytes, classes: bytes) -> pa.Table:
    return pa.table(
        {
            "bucket": pa.array([bucket], pa.int32()),
            "blocks": pa.array([blocks], pa.list_(pa.int64())),
            "places": pa.array([places], pa.list_(pa.binary())),
            **{n: pa.array([v], pa.binary()) for n, v in (("counts", counts), ("endings", endings), ("classes", classes))},
        }
    )


def _answers(state: DataFrame) -> DataFrame:
    """For each block and bucket the classes and counts of the block's words, in the order it asked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                classes, counts = unpacked(row["classes"]), unpacked(row["counts"])
                own = [unpacked(p) for p in row["places"]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["blocks"], pa.int64()),
                        pa.array([row["bucket"]] * len(own), pa.int32()),
                        pa.array([packed(classes[p]) for p in own], pa.binary()),
                        pa.array([packed(counts[p]) for p in own], pa.binary()),
                    ],
                    names=["block", "bucket", "classes", "counts"],
                )

    return state.select("bucket", "blocks", "places", "counts", "classes").mapInArrow(rows, ANSWERS)


def _with_ends(words: Words, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens, ends included; where the words are among them; the document of each word."""
    document = words.document_of_word()
    tokens = np.full(len(words.codes) + len(words), END_CLASS, dtype=classes.dtype)
    places = np.arange(len(words.codes)) + document
    tokens[places] = classes[words.codes] if len(words.codes) else 0
    return tokens, places, document


def _before(values: np.ndarray) -> np.ndarray:
    """Each token's predecessor; a text follows an end, and every text ends with one."""
    return np.concatenate((np.array([END_CLASS], dtype=values.dtype), values[:-1]))


def _in_order(answers: pa.Table) -> dict[int, dict]:
    return {row["bucket"]: row for row in sorted(answers.to_pylist(), key=lambda r: r["bucket"])}


def _sent(classes: int):
    """A block's counts of each training word with the class before (even side) and after it, by bucket.

    A key is (place of the word in the bucket's answer * 2 + side) * classes + class.
    """

    def sent(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple[int, int, bytes, bytes]] = []
        asked = _in_order(right)
        parts = [unpacked(a["classes"]) for a in asked.values()]
        begins = np.cumsum([0, *map(len, parts)]) * 2 * classes
        # Four bytes a key, if they fit, sort in half the time.
        kind = np.int32 if begins[-1] < 1 << 31 else np.int64
        own_classes = np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        for row in left.to_pylist():
            words = Words(unpacked(row["offsets"]), unpacked(row["codes"]), None)
            if not len(words.codes):
                continue
            tokens, places, document = _with_ends(words, own_classes)
            learned = _training(unpacked(row["doc_id"]))[document]
            at, codes = places[learned], words.codes[learned].astype(kind) * (2 * classes)
            keys, n = np.unique(np.concatenate((codes + _before(tokens)[at], codes + classes + tokens[at + 1])), return_counts=True)
            cuts = np.searchsorted(keys, begins.astype(kind))
            for i, bucket in enumerate(asked):
                some = slice(cuts[i], cuts[i + 1])
                if some.start < some.stop:
                    # As steps, which are small numbers.
                    steps = np.diff(keys[some], prepend=begins[i]).astype(np.int32)
                    rows.append((row["block"], bucket, packed(steps), packed(n[some].astype(np.int32))))
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table({c: pa.array(list(v), k) for c, v, k in zip(("block", "bucket", "keys", "n"), columns, kinds)})

    return sent


def _narrow(values: np.ndarray) -> np.ndarray:
    """Numbers from zero on in four bytes, if they fit."""
    return values.astype(np.int32) if not len(values) or values.max() < 1 << 31 else values


def _gathered(classes: int):
    """A bucket's counts by word and class, summed over the blocks, beside its state and class table."""

    def gathered(left: pa.Table, right: pa.Table) -> pa.Table:
        state = left.to_pylist()[0]
        places = dict(zip(state["blocks"], state["places"]))
        keys, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(right.num_rows):
            own = unpacked(places[right.column("block")[i].as_py()]).astype(np.int64)
            word, rest = np.divmod(np.cumsum(unpacked(right.column("keys")[i].as_py()).astype(np.int64)), 2 * classes)
            keys.append(own[word] * 2 * classes + rest)
            n.append(unpacked(right.column("n")[i].as_py()).astype(np.int64))
        every, number = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(number, np.concatenate(n), minlength=len(every)).astype(np.int64)
        word, side, other = every // (2 * classes), every // classes % 2, every % classes
        mine = unpacked(state["classes"])[word].astype(np.int64)
        # Pairs are counted with the word that comes first, or with the second after an end.
        used = (side == 1) | (other == END_CLASS)
        cell = np.where(side == 1, mine * classes + other, other * classes + mine)[used]
        table = np.bincount(cell, total[used], minlength=classes * classes).astype(np.int64)
        more = {"keys": packed(_narrow(np.diff(every, prepend=0))), "n": packed(_narrow(total)), "pairs": packed(table)}
        return pa.table({**{c: left.column(c) for c in left.column_names}, **{c: pa.array([v], pa.binary()) for c, v in more.items()}})

    return gathered


def _weigh(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1e-300))


def likelihood(table: np.ndarray) -> float:
    """Log likelihood of class bigrams up to a part that no class changes, in natural logarithms a token."""
    whole = _weigh(table).sum() - _weigh(table.sum(axis=0)).sum() - _weigh(table.sum(axis=1)).sum()
    return float(whole / max(1.0, table.sum()))


def _filled(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the cells other than zero; quicker than ``nonzero`` on two dimensions."""
    return np.divmod(np.flatnonzero(table.ravel() != 0), table.shape[1])


def _own_change(whole: np.ndarray, part: np.ndarray) -> np.ndarray:
    """What ``part`` changes where it is a part of ``whole`` already."""
    old = np.maximum(whole - part, 0.0)
    return _weigh(old + part) - _weigh(old)


def _changes(
    pairs: np.ndarray, after: np.ndarray, other: np.ndarray, count: np.ndarray, of: np.ndarray, here: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """What each count changes in the pairs with each class, as rows of a table and the row of each count.

    Small counts, nearly all, share rows. A count with a word's own class does without the pairs of the
    word's other side. The class itself is left out, its pairs lie on the diagonal.
    """
    classes, each = pairs.shape[1], np.arange(pairs.shape[1])
    weighed, small = _weigh(pairs), int(min(_SMALL, count.max()))
    shared = _weigh(pairs + np.arange(1.0, small + 1)[:, None, None, None]) - weighed
    shared[:, :, each, each] = 0.0
    line = (np.minimum(count, small).astype(np.int64) - 1) * 2 * classes + after * classes + other
    many = np.flatnonzero(count > small)
    large = _weigh(pairs[after[many], other[many]] + count[many, None]) - weighed[after[many], other[many]]
    large[np.arange(len(many)), other[many]] = 0.0
    line[many] = shared.size // classes + np.arange(len(many))
    changes = np.concatenate((shared.reshape(-1, classes), large))
    mine = np.flatnonzero(other == here[of])
    sides = np.bincount((of * 2 + after) * classes + other, count, minlength=2 * len(here) * classes).reshape(len(here), 2, classes)
    less = sides[of[mine], 1 - after[mine]]
    less[np.arange(len(mine)), other[mine]] = 0.0
    own, (row, column) = changes[line[mine]], _filled(less)
    of_row = mine[row]
    old = np.maximum(pairs[after[of_row], other[of_row], column] - less[row, column], 0.0)
    own[row, column] = _weigh(old + count[of_row]) - _weigh(old)
    line[mine] = len(changes) + np.arange(len(mine))
    return np.concatenate((changes, own)), line


def exchanged(own: np.ndarray, keys: np.ndarray, n: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Classes of words after each moved to its best one, from their counts by class and side.

    ``keys`` rise and are (word * 2 + side) * classes + class, ``table`` are the pairs of classes of the
    whole corpus. The most frequent words go first, ties by number; words looked at together see the same
    table, and the classes of the words beside them (a word itself among them) stay as they were counted.
    """
    classes = len(table)
    own, table = own.astype(np.int64), table.astype(float)
    word = keys // (2 * classes)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    sizes = np.diff(np.append(starts, len(word)))
    seen = word[starts]
    tokens = np.add.reduceat(np.where(keys // classes % 2 == 1, n, 0), starts) if len(starts) else starts
    order = np.argsort(-tokens, kind="stable")
    ends = np.cumsum(sizes[order])
    at = 0
    while at < len(order):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TOGETHER, side="right")))
        some = order[at:to]
        # Longest first, so that the words which have a further count stand in front.
        some = some[np.argsort(-sizes[some], kind="stable")]
        at = to
        rows = arrow_text.gathered(starts, sizes, some)
        of = np.repeat(np.arange(len(some)), sizes[some])
        here = own[seen[some]]
        after, other, count = keys[rows] // classes % 2, keys[rows] % classes, n[rows].astype(float)
        # Pairs with each class in the word's place, without the word's own.
        pairs = np.stack((table, table.T))
        changes, line = _changes(pairs, after, other, count, of, here)
        gain = np.zeros((len(some), classes))
        begins, longest = np.append(0, np.cumsum(sizes[some])[:-1]), -sizes[some]
        for i in range(-longest[0]):
            having = int(np.searchsorted(longest, -i))
            gain[:having] += changes[line[begins[:having] + i]]
        # A word's own class is without the word, beside it too.
        alone = np.where(other == here[of], 0.0, _own_change(pairs[after, other, here[of]], count))
        stay = np.bincount(of, alone, minlength=len(some))
        # A class followed by itself takes the pairs of both sides; the margins take the word's tokens.
        total, lines = tokens[some].astype(float), np.arange(len(some))
        beside = np.bincount(of * classes + other, count, minlength=gain.size).reshape(gain.shape)
        cells, loops = _filled(beside), table.diagonal()
        gain[cells] += _weigh(loops[cells[1]] + beside[cells]) - _weigh(loops[cells[1]])
        stay += _own_change(loops[here], beside[lines, here])
        different, number = np.unique(total, return_inverse=True)
        for line in (table.sum(axis=1), table.sum(axis=0)):
            gain -= (_weigh(line + different[:, None]) - _weigh(line))[number]
            stay -= _own_change(line[here], total)
        gain[lines, here] = stay
        gain[:, END_CLASS] = -np.inf
        there = np.where(gain.max(axis=1) > stay + 1e-9 * np.maximum(1.0, np.abs(stay)), gain.argmax(axis=1), here)
        own[seen[some]] = there
        moved = (there != here)[of]
        for classes_of, sign in ((here, -1.0), (there, 1.0)):
            mine, next_to = classes_of[of[moved]], other[moved]
            cell = np.where(after[moved] == 1, mine * classes + next_to, next_to * classes + mine)
            table += sign * np.bincount(cell, count[moved], minlength=classes * classes).reshape(classes, classes)
        np.maximum(table, 0.0, out=table)
    return own.astype(np.int16)


def _moved(gathered: DataFrame, table: np.ndarray) -> DataFrame:
    """The buckets' states after a sweep."""
    shared = gathered.sparkSession.sparkContext.broadcast(table)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, n = (unpacked(row[c]).astype(np.int64) for c in ("keys", "n"))
                own = exchanged(unpacked(row["classes"]), np.cumsum(keys), n, shared.value)
                yield from _state(row["bucket"], row["blocks"], row["places"], row["counts"], row["endings"], packed(own)).to_batches()

    return gathered.mapInArrow(rows, STATE)


_SLICED = "slice int, n binary"


def _task_sums(rows: DataFrame, make, cells: int) -> DataFrame:
    """The sums of each task's arrays in slices; the rows made follow the tasks, not the cells that are filled."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                values = make(row).astype(np.int64)
                total = values if total is None else total + values
        if total is not None:
            slices = [total[at : at + _SLICE].tobytes() for at in range(0, cells, _SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(slices)), pa.int32()), pa.array(slices, pa.binary())], names=["slice", "n"])

    return rows.mapInArrow(added, _SLICED)


def _sums(rows: DataFrame, make, cells: int) -> np.ndarray:
    """Arrays of ``cells`` numbers, one of each row, added up by Spark."""

    def added(own: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(n, dtype=np.int64) for n in own["n"].to_pylist())
        return pa.table({"slice": own["slice"].slice(0, 1), "n": pa.array([total.tobytes()], pa.binary())})

    out = np.zeros(cells)
    found = _task_sums(rows, make, cells).groupBy("slice").applyInArrow(added, _SLICED).toArrow()
    for row in found.to_pylist():
        own = np.frombuffer(row["n"], dtype=np.int64)
        out[row["slice"] * _SLICE :][: len(own)] = own
    return out


@dataclass
class Model:
    """Everything but the words' counts and classes: class of each ending, and the smoothed class tables."""

    tokens: int
    types: int
    ends: int
    class_of_ending: np.ndarray
    transitions: np.ndarray
    class_tokens: np.ndarray
    class_types: np.ndarray
    #: Likelihood before the first sweep and after each.
    likelihoods: list[float]

    def emission(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return (counts + ADD) / (self.class_tokens[classes] + ADD * (self.class_types[classes] + 1))


def _transitions(table: np.ndarray) -> np.ndarray:
    """P(class | class before), Witten-Bell smoothed towards the classes' shares."""
    share = (table.sum(axis=0) + ADD) / (table.sum() + ADD * len(table))
    kinds = np.maximum((table > 0).sum(axis=1), 1)
    return (table + kinds[:, None] * share) / (table.sum(axis=1) + kinds)[:, None]


@dataclass
class Fitted:
    model: Model
    texts: DataFrame
    state: DataFrame


def fit(docs: DataFrame, classes: int = CLASSES, rise: float = RISE) -> Fitted:
    """The model of the training documents, with the stored texts and words for ``score``.

    ``docs`` has doc_id and text; null texts are empty ones; a null doc_id is a training document. The
    driver holds tables of classes by classes and of endings by classes.
    """
    spark = docs.sparkSession
    n = word_exchange.buckets_for(docs)
    # A bucketed table, so that no sweep shuffles the texts; the name is needed only while the plans are made.
    name = f"brown_{uuid.uuid4().hex}"
    _coded(docs, n).write.option("path", scratch_path(spark, "coded")).bucketBy(n, "block").saveAsTable(name)
    coded = spark.table(name)
    texts = coded.where("bucket is null").select("block", "doc_id", "offsets", "codes")
    asked = coded.where("bucket is not null").select("block", "bucket", "words", "weights")
    state = materialise(asked.groupBy("bucket").applyInArrow(_opened(classes), STATE), "words")
    trains = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0, F.lit(True))
    ends = docs.where(trains).count()
    best: tuple[float, DataFrame, np.ndarray] | None = None
    likelihoods: list[float] = []
    while True:
        sent = texts.groupBy("block").cogroup(_answers(state).groupBy("block")).applyInArrow(_sent(classes), SENT)
        # As many tasks as buckets: the packed rows are small, the work in them is not.
        both = state.repartition(n, "bucket").groupBy("bucket").cogroup(sent.repartition(n, "bucket").groupBy("bucket"))
        path = scratch_path(spark, "class-counts")
        schema = f"{STATE}, keys binary, n binary, pairs binary"
        both.applyInArrow(_gathered(classes), schema).write.parquet(path)
        gathered = spark.read.schema(schema).parquet(path)
        table = _sums(gathered.select("pairs"), lambda row: unpacked(row["pairs"]), classes * classes).reshape(classes, classes)
        table[END_CLASS, END_CLASS] = ends - table[:, END_CLASS].sum()
        likelihoods.append(likelihood(table))
        before = best
        if best is None or likelihoods[-1] > best[0]:
            best = likelihoods[-1], state, table
        if before is not None and likelihoods[-1] < before[0] + rise:
            break
        state = materialise(_moved(gathered, table), "words")
        remove_stage(spark, path)
    remove_stage(spark, path)
    spark.sql(f"DROP TABLE {name}")
    _, state, table = best

    def types(row: dict) -> np.ndarray:
        own = unpacked(row["classes"]).astype(np.int64)
        some = own < classes
        return np.bincount(unpacked(row["endings"])[some].astype(np.int64) * classes + own[some], minlength=ENDINGS * classes)

    by_ending = _sums(state.select("endings", "classes"), types, ENDINGS * classes).reshape(ENDINGS, classes)
    of_all = by_ending.sum(axis=0)
    common = np.where(by_ending.sum(axis=1) > 0, by_ending.argmax(axis=1), of_all.argmax() if of_all.any() else 1)
    class_types = of_all.copy()
    class_types[END_CLASS] = float(ends > 0)
    model = Model(
        int(table.sum()), int(class_types.sum()), ends, common, _transitions(table), table.sum(axis=0), class_types, likelihoods
    )
    return Fitted(model, texts, state)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(fitted: Fitted) -> DataFrame:
    """Per document: tokens, known tokens, unigram base and model log10 probability, and perplexity.

    A null or empty text is an end alone. Repeated rows score alike and stay; an empty table gives no rows.
    """
    shared = fitted.state.sparkSession.sparkContext.broadcast(fitted.model)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        own = shared.value
        answers = _in_order(right).values()
        counts = np.concatenate([np.zeros(0, np.int64), *(unpacked(a["counts"]) for a in answers)])
        classes = np.concatenate([np.zeros(0, np.int64), *(unpacked(a["classes"]) for a in answers)]).astype(np.int64)
        unseen = classes >= len(own.transitions)
        classes[unseen] = own.class_of_ending[classes[unseen] - len(own.transitions)]
        out = []
        for row in left.to_pylist():
            keys, words = unpacked(row["doc_id"]), Words(unpacked(row["offsets"]), unpacked(row["codes"]), None)
            tokens, places, _ = _with_ends(words, classes)
            document = np.repeat(np.arange(len(words)), words.lengths + 1)
            seen = np.full(len(tokens), own.ends, dtype=np.int64)
            seen[places] = counts[words.codes] if len(words.codes) else 0
            base = np.log10((seen + ADD) / (own.tokens + ADD * (own.types + 1)))
            logs = np.log10(own.transitions[_before(tokens), tokens] * own.emission(seen, tokens))
            add = lambda v: np.bincount(document, v, minlength=len(words))
            sizes, total = words.lengths + 1, add(logs)
            columns = [
                word_exchange.key_column(keys),
                pa.array(~_training(keys)),
                pa.array(sizes, pa.int64()),
                pa.array(add(seen > 0).astype(np.int64)),
                pa.array(np.full(len(words), own.tokens, np.int64)),
                pa.array(add(base)),
                pa.array(total),
                pa.array(np.power(10.0, -total / sizes)),
            ]
            out.append(pa.table(dict(zip([c.split()[0] for c in SCORES.split(", ")], columns))))
        return pa.concat_tables(out)

    return fitted.texts.groupBy("block").cogroup(_answers(fitted.state).groupBy("block")).applyInArrow(scored, SCORES)


def fit_and_score(docs: DataFrame, **options) -> DataFrame:
    """Fit on the training documents of ``docs`` and score all of them."""
    return score(fit(docs, **options))

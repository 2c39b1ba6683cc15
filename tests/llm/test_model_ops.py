"""Scores, searches and scans against plain Python or held-out accuracy."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lurescope.llm import brown, language, licenses, maxscore, toxicity, word_exchange


def by_key(frame):
    return {r["doc_id"]: r for r in frame.collect()}


# --- Brown -------------------------------------------------------------------------------------------


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def test_brown_base_counts(documents, odd):
    rows = [r for r in odd if r[0] is not None] + [(i, f"the cat sat on mat {i % 7} dog") for i in range(100, 160)]
    found = {}
    for r in brown.fit_and_score(documents(rows)).collect():
        found.setdefault(r["doc_id"], []).append(r)
    kept = lambda key: zlib.crc32(str(key).encode()) % 10 != 0
    counts = Counter(t for key, text in rows if kept(key) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    assert sum(map(len, found.values())) == len(rows)
    for key, text in rows:
        for r in found[key]:
            own = tokens(text)
            assert r["held_out"] == (not kept(key)) and r["n_tokens"] == len(own) and r["train_tokens"] == n
            assert r["n_known"] == sum(counts[t] > 0 for t in own)
            assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in own))
            assert r["score"] < 0 and r["perplexity"] == pytest.approx(10 ** (-r["score"] / len(own)))


def brown_classes(fitted):
    """Class and training count of every word, from the stored texts and the buckets' answers."""
    unpacked, out = word_exchange.unpacked, {}
    for row in fitted.state.collect():
        out[row["bucket"]] = list(zip(unpacked(row["classes"]).tolist(), unpacked(row["counts"]).tolist()))
    return out


def test_brown_sums_make_few_rows(spark):
    cells, rng = 5000, np.random.default_rng(1)
    arrays = [rng.integers(0, 9, cells) for _ in range(40)]
    rows = spark.createDataFrame([(i, a.astype("<i8").tobytes()) for i, a in enumerate(arrays)], "i int, a binary").repartition(5)
    make = lambda row: np.frombuffer(row["a"], dtype="<i8")
    assert (brown._sums(rows, make, cells) == sum(arrays)).all()
    assert not brown._sums(rows.where("i < 0"), make, cells).any()
    assert brown._task_sums(rows, make, cells).count() <= 5 * 3


def test_brown_probabilities_sum_to_one(documents):
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{x}" for x in rng.integers(0, 9, 12))) for i in range(80)]
    fitted = brown.fit(documents(rows), classes=8)
    model = fitted.model
    counts = Counter(t for key, text in rows if not brown.held_out(key) for t in tokens(text))
    pairs = [p for own in brown_classes(fitted).values() for p in own if p[1]]
    assert sorted(n for _, n in pairs) == sorted(n for t, n in counts.items() if t is not None)
    assert all(0 < c < 8 for c, _ in pairs)
    classes = np.array([c for c, _ in pairs] + [brown.END_CLASS])
    seen = np.array([n for _, n in pairs] + [counts[None]])
    unseen = model.emission(np.zeros(8), np.arange(8))
    for before in range(8):
        total = (model.transitions[before, classes] * model.emission(seen, classes)).sum()
        assert total + (model.transitions[before] * unseen).sum() == pytest.approx(1.0)


def class_pairs(texts, own, classes):
    table = np.zeros((classes, classes))
    for text in texts:
        line = [0, *(own[w] for w in text), 0]
        np.add.at(table, (line[:-1], line[1:]), 1)
    return table


def test_brown_statistics_are_those_of_the_texts(documents, odd):
    rows = [r for r in odd if r[0] is not None] + [(i, f"the cat sat on mat {i % 7} dog the the") for i in range(100, 160)]
    for partitions in (1, 5):
        fitted = brown.fit(documents(rows, partitions), classes=6)
        # What the model says of its own classes: the transitions' table is that of the texts.
        per_class = np.zeros(6)
        for own in brown_classes(fitted).values():
            for c, n in own:
                if n:
                    per_class[c] += n
        assert per_class[1:] == pytest.approx(fitted.model.class_tokens[1:])
        assert fitted.model.class_tokens[0] == fitted.model.ends == sum(not brown.held_out(k) for k, _ in rows)
        assert max(fitted.model.likelihoods) >= fitted.model.likelihoods[0]


def test_a_move_is_to_the_class_of_the_largest_likelihood():
    """One word at a time against the likelihood of the whole table, other words as they stand."""
    rng = np.random.default_rng(2)
    classes, n_words = 5, 12
    texts = [rng.integers(0, n_words, 9).tolist() for _ in range(60)]
    # No word follows itself, as a sweep takes the neighbours' classes as they were counted.
    texts = [[w for w, x in zip(t, [None, *t]) if w != x] for t in texts]
    own = 1 + rng.integers(0, classes - 1, n_words)
    table = class_pairs(texts, own, classes)
    for word in range(n_words):
        keys = Counter()
        for text in texts:
            for i, w in enumerate(text):
                if w == word:
                    keys[0 * classes + (own[text[i - 1]] if i else 0)] += 1
                    keys[1 * classes + (own[text[i + 1]] if i + 1 < len(text) else 0)] += 1
        every = np.array(sorted(keys))
        alone = np.array([own[word]], dtype=np.int16)
        moved = brown.exchanged(alone, every, np.array([keys[k] for k in every]), table)
        gains = []
        for c in range(1, classes):
            other = own.copy()
            other[word] = c
            gains.append(brown.likelihood(class_pairs(texts, other, classes)))
        assert gains[moved[0] - 1] == pytest.approx(max(gains), abs=1e-9)


def crowd(n_words, classes, most, seed=3):
    """Words in random classes, their counts by class (up to ``most`` each), and a table of pairs of classes."""
    rng = np.random.default_rng(seed)
    keys = np.unique(np.concatenate([w * 2 * classes + rng.integers(0, 2 * classes, 3) for w in range(n_words)]))
    n = rng.integers(1, most + 1, len(keys))
    own = rng.integers(1, classes, n_words).astype(np.int16)
    table = rng.integers(0, 4, (classes, classes)).astype(float)
    word, after, other = keys // (2 * classes), keys // classes % 2, keys % classes
    mine = own[word].astype(np.int64)
    np.add.at(table, (np.where(after, mine, other), np.where(after, other, mine)), n)
    return own, keys, n, table


def plainly_best(own, keys, n, table):
    """The class each word would choose with all others as they stand, by a loop over its counts."""
    classes, f = len(table), lambda x: x * math.log(x) if x > 0 else 0.0
    out = own.copy()
    for word in np.unique(keys // (2 * classes)):
        here = int(own[word])
        some = [(k // classes % 2, k % classes, int(c)) for k, c in zip(keys.tolist(), n) if k // (2 * classes) == word]
        total = sum(c for after, _, c in some if after)
        gains, without = np.full(classes, -math.inf), table.copy()
        for after, other, c in some:
            without[(here, other) if after else (other, here)] -= c
        for to in range(1, classes):
            gain = 0.0
            for after, other, c in some:
                if other != to:
                    old = without[(to, other) if after else (other, to)]
                    gain += f(old + c) - f(old)
            loops = sum(c for _, other, c in some if other == to)
            gain += f(without[to, to] + loops) - f(without[to, to])
            for margin in (table.sum(axis=1)[to], table.sum(axis=0)[to]):
                old = max(margin - (total if to == here else 0), 0.0)
                gain -= f(old + total) - f(old)
            gains[to] = gain
        if gains.max() > gains[here] + 1e-9 * max(1.0, abs(gains[here])):
            out[word] = gains.argmax()
    return out


@pytest.mark.parametrize("most", [2, 40])
def test_words_looked_at_together_choose_as_alone(most):
    own, keys, n, table = crowd(60, 9, most)
    moved = brown.exchanged(own, keys, n, table)
    assert (moved == plainly_best(own, keys, n, table)).all() and (moved != own).any()


def test_a_sweep_works_out_what_words_share_once(monkeypatch):
    own, keys, n, table = crowd(4000, 64, 2)
    weighed, plain = [], brown._weigh
    monkeypatch.setattr(brown, "_weigh", lambda n: weighed.append(np.size(n)) or plain(n))
    brown.exchanged(own, keys, n, table)
    # Fewer logarithms than one for each word and class; margins alone took four.
    assert sum(weighed) < 64 * 4000


def test_packed_words_are_those_of_the_slice():
    words = pa.array(["a", "", "é€", "bc", "𝄞"], pa.string())
    for some in (words, words.slice(2, 2), words.slice(1, 1), words.slice(5), words.cast(pa.large_string()).slice(1), pa.array([], pa.string())):
        assert word_exchange.unpacked_words(word_exchange.packed_words(some)).to_pylist() == some.to_pylist()
    assert word_exchange.word_hashes(words.slice(2)).tolist() == [xxhash.xxh64_intdigest(w) for w in words.slice(2).to_pylist()]


def test_exchange_finds_planted_classes(documents):
    rng = np.random.default_rng(4)
    rows = []
    for key in range(600):
        kind = rng.integers(0, 3)
        text = []
        for _ in range(30):
            text.append(f"{'abc'[rng.integers(0, 3)]}{kind + 3 * rng.integers(0, 10)}")
            kind = (kind + 1) % 3
        rows.append((key, " ".join(text)))
    found = brown.fit(documents(rows), classes=16).model.likelihoods
    # Three kinds in a fixed cycle: the kind of the next word is certain, log 3 more than nothing known.
    assert max(found) - found[0] > 0.5 * math.log(3)


def test_brown_model_beats_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = brown.fit_and_score(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert sums[0] / sums[2] > sums[1] / sums[2] + 0.1


def test_brown_of_an_empty_table(documents):
    assert brown.fit_and_score(documents([])).count() == 0


# --- MaxScore ----------------------------------------------------------------------------------------


def brute_top(rows, k):
    clean = {}
    for key, values in rows:
        if key is not None and values is not None and all(x is not None and math.isfinite(x) for x in values):
            clean[key] = [math.floor(256 * x) for x in values]
    out = []
    for q in (key for key in clean if key % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(clean[q], v)), key) for key, v in clean.items() if key != q)[:k]
        out += [(q, i + 1, key, -s) for i, (s, key) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("shard,queries", [(8192, 2048), (40, 2)])
def test_top_k(spark, monkeypatch, shard, queries):
    monkeypatch.setattr(maxscore, "SHARD", shard)
    monkeypatch.setattr(maxscore, "QUERIES", queries)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.round(rng.normal(0, 0.2, 24), 1)]) for i in range(260)]
    rows[7] = (7, None)
    rows[8] = (8, [float("nan")] * 24)
    rows[9] = (9, [float("inf")] + [0.0] * 23)
    rows[11] = (11, [None] + [0.0] * 23)
    rows += [(300 + i, [0.1] * 24) for i in range(20)] + [(None, [0.1] * 24), (50_000, [0.0] * 24)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    narrow = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows]
    vectors = maxscore.quantised(frame)
    found = maxscore.top_k(vectors, vectors.where("key % 50 = 0"))
    assert sorted(map(tuple, found.collect())) == brute_top(narrow, 5)


def test_few_candidates(spark):
    frame = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    vectors = maxscore.quantised(frame)
    assert [tuple(r) for r in maxscore.top_k(vectors, vectors.where("key = 0")).collect()] == [(0, 1, 1, 256 * 512)]
    assert maxscore.top_k(vectors.where("false"), vectors.where("false")).count() == 0


# --- Licences ----------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_base_phrases(documents, odd):
    rows = [
        *odd,
        (20, "Under the MIT license. under THE mit License, (under the mit) license; CC-BY-NC and cc by nc nd"),
        (21, "apache license version 2.0 or Apache License, Version 2"),
        (22, "under the the mit license; cc by xx nc"),
        (23, "cc by nc " * 3000),
    ]
    found = {}
    for r in licenses.scan(documents(rows)).collect():
        found.setdefault(r["doc_id"], []).append(r)
    phrases = [(p.split(), label) for p, label in licenses.PHRASES]
    assert sum(map(len, found.values())) == len(rows)
    for key, text in rows:
        words = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
        places = [(i, label) for p, label in phrases for i in range(len(words)) if words[i : i + len(p)] == p]
        for r in found[key]:
            assert r["n_words"] == len(words) and r["n_base"] == len(places)
            assert r["first_word"] == min((i for i, _ in places), default=None)
            assert r["last_word"] == max((i for i, _ in places), default=None)
            assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
            assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_notices_with_edits(documents):
    notices = dict(licenses.NOTICES)
    words = notices["isc"].split()
    edited = " ".join(words[:9] + ["inserted", "words"] + words[9:20] + words[21:])
    rows = [
        (1, "some code before " * 30 + notices["bsd-3-clause"] + " after"),
        (2, "intro " + edited + " outro " * 20),
        (3, " ".join(words[:8]) + " unrelated text follows here " * 5),
        (4, "the software is provided to you under these conditions " * 10),
    ]
    found = by_key(licenses.scan(documents(rows)))
    assert [found[i]["labels"] for i in (1, 2, 3, 4)] == ["bsd-3-clause", "isc", "", ""]
    assert found[1]["score"] == 1.0 and 0.7 <= found[2]["score"] < 1.0
    span = found[2]["spans"][0]
    assert (span["start"], span["end"]) == (1, 1 + len(WORD.findall(edited.lower())))


def test_notices_with_many_words_between(documents):
    words = dict(licenses.NOTICES)["isc"].split()
    n = len(words)
    other = lambda k: [f"line{i}" for i in range(k)]
    cut = n // 2
    third = n // 3
    texts = {
        1: words[:cut] + other(5) + words[cut:],
        2: words[:cut] + other(n // 3) + words[cut:],
        3: words[:third] + other(12) + words[third : 2 * third] + other(9) + words[2 * third :],
        4: words[cut:] + other(5) + words[:cut],  # the wrong way round
        5: words[:cut] + other(4 * n) + words[cut:],  # too far apart
        6: words[:third] + other(6) + words[:third],  # a part twice
    }
    found = by_key(licenses.scan(documents([(k, "x y " + " ".join(t) + " z") for k, t in texts.items()])))
    assert [found[k]["labels"] for k in range(1, 7)] == ["isc", "isc", "isc", "", "", ""]
    for k in (1, 2, 3):
        (span,) = found[k]["spans"]
        assert (span["start"], span["end"]) == (2, 2 + len(WORD.findall(" ".join(texts[k]).lower()))) and span["cover"] >= 0.7


def test_licences_of_an_empty_table(documents):
    assert licenses.scan(documents([])).count() == 0


# --- Toxicity ----------------------------------------------------------------------------------------


def test_index_is_exact():
    rng = np.random.default_rng(8)
    rows = np.where(rng.random((700, 40)) < 0.1, rng.random((700, 40)), 0.0)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = rows / np.where(norms > 0, norms, 1.0)
    index = toxicity.BlockMaxIndex.build(np.arange(700), (np.arange(700) % 2).astype(float), rows)
    queries = rows[::7]
    similarities, numbers = index.nearest(queries, 10)
    want = -np.sort(-(queries @ rows.T), axis=1)[:, :10]
    assert np.allclose(similarities, want)
    for q, own, found in zip(queries, numbers, similarities):
        known = own >= 0
        assert np.allclose(rows[index.keys[own[known]]] @ q, found[known])


def toxic_rows(n, seed=9):
    rng = np.random.default_rng(seed)
    plain = [f"word{i}" for i in range(300)]
    rude = ["awful", "rotten", "nasty"]
    rows, marks = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = list(rng.choice(plain, 40)) + (list(rng.choice(rude, 4)) if bad else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    return rows, marks


def test_toxicity_on_held_out(spark, documents, odd):
    rows, marks = toxic_rows(600)
    docs = documents([*rows, *((k if k is None else k + 5000, t) for k, t in odd)])
    labels = spark.createDataFrame(marks + [(3, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_on_labels(docs, labels)
    scored = toxicity.score(docs, model)
    assert scored.columns == [*docs.columns, "toxicity", "evidence"] and scored.count() == docs.count()
    held = scored.where(~toxicity.may_learn() & (F.col("doc_id") < 5000)).collect()
    assert len(held) > 100
    right = [(r["toxicity"] >= toxicity.THRESHOLD) == (r["doc_id"] % 5 == 0) for r in held]
    assert np.mean(right) > 0.97
    for r in held:
        assert all(0 < e["similarity"] <= 1 + 1e-9 for e in r["evidence"])
    other = scored.where("doc_id >= 5000 or doc_id is null").collect()
    assert all(0 <= r["toxicity"] < toxicity.THRESHOLD for r in other)


def test_toxicity_without_labels(spark, documents):
    docs = documents([(1, "some words"), (2, None)])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scored = toxicity.score(docs, toxicity.fit_on_labels(docs, labels)).collect()
    assert [(r["toxicity"], r["evidence"]) for r in scored] == [(0.0, [])] * 2


def test_listed_terms_are_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "HEAD", 7)
    rng = np.random.default_rng(8)
    rows = np.where(rng.random((500, 60)) < 0.1, rng.random((500, 60)), 0.0)
    rows[3] = 0.0
    index = toxicity.BlockMaxIndex.build(np.arange(500), np.zeros(500), rows)
    assert len(index.keys) == 500 and np.allclose(index.nearest(rows, 9)[0], -np.sort(-(rows @ rows.T), axis=1)[:, :9])


def test_copy_of_an_example_with_rare_words(spark, documents):
    rows, marks = toxic_rows(600)
    rare = [f"rare{i}" for i in range(30)]
    keys = [k for k in range(7000, 7100) if zlib.crc32(str(k).encode()) % 4 != 2]
    docs = documents([*rows, (keys[0], " ".join(rare)), (9000, " ".join(rare)), (9001, "rare3 other text")])
    labels = spark.createDataFrame([*marks, (keys[0], 1, 1)], "doc_id long, quality int, toxic int")
    scored = by_key(toxicity.score(docs, toxicity.fit_on_labels(docs, labels)).where("doc_id >= 9000"))
    assert [e["doc_id"] for e in scored[9000]["evidence"]] == [keys[0]]
    assert scored[9000]["evidence"][0]["similarity"] == pytest.approx(1.0)
    assert scored[9000]["toxicity"] >= toxicity.THRESHOLD and scored[9001]["evidence"]


def test_stems_with_unseen_endings(spark, documents):
    rng = np.random.default_rng(5)
    ends = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    word = lambda stem: stem + "".join(rng.choice(ends, 3))
    rows, marks = [], []
    for i in range(500):
        bad = i % 5 == 0
        rows.append((i, " ".join([*(word("plain") for _ in range(20)), *(word("hated") for _ in range(4 * bad))])))
        marks.append((i, 1, int(bad)))
    docs = documents(rows)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.fit_on_labels(docs, labels)
    assert {"^hate", "^plai"} <= set(model.terms.to_pylist())
    held = toxicity.score(docs, model).where(~toxicity.may_learn()).collect()
    assert np.mean([(r["toxicity"] >= toxicity.THRESHOLD) == (r["doc_id"] % 5 == 0) for r in held]) > 0.95
    assert model.threshold(0.0) > np.median(model.left_out) and model.threshold(0.05) <= model.threshold(0.0)


def test_model_travels_as_counts(spark, documents):
    import pickle

    import pyarrow as pa

    rows, marks = toxic_rows(300)
    model = toxicity.fit_on_labels(documents(rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    again = pickle.loads(pickle.dumps(model))
    texts = pa.array([t for _, t in rows[:80]])
    for one, two in zip(model.evaluate(texts, 9), again.evaluate(texts, 9)):
        assert np.array_equal(one, two)
    assert again.terms.equals(model.terms) and len(pickle.dumps(model)) < model.index.nbytes / 4


def test_examples_are_bounded(spark, documents):
    rows, marks = toxic_rows(600)
    docs = documents([*rows, *((k, t) for k, t in rows[:50])])
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    few = toxicity.fit(docs, labels.select("doc_id", F.col("toxic").alias("target")), examples=90)
    assert len(few.index.keys) == len(set(few.index.keys)) == 90
    short = toxicity.fit(docs, labels.select("doc_id", F.col("toxic").alias("target")), chars=5000)
    length = {k: len(t) for k, t in rows}
    assert 10 < len(short.index.keys) < 600 and sum(length[int(k)] for k in short.index.keys) <= 5000


def test_columns_of_the_result_in_the_input(spark, documents):
    rows, marks = toxic_rows(300)
    docs = documents(rows).withColumn("toxicity", F.lit("mine")).withColumn("__SCORED", F.lit(1))
    model = toxicity.fit_on_labels(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))
    scored = toxicity.score(docs, model, into=("p", "why"))
    assert scored.columns == [*docs.columns, "p", "why"] and scored.first()["toxicity"] == "mine"
    assert dict(toxicity.score(docs, model).dtypes)["toxicity"] == "double"
    assert toxicity.score(docs.limit(0), model).count() == 0


# --- Language ----------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    path = language.byte_bpe.vocabulary_path(language.VOCABULARY)
    own = language.pieces(path)
    rng = np.random.default_rng(1)
    shares = np.concatenate([rng.random((len(own), 2)), np.full((1, 2), language.UNKNOWN_LETTER)])
    number = {p: i for i, p in enumerate(own)}
    for word in ("the", "nation", "äß", "ж", "zqxj"):
        marked = "▁" + word
        total = np.zeros((len(marked) + 1, 2))
        total[0] = 1.0
        for end in range(1, len(marked) + 1):
            for start in range(max(0, end - language.WIDEST), end):
                piece = number.get(marked[start:end], -1 if end - start == 1 else None)
                if piece is not None:
                    total[end] += total[start] * shares[piece]
        assert np.allclose(language.word_scores([word], shares, path)[0], np.log(total[-1]))


def test_expected_counts_cover_each_word():
    path = language.byte_bpe.vocabulary_path(language.VOCABULARY)
    own = language.pieces(path)
    shares = np.full((len(own) + 1, 1), 1e-3)
    for numbers, letters in language._tables(["nation", "nations", "river"]):
        counts = language.expected_counts(language.arcs_of(letters, path), shares, np.full((len(numbers), 1), 2.0))
        letters_of = np.array([len(p) for p in own] + [1])
        assert (counts[:, 0] * letters_of).sum() == pytest.approx(2.0 * letters.size)


def test_language_on_held_out(spark, documents, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs.where(language.may_learn()))
    found = language.identify(docs.where(~language.may_learn()), model)
    right = found.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.98
    frame = documents([*odd, (50, "12345 --- 67"), (51, "ça alors une longue phrase de la langue que les gens parlent")])
    odd_rows = language.identify(frame, model)
    assert odd_rows.count() == len(odd) + 2 and odd_rows.columns == [*frame.columns, "lang_pred", "lang_score"]
    own = by_key(odd_rows)
    assert all((own[k]["lang_pred"], own[k]["lang_score"]) == ("und", 0.0) for k in (7, 8, 9, 50))
    assert own[51]["lang_pred"] == "fr" and 0.5 < own[51]["lang_score"] <= 1


def test_no_language_to_learn(documents):
    docs = documents([(1, "some words"), (2, None)])
    found = language.identify(docs, language.fit(docs)).collect()
    assert [(r["lang_pred"], r["lang_score"]) for r in found] == [("und", 0.0)] * 2
    assert language.fit(documents([])).languages == []

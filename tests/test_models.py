import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import queries
from lurescope.models import classifiers, iforest, ngram, reconstruction
from lurescope.operators import joint, scaling, sequences


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(0)
    rows = [(i, *map(float, rng.normal(size=3))) for i in range(800)] + [(800 + i, 9.0 + i, -9.0, 9.0) for i in range(5)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double")


def test_forest_ranks_outliers_first(spark, cloud):
    nodes = iforest.fit_forest(cloud, "id", ["a", "b", "c"], trees=60, samples=64)
    again = iforest.fit_forest(cloud.repartition(5), "id", ["a", "b", "c"], trees=60, samples=64)
    key = lambda f: sorted(map(tuple, f.collect()))
    assert key(nodes) == key(again)
    sizes = nodes.groupBy("tree").agg(F.count("*").alias("n"), F.first("n_samples").alias("s")).collect()
    assert len(sizes) == 60 and all(r["n"] <= 127 and r["s"] == 64 for r in sizes)
    scored = iforest.score_forest(cloud, ["a", "b", "c"], nodes)
    top = [r["id"] for r in scored.orderBy(F.desc("score")).limit(5).collect()]
    assert set(top) == set(range(800, 805))
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    assert 0 < low < high < 1


def test_forest_settings_share_one_job(spark, cloud):
    nodes = iforest.fit_forests(cloud, "id", ["a", "b"], [(10, 32), (20, 32), (20, 16)])
    counts = {(r["max_samples"]): r["n"] for r in nodes.where("node = 1").groupBy("max_samples").agg(F.count("*").alias("n")).collect()}
    assert counts == {32: 20, 16: 20}
    assert iforest.select_forest(nodes, 10, 32).select("tree").distinct().count() == 10


def test_deep_forests_are_walked_to_their_leaves(spark, cloud):
    nodes = iforest.fit_forest(cloud, "id", ["a", "b", "c"], trees=5, samples=2048)
    forest = iforest._arrays(nodes.toPandas())
    x = np.array([[r["a"], r["b"], r["c"]] for r in cloud.orderBy("id").collect()])
    got = [r["score"] for r in iforest.score_forest(cloud, ["a", "b", "c"], nodes).orderBy("id").collect()]
    for row, score in list(zip(x, got))[::80]:
        depths = []
        for tree in range(5):
            at = 1
            while forest["left"][tree, at] != at:
                side = "left" if row[forest["feature"][tree, at]] <= forest["threshold"][tree, at] else "right"
                at = forest[side][tree, at]
            depths.append(forest["path"][tree, at])
        assert score == pytest.approx(2 ** (-np.mean(depths) / iforest.average_path(805)))


def test_forest_score_follows_the_paths():
    x = np.array([[0.0], [1.0], [10.0]])
    nodes = iforest._grow(x, 3, 1, 8)
    leaves = [n for n in nodes if n[3] == n[0]]
    assert len(leaves) == 3 and all(n[5] == int(n[5]) for n in leaves)
    assert nodes[0][0] == 1 and nodes == iforest._grow(x[::-1].copy(), 3, 1, 8)
    assert iforest.average_path([0, 1, 2]).tolist() == [0, 0, 1]
    assert iforest.average_path(256) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_linear_codec_matches_numpy(spark, cloud):
    codec = reconstruction.fit_codec(cloud, ["a", "b", "c"], k=2)
    x = np.array([[r["a"], r["b"], r["c"]] for r in cloud.orderBy("id").collect()])
    centred = x - x.mean(axis=0)
    _, _, vt = np.linalg.svd(centred, full_matrices=False)
    want = ((centred - centred @ vt[:2].T @ vt[:2]) ** 2).mean(axis=1)
    got = [r["score"] for r in reconstruction.score_codec(cloud, codec).orderBy("id").collect()]
    assert got == pytest.approx(want.tolist(), abs=1e-8)


def brute_ngram(train, text):
    pairs = Counter((a, b) for t in train for a, b in zip([""] + list(t), t))
    context = Counter()
    for (a, _), n in pairs.items():
        context[a] += n
    v = len({b for _, b in pairs}) + 1
    terms = [-math.log(max((pairs[a, b] + 1) / (context[a] + v), 1e-9)) for a, b in zip([""] + list(text), text)]
    return sum(terms) / len(terms) if terms else 0.0


def test_bigram_score(spark, monkeypatch):
    train = ["http://a.b/c", "https://é.b", "x" * 200]
    texts = train + ["", "ζ", "http\U0001F600", "a" * 300 + "ζ"]
    fit = ngram.fit_bigrams(spark.createDataFrame([(t,) for t in train], "url string"), "url")
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, url string")
    for r in ngram.score_bigrams(frame, "id", "url", fit).collect():
        assert r["score"] == pytest.approx(brute_ngram(train, texts[r["id"]]), abs=1e-12)
    monkeypatch.setattr(ngram, "MAX_PAIRS", 3)
    for r in ngram.score_bigrams(frame, "id", "url", fit).collect():
        assert r["score"] == pytest.approx(brute_ngram(train, texts[r["id"]]), abs=1e-12)


def test_char_sequences(spark):
    train = spark.createDataFrame([("ba",), ("é\U0001F600a",)], "url string")
    vocab = sequences.char_vocab(train, "url")
    assert [(r["char"], r["index"]) for r in vocab.orderBy("index").collect()] == [("a", 2), ("b", 3), ("é", 4), ("\U0001F600", 5)]
    frame = spark.createDataFrame([("ab\U0001F600zé",), ("",), ("a" * 200,)], "url string")
    got = [r["seq"] for r in sequences.encode_chars(frame, "url", vocab).collect()]
    assert got == [[2, 3, 5, 1, 4], [], [2] * 200]
    cut = [r["seq"] for r in sequences.encode_chars(frame, "url", vocab, max_len=4).collect()]
    assert cut == [[2, 3, 5, 1], [0] * 4, [2] * 4]
    assert tuple(sequences.cut_report(frame, "url", 4).first()) == (3, 2, 197)


def test_char_sequences_reach_the_longest(spark, tmp_path):
    urls = ["http://a.example/", "http://b.example/longer/path", "https://\U0001F600.example/é"] * 2 + [f"http://h{i}.example/{'x' * i}" for i in range(40)]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["url"]: r["seq"].split(",") for r in queries.char_sequences(spark, str(tmp_path)).collect()}
    longest = max(len(u) for u in got)
    assert len(got) > 20 and all(len(s) == longest for s in got.values())
    assert all("0" not in s[: len(u)] and set(s[len(u) :]) <= {"0"} for u, s in got.items())


def test_gradient_of_every_coefficient(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3))
    y = (x[:, 0] > 0.4).astype(int)
    frame = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id int, v array<double>, y int")
    fitted = classifiers.embedding_classifier(frame, "v", "y")
    rows = {r["term"]: r["gradient"] for r in classifiers.gradient(frame, "y", fitted).collect()}
    assert set(rows) == {-1, 0, 1, 2} and all(abs(g) < 1e-6 for g in rows.values())
    # After one step the fit is away from its optimum, and the gradient is that of the loss by its definition.
    early = classifiers.embedding_classifier(frame, "v", "y", max_iter=1)
    rows = {r["term"]: r["gradient"] for r in classifiers.gradient(frame, "y", early).collect()}
    unit, w = x / np.linalg.norm(x, axis=1, keepdims=True), np.where(y == 1, 60 / y.sum(), 60 / (1 - y).sum())
    b, b0 = early.model.coefficients.toArray(), early.model.intercept
    away = w * (1 / (1 + np.exp(-(unit @ b + b0))) - y)
    want = {-1: away.sum() / w.sum(), **{i: away @ unit[:, i] / w.sum() + b[i] / 120 for i in range(3)}}
    assert rows == pytest.approx(want) and max(map(abs, rows.values())) > 1e-3


def test_text_gradient_of_every_coefficient(spark):
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choice(words, 6)) + (" bad" if i % 3 == 0 and i % 7 else ""), int(i % 3 == 0)) for i in range(90)]
    frame = spark.createDataFrame([*rows, (91, None, 0), (92, "", 1)], "id int, t string, y int")
    fitted = classifiers.text_classifier(frame, "t", "y", buckets=64, max_iter=500)
    found = {r["term"]: r["gradient"] for r in classifiers.gradient(frame, "y", fitted).collect()}
    assert set(found) == set(range(-1, 64)) and all(abs(g) < 1e-4 for g in found.values())


def test_embedding_classifier_reaches_the_optimum(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4))
    y = (x[:, 0] + rng.normal(scale=0.7, size=300) > 0.6).astype(int)
    frame = spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(300)], "id int, e array<double>, y int")
    got = {r["id"]: r["score"] for r in classifiers.embedding_classifier(frame, "e", "y")(frame).collect()}
    z = np.hstack([x / np.linalg.norm(x, axis=1, keepdims=True), np.ones((300, 1))])
    weight = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (1 - y).sum()))
    beta, ridge = np.zeros(5), np.diag([1.0, 1, 1, 1, 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve((z.T * (weight * p * (1 - p))) @ z + ridge, z.T @ (weight * (p - y)) + ridge @ beta)
    want = 1 / (1 + np.exp(-z @ beta))
    assert [got[i] for i in range(300)] == pytest.approx(want.tolist(), abs=1e-5)


def test_scaler_guards(spark):
    frame = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, k double")
    state = scaling.fit_scaler(frame, ["a", "k"])
    assert [tuple(r) for r in scaling.apply_scaler(frame, state, ["a", "k"]).collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    with pytest.raises(ValueError):
        scaling.apply_scaler(frame, state, ["k", "a"])
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,), (1.0,)], "a double")
    assert tuple(scaling.feature_health(odd, ["a"]).first()) == ("a", 3, 1, 1, 1)


def test_max_per_message_and_neutral(spark):
    rows = [(1, "u", 0.2), (1, "v", 0.9), (2, None, None), (3, "w", 0.4), (4, None, None)]
    urls = spark.createDataFrame(rows, "email_id int, url string, s double")
    best = {r["email_id"]: r["s"] for r in joint.max_per_message(urls, "email_id", ["s"]).collect()}
    assert best == {1: 0.9, 2: 0.4, 3: 0.4, 4: 0.4}
    zero = joint.max_per_message(urls, "email_id", ["s"], neutral="zero")
    assert {r["s"] for r in zero.where("email_id in (2, 4)").collect()} == {0.0}
    mail = spark.createDataFrame([(1,), (2,), (9,)], "email_id int")
    joined = joint.attach_max(mail, urls.where("url is not null"), "email_id", ["s"])
    assert {r["email_id"]: r["s"] for r in joined.collect()} == {1: 0.9, 2: 0.4, 9: 0.4}
    check = joint.completeness(mail, urls.select("email_id"), "email_id").first()
    assert (check["n_missing"], check["n_stray"], check["n_url_rows"]) == (1, 2, 5)


def test_fusion_has_one_cell_per_pair(spark):
    frame = spark.createDataFrame([(1, 0.9, 0.1, 0.8)], "id int, s double, a double, b double")
    got = {(r["anomaly"], r["verdict"]) for r in joint.fuse_scores(frame, "id", ["s"], ["a", "b"]).collect()}
    assert got == {("a", "suspicious"), ("b", "phishing")}

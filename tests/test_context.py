import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lurescope.models import context, ngram

TEXTS = ["http://a.example/path", "http://b.example/path?q=1", "ftp://é.example/ü", "", None, "aaaaabaaaa", "http://a.example/path"]


def tree_in_python(texts, order):
    """Levels of counts, discounts and the number of symbols, by the definitions."""
    top = Counter()
    for t in texts:
        whole = context.START * order + (t or "")
        top.update((whole[i - order : i], whole[i]) for i in range(order, len(whole)))
    levels = [top]
    while len(levels) <= order:
        above, lower = levels[-1], Counter()
        for c, x in above:
            lower[c[1:], x] += 1
        levels.append(lower)
    levels = levels[::-1]
    discounts = []
    for level in levels:
        once, twice = (sum(n == k for n in level.values()) for k in (1, 2))
        discounts.append(once / (once + 2 * twice) if once else 0.5)
    return levels, discounts, len(levels[0]) + 1


def probability(model, before, char):
    levels, discounts, symbols = model
    p = 1 / symbols
    for k, (level, d) in enumerate(zip(levels, discounts)):
        own = before[len(before) - k :]
        followers = {x: n for (c, x), n in level.items() if c == own}
        if followers:
            total = sum(followers.values())
            p = (max(followers.get(char, 0) - d, 0) + d * len(followers) * p) / total
    return p


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "key long, url string").repartition(3).withColumn("run", F.lit("mine"))


@pytest.mark.parametrize("order,local", [(0, 1 << 20), (2, 1 << 20), (3, 0)])
def test_losses_by_definition(spark, rows, order, local):
    tree = context.fit_contexts(rows.where("key <> 2"), "url", order)
    model = tree_in_python([t for k, t in enumerate(TEXTS) if k != 2], order)
    assert tree.symbols == model[2] and tree.discounts == pytest.approx(model[1])
    got = {r["key"]: (r["run"], r["score"]) for r in context.score_contexts(rows, "key", "url", tree, ["run"], local=local).collect()}
    assert len(got) == len(TEXTS)
    for k, t in enumerate(TEXTS):
        whole = context.START * order + (t or "")
        losses = [-math.log(probability(model, whole[i - order : i], whole[i])) for i in range(order, len(whole))]
        assert got[k] == ("mine", pytest.approx(sum(losses) / len(losses) if losses else 0.0))


def test_probabilities_sum_to_one(spark, rows):
    tree = context.fit_contexts(rows, "url", 3)
    symbols = sorted({c for t in TEXTS for c in t or ""})
    starts = ["".join(context.START * 3), "htt", "aaa", "xyz", "/pa", context.START + "ht"]
    runs = spark.createDataFrame([(s + c,) for s in starts for c in [*symbols, "☃"]], "run string")
    sums = defaultdict(float)
    for r in context.probabilities(runs, tree).collect():
        sums[r["run"][:3]] += r["p"]
    assert len(sums) == len(starts) and all(s == pytest.approx(1.0) for s in sums.values())


def test_longer_contexts_lose_less_than_bigrams(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    train, test = docs.where("page_id % 5 > 0"), docs.where("page_id % 5 = 0")
    tree = context.fit_contexts(train, "url", 5)
    mean = lambda df: df.agg(F.avg("score")).first()[0]
    long = mean(context.score_contexts(test, "page_id", "url", tree))
    assert long < 0.9 * mean(ngram.score_bigrams(test, "page_id", "url", ngram.fit_bigrams(train, "url")))


def test_bigrams_beyond_the_local_limit(rows, monkeypatch):
    bigrams = ngram.fit_bigrams(rows.where("key <> 2"), "url")
    few = {r["key"]: r["score"] for r in ngram.score_bigrams(rows, "key", "url", bigrams, ["run"]).collect()}
    monkeypatch.setattr(ngram, "MAX_PAIRS", 3)
    many = {r["key"]: r["score"] for r in ngram.score_bigrams(rows, "key", "url", bigrams, ["run"]).collect()}
    assert many == pytest.approx(few) and len(many) == len(TEXTS)


def test_empty_tables(spark, rows):
    tree = context.fit_contexts(rows.limit(0), "url", 2)
    assert tree.symbols == 1
    assert context.score_contexts(rows.limit(0), "key", "url", tree).count() == 0
    assert {r["score"] for r in context.score_contexts(rows, "key", "url", tree).collect()} == {0.0}

import os

import pytest

from lurescope.operators import dedup
from lurescope.sources import url_state

UNION = "url string, label int, priority int, source string"


def rows_of(seed, n=120):
    import random

    rng = random.Random(seed)
    return [(f"http://h{rng.randrange(90)}.example", rng.choice([0, 1, 1, 1, None]), rng.randrange(3), "s") for _ in range(n)]


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{path}/data") for f in fs if f.startswith("part-")}


def test_equals_the_corpus_of_all_batches(spark, tmp_path):
    path, every = str(tmp_path / "state"), []
    assert url_state.state(spark, path).count() == 0
    for i in range(4):
        own = rows_of(i) + [(None, 1, 0, "s")]
        every += own
        assert url_state.merge_batch(path, spark.createDataFrame(own, UNION), i, buckets=7)
        union = spark.createDataFrame(every, UNION).where("url is not null")
        want = {tuple(r) for r in dedup.group_urls(union).select("url", "label", "label_max", "priority", "n_rows").collect()}
        assert {tuple(r) for r in url_state.state(spark, path).collect()} == want
        got = {tuple(r) for r in url_state.corpus(spark, path, ["a", "b", "c"]).collect()}
        assert got == {tuple(r) for r in dedup.url_corpus(union, ["a", "b", "c"]).collect()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "state")
    url_state.merge_batch(path, spark.createDataFrame(rows_of(1), UNION), 0, buckets=16)
    before, (_, first, _) = files(path), url_state.manifest(spark, path)
    url_state.merge_batch(path, spark.createDataFrame([("http://h3.example", 0, 1, "s")], UNION), 5)
    after, (last, second, buckets) = files(path), url_state.manifest(spark, path)
    assert last == 5 and buckets == 16 and sum(first.get(b) != at for b, at in second.items()) == 1
    assert before.items() <= after.items() and len(after) == len(before) + 1


def test_a_batch_counts_once_and_a_lost_one_not_at_all(spark, tmp_path):
    path, own = str(tmp_path / "state"), spark.createDataFrame(rows_of(2), UNION)
    assert url_state.merge_batch(path, own, 3) and not url_state.merge_batch(path, own, 3) and not url_state.merge_batch(path, own, 1)
    known = {tuple(r) for r in url_state.state(spark, path).collect()}
    # A batch that died before its manifest: its files are there, and nobody reads them.
    spark.createDataFrame([("http://lost", 1, 1, 0, 9, 0)], f"{url_state.STATE}, bucket int").write.partitionBy("bucket").parquet(f"{path}/data/batch=4")
    assert {tuple(r) for r in url_state.state(spark, path).collect()} == known
    assert url_state.merge_batch(path, own, 4)
    assert {r["url"]: r["n_rows"] for r in url_state.state(spark, path).collect()} == {k[0]: 2 * k[4] for k in known}


@pytest.mark.parametrize("rows", [[], [("http://a", None, 0, "s"), (None, 1, 0, "s")]])
def test_empty_batches(spark, tmp_path, rows):
    path = str(tmp_path / "state")
    assert url_state.merge_batch(path, spark.createDataFrame(rows, UNION), 0) and not url_state.merge_batch(path, spark.createDataFrame(rows, UNION), 0)
    assert url_state.corpus(spark, path, ["a"]).count() == 0

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lurescope.functions.text import REDACTIONS
from lurescope.operators import dedup, split
from lurescope.plans import text_corpus, url_corpus
from lurescope.sources import labels, tables
from test_text import py_clean, py_redact


def test_source_labels(spark):
    b = spark.createDataFrame([(" u ", " Phishing "), ("v", "LEGITIMATE"), ("w", "unknown"), ("x", None)], "url string, type string")
    assert [(r.url, r.label) for r in labels.urls_text_label(b).collect()] == [(" u ", 0), ("v", 1)]
    c = spark.createDataFrame([("u", "1.0"), ("v", None), ("w", "0"), ("x", "junk"), ("y", "1.9")], "URL string, ClassLabel string")
    assert [(r.url, r.label) for r in labels.urls_nullable_label(c).collect()] == [("u", 1), ("w", 0), ("y", 1)]
    a = spark.createDataFrame([("u", "0"), ("v", None), ("w", "junk"), ("x", "1")], "URL string, label string")
    assert [(r.url, r.label) for r in labels.urls_int_label(a).collect()] == [("u", 0), ("x", 1)]
    e = spark.createDataFrame([(0,), (1,), (None,)], "label int")
    assert [r[0] for r in e.select(labels.flip_label(F.col("label"))).collect()] == [1, 0, -1]


def source(spark, rows, name):
    return spark.createDataFrame(rows, "url string, label int").withColumn("source", F.lit(name))


def test_conflicts_and_priority(spark):
    a = source(spark, [("x ", 0), ("y", 1), (None, 1)], "a")
    b = source(spark, [("x", 0), ("y", 0), ("z", 1), ("z", 1)], "b")
    union = labels.union_sources([b, a])
    got = {(r.url, r.label, r.source) for r in dedup.url_corpus(union, ["b", "a"]).collect()}
    assert got == {("x", 0, "b"), ("z", 1, "b"), ("", 1, "a")}
    assert [(r.url, r.n_rows) for r in dedup.conflicting_urls(union).collect()] == [("y", 2)]


def test_null_labels_neither_conflict_nor_claim_a_url(spark):
    a = source(spark, [("x", None), ("y", None)], "a")
    b = source(spark, [("x", 1)], "b")
    union = labels.union_sources([a, b])
    assert [(r.url, r.label, r.source) for r in dedup.url_corpus(union, ["a", "b"]).collect()] == [("x", 1, "b")]
    assert dedup.conflicting_urls(union).count() == 0


def test_long_messages_stay(spark):
    rows = [(1, "word " * 12_000, "Safe Email"), (2, "short", "Safe Email"), (3, "a phishing text", "Phishing Email")]
    frame = spark.createDataFrame(rows, "row_id long, text string, label_raw string")
    assert sorted(r["row_id"] for r in text_corpus.clean_corpus(frame).collect()) == [1, 3]
    assert [r["row_id"] for r in text_corpus.clean_corpus(frame, max_chars=50_000).collect()] == [3]
    report = text_corpus.readiness_text(frame).first()
    assert (report["final_rows"], report["removed_length_outliers"]) == (2, 1)


def test_one_url_holding_a_third_of_all_rows(spark):
    hot = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), "id")).alias("url"),
                                     F.lit(1).alias("label"), F.lit("a").alias("source"))
    out = dedup.url_corpus(labels.union_sources([hot]), ["a"])
    assert out.count() == 40_001
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("partitions", [1, 7])
def test_split_quotas_and_membership(spark, partitions):
    rng = random.Random(4)
    rows = [(i, rng.choice([0, 0, 0, 1, None])) for i in range(503)]
    frame = spark.createDataFrame(rows, "key int, label int").repartition(partitions)
    got = {r["key"]: r["split"] for r in split.stratified_split(frame, "key", "label").collect()}
    strata = defaultdict(list)
    for key, label in rows:
        strata[label].append(key)
    for keys in strata.values():
        keys.sort(key=lambda k: hashlib.md5(f"{k}|42".encode()).hexdigest())
        train = len(keys) * 8 // 10
        val = train + (len(keys) - train) // 2
        assert [got[k] for k in keys] == ["train"] * train + ["val"] * (val - train) + ["test"] * (len(keys) - val)


def test_split_tiny_strata_and_repeated_keys(spark):
    frame = spark.createDataFrame([(1, "a")] + [(2, "b")] * 30 + [(i, "c") for i in range(3, 13)], "key int, s string")
    rows = split.stratified_split(frame, "key", "s").collect()
    assert len(rows) == 41
    assert len({r["split"] for r in rows if r["key"] == 2}) == 1
    assert [r["split"] for r in rows if r["s"] == "a"] == ["test"]


def test_split_falls_back_to_a_shuffle_join(spark, monkeypatch):
    frame = spark.range(400).select("id", (F.col("id") % 5).alias("s"))
    small = sorted(map(tuple, split.stratified_split(frame, "id", "s").collect()))
    monkeypatch.setattr(split, "MAX_BROADCAST_STRATA", 2)
    assert sorted(map(tuple, split.stratified_split(frame, "id", "s").collect())) == small


def test_samples(spark):
    frame = spark.range(1000).select("id", (F.col("id") % 3).alias("s"))
    want = sorted(range(1000), key=lambda k: hashlib.md5(f"{k}|42".encode()).hexdigest())
    assert [r["id"] for r in split.seeded_sample(frame, "id", 8).collect()] == want[:8]
    per = split.sample_per_class(frame, "id", "s", 4)
    assert {r["id"] for r in per.collect()} == {k for s in range(3) for k in [w for w in want if w % 3 == s][:4]}
    assert "WindowGroupLimit" in per._jdf.queryExecution().executedPlan().toString()


RAW = [
    (0, "call me at 555-123-4567 now", "Safe Email"), (1, "call me at 555-123-4567 now", "Phishing Email"),
    (2, "call  me at\n555-123-4567 now", "Phishing Email"), (3, None, "Safe Email"), (4, "short", "Safe Email"),
    (5, "a                b", "Safe Email"), (6, "unlabelled first copy", None),
    (7, "unlabelled first copy", "Safe Email"), (8, "mail x@y.example today", "Phishing Email"),
    (9, "mail z@y.example today", "Phishing Email"), (10, "z" * 50_001, "Safe Email"), (11, "short", "Safe Email"),
    (12, None, None), (13, "odd label here", "Spam"),
]


def brute_clean():
    steps = {"removed_null_bodies": sum(t is None for _, t, _ in RAW)}
    rows = [r for r in RAW if r[1] is not None]

    def first(rows):
        seen, out = set(), []
        for r in rows:
            if r[1] not in seen:
                seen.add(r[1])
                out.append(r)
        return out

    unique = first(rows)
    steps["removed_exact_duplicates"] = len(rows) - len(unique)
    sized = [r for r in unique if 10 <= len(r[1]) <= 50_000]
    steps["removed_length_outliers"] = len(unique) - len(sized)
    cleaned = first([r for r in ((i, py_clean(t), c) for i, t, c in sized) if len(r[1]) >= 10])
    steps["removed_post_clean_empty_or_dup"] = len(sized) - len(cleaned)
    for token, _ in REDACTIONS:
        steps[f"redacted_{token[1:-1].lower()}"] = sum(py_redact(t)[1][token] for _, t, _ in cleaned)
    code = {"Safe Email": 0, "Phishing Email": 1}
    return steps, sorted((i, py_redact(t)[0], code[c]) for i, t, c in cleaned if c in code)


def test_clean_corpus_and_report(spark):
    frame = spark.createDataFrame(RAW, "row_id long, text string, label_raw string").repartition(3)
    steps, want = brute_clean()
    assert sorted(map(tuple, text_corpus.clean_corpus(frame, max_chars=50_000).collect())) == want
    report = text_corpus.readiness_text(frame, max_chars=50_000).first().asDict()
    assert {k: report[k] for k in steps} == steps
    assert report["loaded_rows"] == len(RAW) and report["final_rows"] == len(want)
    removed = sum(v for k, v in steps.items() if k.startswith("removed")) + report["removed_unlabelled"]
    assert report["loaded_rows"] - removed == report["final_rows"]


def test_prepared_corpus_has_unit_scaled_train(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"http://{'www.' * rng.randint(0, 1)}h{rng.randint(0, 99)}.example/{i}?q={rng.random()}", i % 2) for i in range(200)]
    ready = url_corpus.prepare(labels.union_sources([source(spark, rows, "a")]), ["a"], ["has_https"])
    assert len(ready.features) == 23
    train = ready.scaled.where(F.col("split") == "train")
    for name in ready.features:
        mean, std = train.agg(F.avg(name), F.stddev_pop(name)).first()
        assert mean == pytest.approx(0, abs=1e-9) and (std == pytest.approx(1, abs=1e-9) or std == 0)
    ready.write(str(tmp_path))
    back = tables.read_parquet(spark, f"{tmp_path}/splits")
    assert back.count() == 200 and {r["split"] for r in back.select("split").distinct().collect()} == {"train", "val", "test"}
    legit = tables.read_parquet(spark, f"{tmp_path}/legit_only")
    assert "label" not in legit.columns and legit.count() == 80


def test_csv_and_json_sinks(spark, tmp_path):
    rows = [(1, 'a "quoted", text\nwith lines'), (2, "  padded  "), (3, "")]
    frame = spark.createDataFrame(rows, "id int, text string")
    tables.write_csv(frame, f"{tmp_path}/c")
    back = tables.read_csv(spark, f"{tmp_path}/c", ["text", "id"], multi_line=True)
    assert sorted((int(r["id"]), r["text"] or "") for r in back.collect()) == rows
    report = spark.createDataFrame([("dedup", "rows", 5), ("dedup", "kept", 4)], "section string, name string, value long")
    tables.write_json_report(report, f"{tmp_path}/r")
    assert spark.read.json(f"{tmp_path}/r").first()["values"].asDict() == {"kept": 4, "rows": 5}

"""The pipeline's stages, each against what its operator decides in plain Python."""

import corpus_pipeline
import numpy as np
import pytest

from lurescope.llm.queries import ORACLES, REGISTRY


@pytest.fixture(scope="module")
def folder(spark, documents, odd, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rng = np.random.default_rng(12)
    plain = {"en": [f"the{c}ing" for c in "abcdefghijklmnop"], "fr": [f"é{c}eaux" for c in "abcdefghijklmnop"]}
    rows, marks = [], []
    for i in range(300):
        lang = ("en", "fr")[i % 2]
        words = list(rng.choice(plain[lang], 30)) + (["awful", "rotten"] if i % 10 == 4 else [])
        rows.append((1000 + i, " ".join(map(str, words)), lang))
        marks.append((1000 + i, 1, int(i % 10 == 4)))
    rows += [(2000, rows[3][1], "fr"), (2001, rows[3][1], None), (2002, "12 34 !!", None)]
    rows += [(2003, rows[5][1] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', None)]
    rows += [(k, t, None) for k, t in odd]
    documents(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, folder).persist()
        seen[name] = kept
        if name != "best_fit_packing":
            assert kept.columns == docs.columns
    ids = {name: [r["doc_id"] for r in frame.collect()] for name, frame in seen.items()}
    toxic = {1000 + i for i in range(300) if i % 10 == 4}
    assert not toxic & set(ids["toxicity"])
    assert set(ids["toxicity"]) | toxic == {r["doc_id"] for r in docs.collect()}
    assert not {2002, 7, 8, 9} & set(ids["language_id"])
    assert {2000, 2001, 2003} <= set(ids["language_id"])
    assert not {2000, 2001} & set(ids["simhash_near_dedup"]) and 1003 in ids["simhash_near_dedup"]
    assert len(ids["simhash_near_dedup"]) == len(set(ids["simhash_near_dedup"]))
    assert sorted(map(str, ids["secret_scan"])) == sorted(map(str, ids["simhash_near_dedup"]))
    texts = {r["doc_id"]: r for r in seen["secret_scan"].collect()}
    assert "<secret>" in texts[2003]["text"] and texts[2003]["lang"] == "fr"
    assert texts[2003]["n_chars"] == len(texts[2003]["text"])
    assert set(map(str, ids["best_fit_packing"])) == set(map(str, ids["secret_scan"]))


def test_run_and_empty_tables(spark, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() > 0
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 14))
    assert set(ORACLES) <= set(REGISTRY)

"""Token counts by spliced chunks against the tokenizers library on whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from lurescope.llm import byte_bpe, token_counts

FULL = byte_bpe.tokenizer(byte_bpe.vocabulary_path(f"{byte_bpe.VOCABULARY}.json"))
PARTS = [
    "hello", " world", "  ", "\n\n", "\t", " \n ", "don't", "'s", "'ll", " 123", "4567", "...", "!?", "日本語の文", "。", "é", "Ünï",
    "<|endoftext|>", "<|endof", "text|>", " ", " ", "👩‍👩‍👧", "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx", "\x85", "a1b2", "-", "'", "क्षि", "﻿",
]


def size(text):
    return len(FULL.encode(text or "", add_special_tokens=False).ids)


def mixed(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(PARTS) for _ in range(n))


def test_stable_places_are_word_ends_in_every_window():
    rng = random.Random(2)
    for seed in range(40):
        text = mixed(seed, 60)
        for p in range(1, len(text)):
            if not token_counts.is_stable(text[p - 1], text[p]):
                continue
            lo, hi = rng.randrange(0, p), rng.randrange(p, len(text)) + 1
            if "<|" in text[lo:hi]:
                continue  # a special token around p is kept out by its length
            pieces = FULL.pre_tokenizer.pre_tokenize_str(text[lo:hi])
            assert p - lo in {a for _, (a, _) in pieces}, (text[lo:hi], p - lo)


@pytest.mark.parametrize("chunk,overlap", [(50, 30), (97, 40), (300, 64), (40, 4)])
def test_equals_the_library(spark, documents, odd, chunk, overlap):
    rows = [*odd, *((100 + i, mixed(i, 20 * (i % 12))) for i in range(36)), (200, "日" * 5000), (201, "a b" * 900), (202, "<|endoftext|>" * 200)]
    docs = documents(rows)
    found = token_counts.with_counts(docs, chunk=chunk, overlap=overlap, limit=100)
    assert found.columns == [*docs.columns, "n_bytes", "n_tokens", "over_limit"]
    got = sorted((str(r["doc_id"]), r["n_chars"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found.collect())
    want = sorted((str(k), len(t or ""), len((t or "").encode()), size(t), size(t) > 100) for k, t in rows)
    assert got == want


def test_failed_splices_go_another_round(spark):
    text = "word " * 20 + "x" * 900 + " word" * 20
    docs = spark.createDataFrame([("a", text), ("b", "plain words here " * 60), ("a", text)], "digest string, text string")
    first = {r["digest"]: r["n_tokens"] for r in token_counts.spliced(docs, 100, 32, byte_bpe.VOCABULARY).collect()}
    assert first == {"a": None, "b": size("plain words here " * 60)}
    assert {r["digest"]: r["n_tokens"] for r in token_counts.huge_counts(docs, 100, 32).collect()} == {"a": size(text), "b": first["b"]}


def test_empty_table_and_clashing_names(spark, documents):
    docs = documents([(1, "some words here " * 30), (2, None)]).withColumn("N_TOKENS", F.lit("mine")).withColumn("__digest", F.lit(1))
    found = token_counts.with_counts(docs, chunk=64, overlap=40)
    assert {r["doc_id"]: r["n_tokens"] for r in found.collect()} == {1: size("some words here " * 30), 2: 0}
    assert "N_TOKENS" not in found.columns and "__digest" in found.columns
    assert token_counts.with_counts(docs.limit(0)).count() == 0

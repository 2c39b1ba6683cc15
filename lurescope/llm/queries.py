"""Registered queries of the language-model data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lurescope.llm import bpe_codec, brown, language, licenses, maxscore, minhash, packing, prefix_trie, secrets, simhash
from lurescope.llm import token_counts, toxicity, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.fit_and_score(_table(spark, sf_dir, "documents"))


def op2_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.quantised(_table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors, vectors.where("key % 50 = 0"))


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(_table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secrets")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.written(spans, secrets.KINDS[:3]), 256).alias("base_sha256"),
        secrets.written(spans, secrets.KINDS).alias("spans"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit_on_labels(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(~toxicity.may_learn(), F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "evidence",
    )


def op9_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.edited_pairs(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(language.may_learn()))
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id",
        F.coalesce(~language.may_learn(), F.lit(False)).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
    )


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_counts(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_brown_scores": op1_brown_scores,
    "op2_maxscore_top_k": op2_maxscore_top_k,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_secret_scan": op5_secret_scan,
    "op6_license_scan": op6_license_scan,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_toxicity": op8_toxicity,
    "op9_one_permutation_minhash": op9_one_permutation_minhash,
    "op10_language_id": op10_language_id,
    "op11_token_counts": op11_token_counts,
    "op12_whitening": op12_whitening,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {"op2_maxscore_top_k": maxscore.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}

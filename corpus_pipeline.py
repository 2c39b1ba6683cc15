"""A training corpus from raw documents: five stages, each over all that the one before kept.

Toxic documents go, documents without a known language go, one document of each near-duplicate group
stays, secrets are replaced, and what is left is packed into sequences. Every stage is a function
(spark, docs, sf_dir) -> DataFrame; all but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lurescope.llm import arrow_text, language, packing, secrets, simhash, toxicity
from lurescope.session import broadcast_if_small, materialise

#: Documents whose predicted language is less likely than this are rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: Most of the examples without the mark that the toxicity stage may reject.
TOXIC_LOSS = 0.05
#: Most digests of rejected texts that are broadcast; with more the documents are shuffled by digest.
MOST_BROADCAST = 1 << 16

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the rejecting score; the model learns from the labelled ones among ``docs``.

    That score tells the examples apart best, each judged by the others, and would reject at most
    ``TOXIC_LOSS`` of those not marked. Texts without any example like them, such as null and empty ones,
    stay; repeated rows share their fate. Without labels of both kinds all rows stay.
    """
    model = toxicity.fit_on_labels(docs, _table(spark, sf_dir, "labels"))
    # A score depends on the text alone, so texts are judged by themselves and only digests come back.
    scored = toxicity.score(docs.select("text"), model, evidence=1)
    bad = (F.col("toxicity") >= model.threshold(TOXIC_LOSS)) & (F.size("evidence") > 0)
    digest = arrow_text.free_name(docs, "digest")
    rejected = materialise(scored.where(bad).select(F.sha2("text", 256).alias(digest)).distinct(), "rejected")
    named = docs.withColumn(digest, F.sha2("text", 256))
    return named.join(broadcast_if_small(rejected, MOST_BROADCAST), digest, "left_anti").select(*docs.columns)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; a lang that is null is filled with it.

    The model learns from the documents with a lang; texts that are null or have no letter go. If no
    document has a lang nothing can be found, so all documents with letters stay as they are.
    """
    model = language.fit(docs.where(language.may_learn()))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs, model)
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id."""
    return simhash.keep_one(docs).select(*docs.columns)


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in the text and n_chars counted anew where one was."""
    return secrets.redact(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their sequence and place."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", replace_secrets),
    ("best_fit_packing", pack_sequences),
]

#: The stages fit models and encode bytes, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each stored in the shared folder and read by the next."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs

"""Representative inputs built from the given tables: messages with URLs, labelled URL sources,
and a score table. ``checks/oracles.py`` states the same inputs in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(email_id, body, label): documents with page URLs and an SSN worked in; 1 = phishing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    page = F.col("page_id")
    links = pages.select((page * 4).alias("doc_id"), "page_id", "url").unionByName(
        pages.select(((page - page % 2) * 4 + 1).alias("doc_id"), "page_id", "url")
    )
    pair = F.struct("page_id", "url")
    wide = links.groupBy("doc_id").agg(
        F.min(pair)["url"].alias("u1"),
        F.when(F.count(F.lit(1)) > 1, F.max(pair)["url"]).alias("u2"),
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    joined = docs.join(wide, "doc_id", "left").join(labels, "doc_id", "left")
    body = F.concat(
        "text",
        F.when(F.col("u1").isNull(), "").otherwise(F.concat(F.lit(" see "), "u1")),
        F.when(F.col("u2").isNull(), "").otherwise(F.concat(F.lit(" or <"), "u2", F.lit(">"))),
        F.when(F.col("doc_id") % 11 == 0, " SSN 123-45-6789 C:\\new").otherwise(""),
    )
    return joined.select(
        F.col("doc_id").alias("email_id"), body.alias("body"), F.col("toxic").cast("int").alias("label")
    )


def labelled_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, text, label_raw) in the shape of the labelled message source."""
    label = F.col("label")
    return emails(spark, sf_dir).select(
        F.col("email_id").alias("row_id"),
        F.when(F.col("email_id") % 97 != 0, F.col("body")).alias("text"),
        F.when(label == 0, "Safe Email").when(label == 1, "Phishing Email").alias("label_raw"),
    )


def url_source_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with a 0/1 label, some of them missing or unreadable."""
    page = F.col("page_id")
    label = F.when(page % 23 == 0, None).when(page % 29 == 0, "n/a").otherwise((page % 2).cast("string"))
    return table(spark, sf_dir, "pages").select(F.col("url").alias("URL"), label.alias("label"), page.alias("row"))


def url_source_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    kind = F.when(page % 17 == 0, "unknown").when(page % 2 == 0, " Phishing ").otherwise("LEGITIMATE")
    return table(spark, sf_dir, "pages").select("url", kind.alias("type"), page.alias("row"))


def url_source_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    label = F.when(page % 19 == 0, None).when(page % 15 == 0, 1 - page % 2).otherwise(page % 2)
    return table(spark, sf_dir, "pages").select(
        F.col("url").alias("URL"), label.cast("double").alias("ClassLabel"), page.alias("row")
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, score, score2, y, split): two scores and a binary target per lineitem row."""
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("key"),
        (F.col("l_extendedprice") / 1e5).alias("score"),
        (F.col("l_quantity") / 50).alias("score2"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.when(F.col("l_orderkey") % 2 == 0, "val").otherwise("test").alias("split"),
    )

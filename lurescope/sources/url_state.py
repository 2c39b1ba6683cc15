"""What is known of every URL, kept in buckets, so that a new source costs its own size and not the corpus's.

A state is a folder: ``data/batch=k/bucket=b`` holds the URLs of bucket b as batch k left them, and
``manifest/batch=k`` one small file that says which batch each bucket is current at. A batch groups its
own rows, reads only the buckets its URLs fall into, and writes these anew beside the old ones. Its manifest
comes last, in one file, so a batch that dies changes nothing and one that is sent again is not counted
twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.dedup import group_urls

BUCKETS = 256
STATE = "url string, label int, label_max int, priority int, n_rows long"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, int], int]:
    """The last batch (-1 before any), the batch that each bucket is current at, and the number of buckets."""
    folder = f"{path}/manifest"
    if not _exists(spark, folder):
        return -1, {}, 0
    rows = spark.read.schema("bucket int, at long, buckets int, batch long").parquet(folder)
    last = rows.agg(F.max("batch")).first()[0]
    if last is None:
        return -1, {}, 0
    # One row per bucket, and one (-1) so that a state without URLs is known too.
    found = rows.where(F.col("batch") == last).collect()
    return last, {r["bucket"]: r["at"] for r in found if r["bucket"] >= 0}, found[0]["buckets"]


def _read(spark: SparkSession, path: str, current: dict[int, int], buckets: Sequence[int]) -> DataFrame:
    folders = [f"{path}/data/batch={current[b]}/bucket={b}" for b in buckets if b in current]
    if not folders:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(*folders)


def state(spark: SparkSession, path: str) -> DataFrame:
    """(url, label, label_max, priority, n_rows) of every URL: label range, best source, labelled rows."""
    _, current, _ = manifest(spark, path)
    return _read(spark, path, current, sorted(current))


def merge_batch(path: str, union: DataFrame, batch: int, buckets: int = BUCKETS) -> bool:
    """Merge the rows of ``union`` (url, label, priority) into the state; False if ``batch`` was merged before.

    Batches are numbered upwards. ``buckets`` counts when the state is new. Rows without a label or a URL
    leave no trace, and an empty batch only its number.
    """
    spark = union.sparkSession
    last, current, known = manifest(spark, path)
    if batch <= last:
        return False
    buckets = known or buckets
    bucket = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int").alias("bucket")
    new = group_urls(union.where(F.col("url").isNotNull()))
    data = f"{path}/data/batch={batch}"
    # At most one row per bucket.
    touched = sorted(r["bucket"] for r in new.select(bucket).distinct().collect())
    both = _read(spark, path, current, touched).unionByName(new.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in STATE.split(", "))))
    merged = both.groupBy("url").agg(
        F.min("label").alias("label"),
        F.max("label_max").alias("label_max"),
        F.min("priority").alias("priority"),
        F.sum("n_rows").alias("n_rows"),
    )
    if touched:
        merged.select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
    rows = [(-1, batch, buckets), *((b, at, buckets) for b, at in ({**current, **dict.fromkeys(touched, batch)}).items())]
    listed = spark.createDataFrame(rows, "bucket int, at long, buckets int")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch={batch}")
    return True


def corpus(spark: SparkSession, path: str, sources: Sequence[str]) -> DataFrame:
    """(url, label, source) of the URLs without conflict, as ``url_corpus`` has them over all batches together."""
    names = F.array(*[F.lit(s) for s in sources])
    kept = state(spark, path).where(F.col("label") == F.col("label_max"))
    return kept.select("url", "label", F.get(names, F.col("priority")).alias("source"))

"""Session defaults and the shared working folder used for cut lineage and sink output."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "lurescope", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect; cluster defaults win where already set."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or else one in the warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stages"


_written: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def remove_stage(spark: SparkSession, path: str) -> None:
    """Delete a stage that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


@contextmanager
def stage_scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the stages written within it; read the results inside the scope."""
    before = len(_written)
    try:
        yield
    finally:
        for path in _written[before:]:
            remove_stage(spark, path)


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as parquet in the shared folder and read it back.

    Used where one expensive frame feeds several passes. Unlike a cached frame it survives the
    loss of executors, and unlike an RDD checkpoint it keeps column pruning for later reads.
    ``stage_scope`` removes such stages; without it the folder's own retention rule does.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_copy(df: DataFrame, max_rows: int) -> DataFrame | None:
    """A driver-held copy of ``df`` if it has at most ``max_rows`` rows, else None.

    Never more than ``max_rows`` + 1 rows reach the driver.
    """
    rows = df.limit(max_rows + 1).toArrow()
    return None if rows.num_rows > max_rows else df.sparkSession.createDataFrame(rows, df.schema)


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` once it is known to have at most ``max_rows`` rows.

    A larger frame is returned without a hint, so the join shuffles on its key instead.
    """
    small = local_copy(df, max_rows)
    return df if small is None else F.broadcast(small)

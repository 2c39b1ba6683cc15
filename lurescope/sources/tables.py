"""Readers and writers. CSV columns are read as text and cast explicitly, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool = False) -> DataFrame:
    """Text columns of a CSV with header; only ``columns`` are parsed out of each row.

    ``multi_line`` allows quoted line breaks (message bodies). Such files cannot be split, so a
    large corpus should arrive as many files.
    """
    frame = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )
    return frame.select(*[F.col(f"`{c}`") for c in columns])


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    frame = spark.read.parquet(path)
    return frame.select(*columns) if columns else frame


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite ``path``; splits are written as one table partitioned by the split column."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that :func:`read_csv` reads back unchanged, but for empty strings: those read as null."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def report_rows(wide: DataFrame, section: str) -> DataFrame:
    """A one-row report as (section, name, value) rows; flags become 0 and 1."""
    numbers = wide.select(*(F.col(c).cast("double").alias(c) for c in wide.columns))
    rows = numbers.unpivot([], wide.columns, "name", "value")
    return rows.select(F.lit(section).alias("section"), "name", "value")


def read_json_report(spark: SparkSession, path: str) -> DataFrame:
    """(section, name, value) rows of a written report."""
    frame = spark.read.schema("section string, values map<string, double>").json(path)
    return frame.select("section", F.explode("values").alias("name", "value"))


def write_json_report(report: DataFrame, path: str) -> None:
    """Write a (section, name, value) report as one JSON object per section."""
    body = report.groupBy("section").agg(
        F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("values")
    )
    body.write.mode("overwrite").json(path)

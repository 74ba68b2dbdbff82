"""Sinks. Partitioned outputs are dealt by their partition columns first, so that few files are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(rows: DataFrame, path: str, kind: str = "parquet", *, mode: str = "overwrite", by: tuple[str, ...] = (), max_records: int | None = None, **options) -> str:
    writer = (rows.hint("rebalance", *by) if by else rows).write.mode(mode).format(kind).options(**options)
    if by:
        writer = writer.partitionBy(*by)
    if max_records:
        writer = writer.option("maxRecordsPerFile", max_records)
    writer.save(path)
    return path


def write_single_csv(rows: DataFrame, path: str) -> str:
    """One CSV file with a header; for small results."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"')
    return path


def convert(spark: SparkSession, source: str, target: str, from_kind: str = "orc", to_kind: str = "parquet") -> str:
    return write(spark.read.format(from_kind).load(source), target, to_kind)


def listing_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """path and state (missing, extra, size) where two listings (path, length) differ."""
    both = left.withColumnRenamed("length", "a").join(right.withColumnRenamed("length", "b"), "path", "full")
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "size")
    return both.select("path", state.alias("state")).filter("state IS NOT NULL")

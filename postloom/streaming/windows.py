"""Structured Streaming forms of the batch operators: duplicates, windows and sessions under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def posts(spark, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream; its checkpoint remembers which were read."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def distinct_posts(stream: DataFrame, key: str, at: str, delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed_users(stream: DataFrame, user: str, at: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """start, n and about how many users of each window; exact distinct counts need state for every user."""
    by = stream.withWatermark(at, delay).groupBy(F.window(at, width))
    return by.agg(F.count("*").alias("n"), F.approx_count_distinct(user).alias("n_users")).select(F.col("window.start").alias("start"), "n", "n_users")


def sessions(stream: DataFrame, user: str, at: str, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """A user's active periods: start, end and number of posts."""
    by = stream.withWatermark(at, delay).groupBy(user, F.session_window(at, gap).alias("s"))
    return by.agg(F.count("*").alias("n")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def drain(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all there is, into Parquet, and stop."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()

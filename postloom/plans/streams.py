"""Streams that are run to their end, so that batch SQL can check them."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom.plans.registry import query
from postloom.session import table
from postloom.sources.readers import scratch
from postloom.streaming import windows


#: Rows of a file at most, about. A file is a micro-batch, so neither its tasks nor the state grow with the table.
ROWS = 1 << 22


def _stream(spark, sf_dir, rows=None):
    """Events twice over, in files, and a late closing event that moves the watermark past all others.

    Each file holds a span of time. Files are written one after the other and read in that order, so no event comes behind the watermark.
    """
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    path, twice = scratch(spark), events.unionByName(events)
    spans = -(-2 * events.count() // (rows or ROWS))
    if spans > 1:
        twice.repartitionByRange(spans, "ts").write.parquet(f"{path}-spans")
        files = sorted(spark.read.schema(events.schema).parquet(f"{path}-spans").inputFiles(), key=lambda f: f.rpartition("/")[2])  # by their partitions' numbers
        parts = [spark.read.schema(events.schema).parquet(f) for f in files]
    else:
        parts = [twice]
    for k, part in enumerate(parts):  # small row groups, so that tasks share a file
        part.coalesce(1).write.option("parquet.block.size", 1 << 24).parquet(f"{path}/a{k:05d}")
    last = spark.createDataFrame([(-1, -1)], "event_id long, user_id long").withColumn("ts", F.lit("2030-01-01 00:00:00").cast("timestamp"))
    last.coalesce(1).write.parquet(f"{path}/b")
    return windows.posts(spark, f"{path}/*", events.schema, 1), path


def _drained(spark, stream, path):
    windows.drain(stream, f"{path}-out", f"{path}-checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{path}-out")


@query("SELECT event_id FROM events")
def stream_dedupe(spark, sf_dir):
    stream, path = _stream(spark, sf_dir)
    return _drained(spark, windows.distinct_posts(stream, "event_id", "ts").select("event_id"), path).filter("event_id >= 0")


@query("SELECT date_trunc('day', ts) AS start, 2 * count(*) AS n FROM events GROUP BY 1")
def stream_windowed_counts(spark, sf_dir):
    stream, path = _stream(spark, sf_dir)
    done = _drained(spark, windows.windowed_users(stream, "user_id", "ts"), path)
    return done.filter(F.year("start") < 2030).select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events),
     s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", 2 * count(*) AS n FROM s GROUP BY user_id, k
""")
def stream_sessions(spark, sf_dir):
    stream, path = _stream(spark, sf_dir)
    done = _drained(spark, windows.sessions(stream, "user_id", "ts", "6 hours"), path).filter("user_id >= 0")
    return done.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")

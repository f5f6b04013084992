"""Structured Streaming over media events and landing folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total of events (ts, event_type, value), batch or stream; later events than late are left out of a stream."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, session_start, session_end, n: runs of events with no gap as long as gap."""
    df = events.withWatermark("ts", late) if events.isStreaming else events
    return df.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def watch_folder(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """New media files under path as a stream of (path, modificationTime, length, content)."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path)

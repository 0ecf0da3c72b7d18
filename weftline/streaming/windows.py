"""Event-time windows over a stream or a batch of events; an extension beyond the workflow operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str) -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late) if events.isStreaming else timed


def tumbling(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count and sum of each event type and window; sliding if ``slide`` is given."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = _timed(events, late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: start, end and count."""
    out = _timed(events, late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def distinct(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """First event of each key within the watermark; of a batch, of all."""
    timed = _timed(events, late)
    return timed.dropDuplicatesWithinWatermark(keys) if events.isStreaming else timed.dropDuplicates(keys)


def stream(spark: SparkSession, folder: str, like: DataFrame, pattern: str = "*.parquet") -> DataFrame:
    """A stream of the Parquet files of a folder."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", pattern).parquet(folder)

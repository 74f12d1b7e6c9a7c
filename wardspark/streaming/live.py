"""Telemetry as a stream: deduplication, daily counts, presence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.telemetry import is_flagged


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, files_at_once: int = 64) -> DataFrame:
    """A folder of Parquet event files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def deduplicated(events: DataFrame, lateness: str = "1 day", key: str = "event_id", ts: str = "created_at") -> DataFrame:
    """Each event once, as long as its repeats are not later than ``lateness``; state is bounded by it."""
    marked = events if events.schema[ts].metadata.get("spark.watermarkDelayMs") else events.withWatermark(ts, lateness)
    return marked.dropDuplicatesWithinWatermark([key])


def daily_counts(events: DataFrame, lateness: str = "1 day", ts: str = "created_at") -> DataFrame:
    """Requests and flagged events by company and day, in tumbling windows. A watermark that is there stays."""
    marked = events if events.schema[ts].metadata.get("spark.watermarkDelayMs") else events.withWatermark(ts, lateness)
    counted = marked.groupBy(F.window(ts, "1 day"), "company_slug").agg(
        F.count(F.when(F.col("event_type").isin("message_sent_to_ai", "message_blocked"), 1)).alias("requests"), F.count(F.when(is_flagged(), 1)).alias("flagged")
    )
    return counted.select("company_slug", F.to_date("window.start").alias("day"), "requests", "flagged")


def presence(events: DataFrame, lateness: str = "1 day", ts: str = "created_at") -> DataFrame:
    """Last time that each user was seen on each day; the newest row of a user counts.

    A day's users leave the state once it is over by ``lateness``, so the state holds who was there of late and not all
    who ever were. Update mode gives a row with each change, append mode one when the day is over.
    """
    marked = events if events.schema[ts].metadata.get("spark.watermarkDelayMs") else events.withWatermark(ts, lateness)
    return marked.groupBy(F.window(ts, "1 day"), "company_slug", "install_id").agg(F.max(ts).alias("last_seen")).drop("window")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there, write it as Parquet and read it back."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)

"""Windowed counts over a stream of events, with the same plan for a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total): tumbling windows; on a stream, state older than ``late`` behind the newest event is dropped.

    ``late`` is None where the stream has a watermark already, as after ``first_seen``.
    """
    marked = events.withWatermark("ts", late) if events.isStreaming and late else events
    counts = marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def stream_of(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """The parquet files of a folder as a stream."""
    schema = spark.read.parquet(folder).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def first_seen(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events whose id hasn't been seen within the watermark: repeated deliveries are dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])

"""Resumable ingestion: files that arrive are normalised once, and counts by time window are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_new_files(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, transform=lambda df: df) -> None:
    """Appends files of `source` that weren't seen before to `target`; a restart goes on where the last run ended."""
    stream = transform(spark.readStream.schema(schema).parquet(source))
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n over tumbling windows of a stream or table with ts and event_type."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if timed.isStreaming else timed
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")

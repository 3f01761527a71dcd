"""Windowed aggregates that serve a batch and a stream alike, and an append-only log with idempotent batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type; late rows beyond the watermark are dropped in a stream, never in a batch."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user, closed by a gap."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def append_log(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream to a log of Parquet files, one folder per micro-batch, so a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_log(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder)


def sliding(events: DataFrame, width: str = "2 hours", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per event type in sliding windows; on a stream, events later than `late` are dropped."""
    at = events.withWatermark("ts", late) if events.isStreaming else events
    return at.groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")

"""Streams of documents and events with Structured Streaming. Every state has a watermark, so it stays bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.functions.text import clean_text, content_hash


def read_stream(spark: SparkSession, path: str, schema: str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def new_documents(stream: DataFrame, within: str = "1 day") -> DataFrame:
    """Cleaned documents, each hash once within the watermark. stream has ts, filename, content."""
    cleaned = stream.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("content", clean_text("content")).withColumn("hash", content_hash("content"))
    return cleaned.withWatermark("ts", within).dropDuplicatesWithinWatermark(["hash"])


def windowed(stream: DataFrame, key: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(window_start, key, n, total) over tumbling or sliding windows of ts."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = timed.groupBy(w.alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), "key", "n", "total")


def sessions(stream: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, session_start, session_end, n): runs of events no further apart than the gap."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    s = timed.groupBy(F.session_window("ts", gap).alias("s"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return s.select("key", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def to_parquet(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()

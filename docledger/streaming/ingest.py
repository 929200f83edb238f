"""Structured Streaming counterparts of ingest: an append-only log, windowed request caps, a re-sending sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def log_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """New JSON-line files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def over_limit(requests: DataFrame, limit: int, window: str = "60 seconds", late: str = "60 seconds") -> DataFrame:
    """Clients that exceed limit requests in a tumbling window, on (ts, client); windows close after the watermark."""
    counts = requests.withWatermark("ts", late).groupBy(F.window("ts", window), "client").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > limit).select(F.col("window.start").alias("start"), "client", "n")


def verdict_counts(records: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Records by verdict in tumbling windows of their detection."""
    return records.withWatermark("detected_at", late).groupBy(F.window("detected_at", window), "verdict").agg(F.count("*").alias("cnt")).select(F.col("window.start").alias("start"), "verdict", "cnt")


def write_log(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to a Parquet log, exactly once per checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def send(stream: DataFrame, deliver: Callable[[DataFrame, int], None], checkpoint: str):
    """Deliver each batch; a failed batch is sent again before any later one."""
    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

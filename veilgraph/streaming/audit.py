"""The audit log as a stream: windowed counts with a watermark, and request states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Events of a folder of Parquet files as a stream."""
    schema = spark.read.parquet(path).schema
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return found.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need an instant; local times are read in the session zone


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """(start, event_type, n, value): tumbling windows; state older than the watermark is dropped.  late=None keeps the watermark that events has: Spark allows one."""
    grouped = (events.withWatermark("ts", late) if late else events).groupBy(F.window("ts", window).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def deduplicated(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event_id once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; output and checkpoint belong in shared storage."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()

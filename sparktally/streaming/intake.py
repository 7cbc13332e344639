"""Streaming intake. The batch engine this follows has no streams; these are
additions: a folder of events, duplicates dropped within a watermark, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def intake(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 10) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _marked(events: DataFrame, time: str, late: str) -> DataFrame:
    """A stream with its watermark, which wants an instant; a table as it is."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events


def without_repeats(events: DataFrame, key: list[str], time: str = "ts", late: str = "1 hour") -> DataFrame:
    """First of events with an equal key within the watermark; works on streams
    (bounded state) and, exactly, on tables."""
    if events.isStreaming:
        return _marked(events, time, late).dropDuplicatesWithinWatermark(key)
    return events.dropDuplicates(key)


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Counts and values per window and event type."""
    source = _marked(events, time, late)
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return source.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", time: str = "ts", late: str = "1 hour") -> DataFrame:
    """Sessions of users without pauses longer than gap."""
    source = _marked(events, time, late)
    return source.groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")

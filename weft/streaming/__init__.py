"""Streams: windowed, sessionised and stateful aggregates of events as Structured Streaming, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def tumbling(events: DataFrame, ts: str, width: str, late: str, *keys: str, slide: str | None = None) -> DataFrame:
    """(start, end, keys, n): counts by window; events later than `late` are dropped."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = events.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sessions(events: DataFrame, ts: str, gap: str, late: str, key: str) -> DataFrame:
    """(key, start, end, n): runs of events of a key with no gap as long as `gap`."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct(events: DataFrame, ts: str, late: str, *keys: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, into a table in memory."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

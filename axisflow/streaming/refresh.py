"""Benign windows as streams: event-time sketches and refreshed references, by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def watermarked(events: DataFrame, ts: str, late: str) -> DataFrame:
    """Streams get a watermark; it needs a time with zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def windowed_mass(events: DataFrame, ts: str = "ts", cone: str = "cone", weight: str = "weight", width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Sketch weight on each cone by window; on a stream, rows later than `late` behind the watermark are left out."""
    df = watermarked(events, ts, late)
    return df.groupBy(F.window(ts, width, slide) if slide else F.window(ts, width), cone).agg(F.sum(weight).alias("mass")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), cone, "mass")


def session_counts(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key that a pause of `gap` ends, and their numbers of events."""
    df = watermarked(events, ts, late)
    return df.groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def refresh_each_batch(stream: DataFrame, refresh: Callable[[DataFrame], None], checkpoint: str) -> DataStreamWriter:
    """A writer that hands every non-empty micro-batch to `refresh`; `checkpoint` must be shared storage."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            refresh(batch)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)

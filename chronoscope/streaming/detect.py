"""Windows over events, and detection on streams; the same functions serve batch and streaming tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoscope.operators import sigma


def watermarked(events: DataFrame, time: str, late: str | None) -> DataFrame:
    return events.withWatermark(time, late) if late and events.isStreaming else events


def tumbling(events: DataFrame, time: str, length: str, *by: str, late: str | None = None) -> DataFrame:
    """(start, by..., n): events in windows of equal length."""
    e = watermarked(events.withColumn("_t", F.col(time).cast("timestamp")), "_t", late)
    return e.groupBy(F.window("_t", length), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessions(events: DataFrame, time: str, gap: str, *by: str, late: str | None = None) -> DataFrame:
    """(start, by..., n): runs of events with less than ``gap`` between neighbours."""
    e = watermarked(events.withColumn("_t", F.col(time).cast("timestamp")), "_t", late)
    return e.groupBy(F.session_window("_t", gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), *by, "n")


def detect_stream(events: DataFrame, rules: list[sigma.Rule], data: str = "event_data"):
    """Detections of a streaming event table: a projection, so nothing is kept between batches."""
    return sigma.detect(events, rules, data)

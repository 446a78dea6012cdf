"""The frame and log windows as Structured Streaming plans. An extension: the batch forms are in operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def smoothed_stream(log: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Mean loss of each window of event time; rows later than `late` are dropped by the watermark.

    log: a stream of (ts, loss). State is one sum and count for each open window.
    """
    return log.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.avg("loss").alias("smoothed"), F.count("*").alias("rows")).select(F.col("window.start").alias("start"), "smoothed", "rows")


def occupied_stream(points: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Points of each voxel and window: the occupancy of a running scan. points: (ts, x, y, z)."""
    cells = [F.floor(a).cast("int").alias(n) for n, a in (("h", "y"), ("w", "x"), ("d", "z"))]
    return points.withWatermark("ts", late).select("ts", *cells).groupBy(F.window("ts", window), "h", "w", "d").agg(F.count("*").alias("points")).select(F.col("window.start").alias("start"), "h", "w", "d", "points")


def track_stream(detections: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each track: frames with less than `gap` between them. detections: (ts, track)."""
    return detections.withWatermark("ts", late).groupBy("track", F.session_window("ts", gap)).agg(F.count("*").alias("frames")).select("track", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "frames")

"""Host windows over an event stream, tumbling, sliding or by session, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import rounded


def _counted(events: DataFrame, frame: Column, late: str) -> DataFrame:
    grouped = events.withWatermark("at", late).groupBy("host", frame.alias("w"))
    counted = grouped.agg(F.count("*").alias("n_events"), F.max((F.col("event_type") == "error").cast("int")).alias("y"), rounded(F.sum("value")).alias("sum_value"))
    return counted.select("host", F.unix_timestamp("w.start").alias("window_start"), F.unix_timestamp("w.end").alias("window_end"), "n_events", "y", "sum_value")


def tumbling(events: DataFrame, length: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Events ``host, at (timestamp), event_type, value`` per host and window; rows later than the watermark go."""
    return _counted(events, F.window("at", length), late)


def sliding(events: DataFrame, length: str = "60 seconds", every: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    return _counted(events, F.window("at", length, every), late)


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return _counted(events, F.session_window("at", gap), late)

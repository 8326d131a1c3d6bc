"""Failures per account in sliding windows, as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def locked_accounts(events: DataFrame, limit: int = 5, seconds: int = 900, slide: int = 60, late: str = "30 minutes") -> DataFrame:
    """``user_id, window_start, window_end, failures`` of the windows in which an account reached the limit.

    Windows of ``seconds`` begin every ``slide`` seconds; rows later than ``late`` are no longer counted, and the state
    of closed windows is dropped. Counts are added up before the shuffle."""
    w = F.window("ts", f"{seconds} seconds", f"{slide} seconds")
    c = events.where("event_type = 'error'").withWatermark("ts", late).groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("failures"))
    return c.where(F.col("failures") >= limit).select("user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "failures")

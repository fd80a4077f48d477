"""Streaming forms of the rollups: extensions, as the batch operators have no streams of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def event_rates(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes", failing: str = "error") -> DataFrame:
    """Events, failures and their share by window of event time; rows later than `late` are left out."""
    by = _timed(events).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"))
    out = by.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == failing).alias("failures"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "failures", F.try_divide("failures", "n").alias("failure_rate"))


def user_sessions(events: DataFrame, gap: str = "15 minutes", late: str = "30 minutes") -> DataFrame:
    """Sessions of users: first and last event, number of events, errors."""
    by = _timed(events).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return by.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "errors")

"""Streaming forms of the corpus counts; batches work too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "7 days", late: str = "1 day") -> DataFrame:
    """(start, keys, n) of every window; rows later than ``late`` behind the newest do not count. Batches work too."""
    timed = events.withWatermark(time, late)
    return timed.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sliding_counts(events: DataFrame, time: str, keys: list[str], window: str = "28 days", slide: str = "7 days", late: str = "1 day") -> DataFrame:
    """(start, keys, n) of windows that begin every ``slide``; an event is in all that have its time."""
    timed = events.withWatermark(time, late)
    return timed.groupBy(F.window(time, window, slide).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(start, end, keys, n) of runs of events without a longer gap."""
    timed = events.withWatermark(time, late)
    s = timed.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return s.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def first_seen(captures: DataFrame, time: str, keys: list[str], late: str = "1 day") -> DataFrame:
    """One capture of each key; state goes once the watermark has passed it, so repeats have to come within ``late``."""
    return captures.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)

"""Frames over time: trailing windows, milestones, running totals, samples and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trailing_frames(rows: DataFrame, date: str, weeks: int = 4) -> DataFrame:
    """Every row once for each frame whose trailing weeks have its date; frames end on Sundays and on the last date.

    A row knows its frames, so there is no range join.
    """
    last = rows.agg(F.max(date).alias("last_date"))  # one row
    dated = rows.filter(F.col(date).isNotNull()).crossJoin(F.broadcast(last))
    first = F.next_day(F.date_sub(date, 1), "Sun")
    ends = F.transform(F.sequence(F.lit(0), F.lit(weeks - 1)), lambda i: F.date_add(first, i * 7))
    final = F.when(F.date_add(date, 7 * weeks - 1) >= F.col("last_date"), F.array("last_date")).otherwise(F.array().cast("array<date>"))
    ends = F.array_union(F.filter(ends, lambda e: e <= F.col("last_date")), final)
    return dated.withColumn("frame_end", F.explode(ends)).drop("last_date")


def recent_events(frames: DataFrame, events: DataFrame, end: str, k: int) -> DataFrame:
    """The k latest events up to each frame's end. ``events`` is a table of milestones of a study, tens of rows."""
    met = frames.join(F.broadcast(events), F.col("event_date") <= F.col(end))
    rank = F.row_number().over(Window.partitionBy(end).orderBy(F.desc("event_date"), "event"))
    return met.withColumn("rank", rank).filter(F.col("rank") <= k)


def most_frequent(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the smallest of equals."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min_by(F.struct(value, "n"), F.struct(-F.col("n"), F.col(value))).alias("best")).select(key, f"best.{value}", "best.n")


def arriving_events(frames: DataFrame, events: DataFrame, end: str) -> DataFrame:
    """Events since the frame before, up to each frame's end; all earlier ones for the first frame."""
    spine = frames.select(end).distinct().withColumn("previous", F.lag(end).over(Window.orderBy(end)))  # a row a frame
    met = spine.join(F.broadcast(events), (F.col("event_date") <= F.col(end)) & (F.col("previous").isNull() | (F.col("event_date") > F.col("previous"))))
    return met.select(end, "previous", "event_date", "event")


def frame_spine(first: DataFrame, last: DataFrame) -> DataFrame:
    """(frame_end): the Sundays from the first day of ``first`` (column d) to the last of ``last``, and that last day."""
    span = first.agg(F.min("d").alias("a")).crossJoin(last.agg(F.max("d").alias("b")))
    sundays = F.filter(F.sequence(F.next_day(F.date_sub("a", 1), "Sun"), F.date_add("b", 7), F.expr("interval 7 days")), lambda e: e <= F.col("b"))
    return span.select(F.explode(F.array_union(sundays, F.array("b"))).alias("frame_end"))


def running_totals(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Each group's values summed up to every place of its order: series that grow frame by frame."""
    return rows.withColumn("total", F.sum(value).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def sample_each(rows: DataFrame, group: str, key: str, n: int = 800, seed: int = 42) -> DataFrame:
    """n rows of each group, the same in every run: those with the least hash of key and seed."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key))
    return rows.withColumn("place", at).filter(F.col("place") <= n).drop("place")


def largest(rows: DataFrame, keys: list[str], group: list[str], n: int) -> DataFrame:
    """The n most frequent ``keys`` of each group with their rank; equals by name."""
    c = rows.groupBy(*group, *keys).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    if not group:
        c = c.orderBy(F.desc("n"), *keys).limit(n)
    return c.withColumn("rank", F.row_number().over(by.orderBy(F.desc("n"), *keys))).filter(F.col("rank") <= n)


def preview_period(counts: DataFrame, period: str, group: str, value: str) -> DataFrame:
    """The period in which the smallest group is largest, the first of equals: one row."""
    low = counts.groupBy(period).agg(F.min(value).alias("least"), F.count_distinct(group).alias("groups"))
    return low.orderBy(F.desc("groups"), F.desc("least"), period).limit(1).select(period, "least")

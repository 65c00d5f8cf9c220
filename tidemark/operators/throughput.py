"""Messages per interval, with running total and the points a chart shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.timing import clock_label, per_second

# Interval length in seconds and the number of points a chart keeps.
INTERVAL_SEC = 1.0
CHART_POINTS = 60

# Empty intervals are laid out this long before the newest one; counts are kept whatever their age.
HISTORY_SEC = 31 * 24 * 3600


def _duration(seconds: float) -> str:
    return f"{round(seconds * 1_000_000)} microseconds"


def _interval_of(at: Column, interval_sec: float) -> Column:
    """The start of the interval that holds a time."""
    micros = round(interval_sec * 1_000_000)
    return F.timestamp_micros(F.unix_micros(at) - F.pmod(F.unix_micros(at), F.lit(micros)))


def interval_counts(decoded: DataFrame, interval_sec: float = INTERVAL_SEC) -> DataFrame:
    """Decoded messages per interval, foreign tables included; intervals without any are absent."""
    return (
        decoded.groupBy(F.window("timestamp", _duration(interval_sec)).alias("interval"))
        .agg(F.count(F.lit(1)).alias("events_in_interval"))
        .select(F.col("interval.start").alias("interval_start"), "events_in_interval")
    )


def rolled_up(counts: DataFrame, interval_sec: float) -> DataFrame:
    """The same events per longer interval; counts of counts add up, so tiers can be made of tiers."""
    return (
        counts.groupBy(F.window("interval_start", _duration(interval_sec)).alias("interval"))
        .agg(F.sum("events_in_interval").alias("events_in_interval"))
        .select(F.col("interval.start").alias("interval_start"), "events_in_interval")
    )


def fill_intervals(
    counts: DataFrame,
    interval_sec: float = INTERVAL_SEC,
    per_chunk: int = 3600,
    history_sec: float = HISTORY_SEC,
    until: Column | None = None,
) -> DataFrame:
    """Adds the intervals without events between the first and the last one, or up to the time `until`.

    The time line is laid out in chunks first and then inside each chunk, so a long history is built
    by many tasks and no array holds more than `per_chunk` intervals. One message stamped years ago
    does not stretch it: it reaches back from the last interval by whole intervals of `history_sec` at most.
    """
    history = F.expr(f"INTERVAL '{round(history_sec / interval_sec) * interval_sec:.6f}' SECOND")
    step = F.expr(f"INTERVAL '{interval_sec:.6f}' SECOND")
    chunk = F.expr(f"INTERVAL '{interval_sec * per_chunk:.6f}' SECOND")
    chunks = (
        counts.agg(F.min("interval_start").alias("first"), F.max("interval_start").alias("last"))
        .where("first IS NOT NULL")
        .withColumn("last", F.col("last") if until is None else F.greatest("last", _interval_of(until, interval_sec)))
        .withColumn("first", F.greatest(F.col("first"), F.col("last") - history))
        .select(F.explode(F.sequence("first", "last", chunk)).alias("start"), "last")
        .repartition("start")
    )
    end = F.least(F.col("start") + chunk - step, F.col("last"))
    empty = chunks.select(F.explode(F.sequence("start", end, step)).alias("interval_start")).withColumn(
        "events_in_interval", F.lit(0).cast("bigint")
    )
    return (
        counts.unionByName(empty)
        .groupBy("interval_start")
        .agg(F.sum("events_in_interval").alias("events_in_interval"))
    )


def with_rate(points: DataFrame, interval_sec: float = INTERVAL_SEC) -> DataFrame:
    seconds = F.lit(float(interval_sec))
    return points.withColumn("interval_sec", seconds).withColumn(
        "events_per_sec", per_second(F.col("events_in_interval"), seconds)
    )


def with_running_total(points: DataFrame, chunk: str = "1 hour") -> DataFrame:
    """Adds `total_received`, all events up to the end of the interval.

    Chunk totals are summed up first; only these, one row per chunk, pass through a single task.
    Inside a chunk the sum runs in the chunk's own partition.
    """
    chunked = points.withColumn("_chunk", F.window("interval_start", chunk)["start"])
    earlier = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        chunked.groupBy("_chunk")
        .agg(F.sum("events_in_interval").alias("_events"))
        .select("_chunk", F.coalesce(F.sum("_events").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("_chunk").orderBy("interval_start").rowsBetween(Window.unboundedPreceding, 0)
    return (
        chunked.join(before, "_chunk")
        .withColumn("total_received", F.col("_before") + F.sum("events_in_interval").over(inside))
        .drop("_chunk", "_before")
    )


def last_points(points: DataFrame, n: int = CHART_POINTS) -> DataFrame:
    """The newest points of the chart with their clock label."""
    newest = points.orderBy(F.desc("interval_start")).limit(n)
    return newest.select("interval_start", clock_label(F.col("interval_start")).alias("time"), "events_per_sec")

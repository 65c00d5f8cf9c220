"""Time text and rates."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text with microseconds; the session time zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def epoch_to_iso_utc(seconds: Column) -> Column:
    return iso_utc(F.timestamp_seconds(seconds))


def clock_label(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def per_second(events: Column, seconds: Column) -> Column:
    """Whole events per second; 0 for an interval without length."""
    return F.when(seconds > 0, F.floor(events / seconds)).otherwise(0).cast("bigint")

"""The second job: counts all messages per interval and, if wanted, passes the raw messages on.

    throughput/batch_id=N        counts of the messages of batch N
    tiers/through=N/tier=T       counts of all batches up to N, per second, minute and hour

Every message counts, however late its time stamp: each micro-batch writes the counts of its own
messages into a folder of its own, by overwrite, and readers add them up. So there is no state and no
watermark, and a repeated batch counts once. From time to time the folders are rolled up into tiers: seconds are kept for an
hour, minutes for a month, hours for good, so that a reader of the last minute reads one small tier and a reader of
the whole history few rows. Sums of sums are sums: each tier is made of the same tier before and the new batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import decode, throughput
from tidemark.schemas import THROUGHPUT
from tidemark.streaming.tables import TicketTables

#: Length of a tier's intervals in seconds (None: that of the job), and how far it reaches back (None: for good).
TIERS: dict[str, tuple[float | None, float | None]] = {
    "second": (None, 3600.0),
    "minute": (60.0, throughput.HISTORY_SEC),
    "hour": (3600.0, None),
}


def start_throughput(
    messages: DataFrame,
    root: str,
    interval_sec: float = throughput.INTERVAL_SEC,
    available_now: bool = False,
    by_arrival: bool = False,
) -> StreamingQuery:
    """Counts by the broker's time stamps, or by the time at which a message arrives here, which is that of its batch."""

    def count_batch(batch: DataFrame, batch_id: int) -> None:
        if by_arrival:
            batch = batch.withColumn("timestamp", F.current_timestamp())
        counts = throughput.interval_counts(decode.decode_messages(batch), interval_sec)
        counts.write.mode("overwrite").parquet(f"{root}/throughput/batch_id={batch_id}")

    writer = messages.select("timestamp", "value").writeStream.foreachBatch(count_batch)
    return _started(writer, root, "throughput", available_now)


def start_raw_feed(messages: DataFrame, root: str, available_now: bool = False) -> StreamingQuery:
    feed = decode.raw_feed(decode.decode_messages(messages))
    writer = feed.writeStream.format("parquet").outputMode("append").option("path", f"{root}/raw_feed")
    return _started(writer, root, "raw_feed", available_now)


def _started(writer, root: str, name: str, available_now: bool) -> StreamingQuery:
    trigger = {"availableNow": True} if available_now else {"processingTime": "1 second"}
    return writer.option("checkpointLocation", f"{root}/checkpoints/{name}").trigger(**trigger).start()


def _folders(spark: SparkSession, root: str) -> TicketTables:
    """The monitor's folders are numbered like those of the tables."""
    return TicketTables(spark, root)


def _counts(spark: SparkSession, paths: list[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], THROUGHPUT)
    return spark.read.schema(THROUGHPUT).parquet(*paths)


def _parts(spark: SparkSession, root: str, tier: str, through: int | None = None) -> DataFrame:
    """The counts of a tier and of the batches after it, up to `through`: not yet added up."""
    folders = _folders(spark, root)
    base = folders.newest_written("tiers", "through")
    later = [n for n in folders.numbered("throughput", "batch_id") if n > base and (through is None or n <= through)]
    counts = _counts(spark, [folders.batch_path("throughput", n) for n in later])
    if base >= 0 and folders.exists("tiers", f"through={base}", f"tier={tier}"):
        counts = counts.unionByName(_counts(spark, [folders.path("tiers", f"through={base}", f"tier={tier}")]))
    return counts


def tier_counts(
    spark: SparkSession, root: str, tier: str = "second", interval_sec: float = throughput.INTERVAL_SEC
) -> DataFrame:
    """The counts of all batches in the intervals of a tier, a row per interval with messages."""
    return throughput.rolled_up(_parts(spark, root, tier), TIERS[tier][0] or interval_sec)


def roll_up(spark: SparkSession, root: str, interval_sec: float = throughput.INTERVAL_SEC) -> bool:
    """Writes the tiers anew, with all batches but the newest, which may come again; False if there is nothing new.

    A version counts once it is written to the end; the one before stays for those who read it, and the batches that both
    hold go.
    """
    folders = _folders(spark, root)
    base = folders.newest_written("tiers", "through")
    through = max(folders.numbered("throughput", "batch_id"), default=0) - 1
    if through <= base:
        return False
    newest = _parts(spark, root, "second", through).agg(F.max("interval_start")).first()[0]
    tiers = None
    for tier, (length, history) in TIERS.items():
        counts = throughput.rolled_up(_parts(spark, root, tier, through), length or interval_sec)
        if history is not None and newest is not None:
            counts = counts.where(F.col("interval_start") > F.lit(newest) - F.expr(f"INTERVAL '{history:.6f}' SECOND"))
        counts = counts.withColumn("tier", F.lit(tier)).coalesce(1)
        tiers = counts if tiers is None else tiers.unionByName(counts)
    tiers.write.mode("overwrite").partitionBy("tier").parquet(folders.path("tiers", f"through={through}"))
    older = folders.drop_older("tiers")
    if older is not None:
        for n in folders.numbered("throughput", "batch_id"):
            if n <= older:
                folders.remove("throughput", f"batch_id={n}")
    return True


def throughput_counts(spark: SparkSession, root: str, interval_sec: float = throughput.INTERVAL_SEC) -> DataFrame:
    """The counts of all batches, a row per interval with messages; as far back as seconds are kept."""
    return tier_counts(spark, root, "second", interval_sec)


def throughput_points(
    spark: SparkSession, root: str, interval_sec: float = throughput.INTERVAL_SEC, until: Column | None = None
) -> DataFrame:
    """The stored counts as chart points, intervals without messages included, up to the time `until` if one is given.

    The running total counts what is older than the first point too; the hours know it.
    """
    counts = throughput_counts(spark, root, interval_sec)
    points = throughput.fill_intervals(counts, interval_sec, until=until)
    totals = throughput.with_running_total(throughput.with_rate(points, interval_sec))
    if _folders(spark, root).newest_written("tiers", "through") < 0:
        return totals
    events = F.coalesce(F.sum("events_in_interval"), F.lit(0)).alias("events")
    every, here = (tier_counts(spark, root, t, interval_sec).agg(events).first().events for t in ("hour", "second"))
    return totals.withColumn("total_received", F.col("total_received") + F.lit(every - here))


def last_points(
    spark: SparkSession, root: str, n: int = throughput.CHART_POINTS, interval_sec: float = throughput.INTERVAL_SEC
) -> DataFrame:
    """The newest points of the chart, from the tier of seconds alone."""
    counts = throughput_counts(spark, root, interval_sec)
    newest = counts.agg(F.max("interval_start")).first()[0]
    if newest is None:
        near = counts
    else:
        near = counts.where(F.col("interval_start") > F.lit(newest) - F.expr(f"INTERVAL '{n * interval_sec:.6f}' SECOND"))
        first = F.lit(newest) - F.expr(f"INTERVAL '{(n - 1) * interval_sec:.6f}' SECOND")
        oldest = counts.agg(F.min("interval_start").alias("o")).select(F.greatest("o", first).alias("interval_start"))
        near = near.unionByName(oldest.withColumn("events_in_interval", F.lit(0).cast("bigint")))
    points = throughput.fill_intervals(near, interval_sec)
    return throughput.last_points(throughput.with_rate(points, interval_sec), n)

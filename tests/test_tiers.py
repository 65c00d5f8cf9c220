"""Interval counts rolled up into seconds, minutes and hours."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import throughput
from tidemark.schemas import MESSAGE, THROUGHPUT
from tidemark.streaming import monitor

START = datetime(2024, 1, 1, 10, 0, 0)


def write_batch(spark, root, batch_id, by_second):
    rows = [(START + timedelta(seconds=s), n) for s, n in by_second.items()]
    spark.createDataFrame(rows, THROUGHPUT).coalesce(1).write.mode("overwrite").parquet(f"{root}/throughput/batch_id={batch_id}")


def counts(frame):
    return {int((r.interval_start - START).total_seconds()): r.events_in_interval for r in frame.collect()}


BATCHES = [{0: 5, 61: 1}, {61: 2, 3_700: 4}, {3_700: 1, 7_300: 2, 7_301: 3}, {10: 7, 7_305: 1}]


def by(seconds, upto=len(BATCHES)):
    total = Counter()
    for batch in BATCHES[:upto]:
        for s, n in batch.items():
            total[s // seconds * seconds] += n
    return dict(total)


def test_tiers_hold_every_message(spark, tmp_path):
    root = str(tmp_path)
    for n, batch in enumerate(BATCHES):
        write_batch(spark, root, n, batch)
        assert monitor.roll_up(spark, root) == (n > 0)
        assert not monitor.roll_up(spark, root)
        write_batch(spark, root, n, batch)  # the newest batch comes again
        assert counts(monitor.tier_counts(spark, root, "hour")) == by(3_600, n + 1)
        assert counts(monitor.tier_counts(spark, root, "minute")) == by(60, n + 1)
    # Seconds reach back an hour from the newest rolled up; what came later counts wherever it stands.
    seconds = counts(monitor.tier_counts(spark, root))
    assert {s: n for s, n in seconds.items() if s > 3_701} == {7_300: 2, 7_301: 3, 7_305: 1} and 0 not in seconds
    # The first versions and the batches that they held are gone.
    assert sorted(p.name for p in (tmp_path / "tiers").glob("through=*")) == ["through=1", "through=2"]
    assert sorted(p.name for p in (tmp_path / "throughput").glob("batch_id=*")) == ["batch_id=2", "batch_id=3"]


def test_totals_count_what_no_second_shows(spark, tmp_path):
    root = str(tmp_path)
    for n, batch in enumerate(BATCHES):
        write_batch(spark, root, n, batch)
    monitor.roll_up(spark, root)
    points = monitor.throughput_points(spark, root).orderBy("interval_start").collect()
    assert points[-1].total_received == sum(sum(b.values()) for b in BATCHES)
    assert [p.interval_start for p in points] == [points[0].interval_start + timedelta(seconds=i) for i in range(len(points))]


@pytest.mark.parametrize("rolled", [False, True])
def test_last_points_read_one_tier(spark, tmp_path, rolled):
    root = str(tmp_path)
    for n, batch in enumerate(BATCHES):
        write_batch(spark, root, n, batch)
    if rolled:
        monitor.roll_up(spark, root)
    found = monitor.last_points(spark, root)
    rows = found.collect()
    assert len(rows) == 60 and [r.interval_start for r in rows] == [START + timedelta(seconds=7_305 - i) for i in range(60)]
    assert {r.interval_start.second: r.events_per_sec for r in rows if r.events_per_sec} == {40: 2, 41: 3, 45: 1}
    if rolled:
        read = [name for name in found.inputFiles() if "/tiers/" in name]
        assert read and all("tier=second" in name for name in read)


def test_few_points(spark, tmp_path):
    write_batch(spark, str(tmp_path), 0, {0: 3, 2: 4})
    assert [r.events_per_sec for r in monitor.last_points(spark, str(tmp_path)).collect()] == [4, 0, 3]


def test_intervals_without_messages_up_to_now(spark, tmp_path):
    root = str(tmp_path)
    write_batch(spark, root, 0, {0: 3})
    now = F.lit((START + timedelta(seconds=4, microseconds=900_000)).isoformat(sep=" ")).cast("timestamp")
    points = monitor.throughput_points(spark, root, until=now).orderBy("interval_start").collect()
    assert [(p.events_in_interval, p.total_received) for p in points] == [(3, 3)] + [(0, 3)] * 4


def test_counting_by_arrival(spark, tmp_path):
    """Old time stamps do not matter; what arrives together counts together."""
    rows = [("t", 0, n, START + timedelta(days=n), bytearray(b"{}")) for n in range(5)]
    spark.createDataFrame(rows, MESSAGE).coalesce(1).write.parquet(str(tmp_path / "landed"))
    messages = spark.readStream.schema(MESSAGE).parquet(str(tmp_path / "landed"))
    before = datetime.now()
    query = monitor.start_throughput(messages, str(tmp_path / "m"), available_now=True, by_arrival=True)
    query.awaitTermination()
    found = monitor.throughput_counts(spark, str(tmp_path / "m")).select(
        F.unix_seconds("interval_start").alias("at"), "events_in_interval"
    ).collect()
    assert [r.events_in_interval for r in found] == [5]
    assert abs(found[0].at - before.timestamp()) < 120


def test_longer_intervals(spark):
    rows = spark.createDataFrame([(START + timedelta(seconds=s), 1) for s in range(0, 200, 10)], THROUGHPUT)
    assert sorted(counts(throughput.rolled_up(rows, 60.0)).items()) == [(0, 6), (60, 6), (120, 6), (180, 2)]

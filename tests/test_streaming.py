"""The streaming jobs on files: same result as the batch queries, also after a crash and a replay."""

import os
import shutil
import re
import time
from collections import Counter
from dataclasses import replace

import pytest
from cases import envelope
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tidemark.operators import gold, silver, throughput, tickets
from tidemark.operators.decode import bronze_rows, decode_messages
from tidemark.plans.queries import read_events
from tidemark.plans.rebuild import rebuild
from tidemark.schemas import GOLD, MESSAGE, SILVER, SILVER_STORE
from tidemark.sources.replay import change_messages
from tidemark.sources.streams import BrokerOptions, broker_messages, file_messages
from tidemark.streaming import monitor, tables
from tidemark.streaming.tables import TicketTables
from tidemark.streaming.worker import TicketWorker, WorkerOptions, gold_report, worker_report

SF_DIR = "/root/testdata/sf0.001"
BATCHES = 4


@pytest.fixture(scope="module")
def feed(spark):
    """All sf0.001 events, in four batches."""
    return change_messages(read_events(spark, SF_DIR), batch_rows=250).cache()


@pytest.fixture()
def landed(spark, feed, tmp_path):
    """Folder with one file per batch; the file source takes them in order of their age."""
    folder = str(tmp_path / "landed")
    for batch_id in range(BATCHES):
        land(feed.where(F.col("batch_id") == batch_id), folder, age=1000 - batch_id)
    return folder


def land(messages, folder, age=0):
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    messages.select(*MESSAGE.fieldNames()).coalesce(1).write.mode("append").parquet(folder)
    for name in set(os.listdir(folder)) - before:
        at = time.time() - age
        os.utime(os.path.join(folder, name), (at, at))


def message(spark, *texts, start=0):
    rows = [("t", 0, start + n, None, bytearray(text.encode())) for n, text in enumerate(texts)]
    return spark.createDataFrame(rows, MESSAGE)


def rows_of(frame, *columns):
    return Counter(tuple(row) for row in (frame.select(*columns) if columns else frame).collect())


def expected_changes(feed):
    return tickets.ticket_changes(tickets.classify_events(bronze_rows(decode_messages(feed))))


def check_tables(feed, tables):
    changes = expected_changes(feed)
    state = silver.silver_state(changes)
    assert rows_of(tables.silver()) == rows_of(state)
    assert rows_of(tables.gold()) == rows_of(gold.gold_counts(state))
    positions = rows_of(tables.bronze(), "batch_id", "topic", "partition", "offset", "raw_payload")
    found = bronze_rows(decode_messages(feed))
    assert positions == rows_of(found, "batch_id", "topic", "partition", "offset", "raw_payload")


def test_stream_equals_batch(spark, feed, landed, tmp_path):
    worker = TicketWorker(spark, str(tmp_path / "lake"))
    worker.run(file_messages(spark, landed, files_per_batch=1), available_now=True)
    check_tables(feed, worker.tables)

    outcomes = tickets.batch_outcomes(tickets.classify_events(bronze_rows(decode_messages(feed))))
    columns = ["batch_id", "received", "processed", "failed", "ignored"]
    assert rows_of(worker.tables.log().where("kind = 'batch'"), *columns) == rows_of(outcomes, *columns)

    summary = {row.source_db: row.summary for row in gold_report(worker.tables).collect()}
    assert summary == {r.source_db: r.summary for r in gold.gold_summary(worker.tables.gold()).collect()}
    report = worker_report(worker.tables).first()
    assert (report.batches_ok, report.batches_failed, report.status) == (BATCHES, 0, "ok")

    # Nothing new: a second run changes nothing and writes no further Gold.
    refreshes = worker.tables.log().where("kind = 'gold'").count()
    TicketWorker(spark, str(tmp_path / "lake")).run(file_messages(spark, landed), available_now=True)
    check_tables(feed, worker.tables)
    assert worker.tables.log().where("kind = 'gold'").count() == refreshes


@pytest.mark.parametrize("failing_step", ["bronze", "changes", "log"])
def test_crash_and_restart(spark, feed, landed, tmp_path, monkeypatch, failing_step):
    root = str(tmp_path / "lake")
    worker = TicketWorker(spark, root)

    def broken(original):
        def call(*args, **kwargs):
            result = original(*args, **kwargs)
            if args[-1] == 2 or (len(args) > 1 and args[1] == 2):
                raise OSError("disk gone")
            return result

        return call

    if failing_step == "log":
        class Unlogged(TicketTables):
            def write_log(self, kind, batch_id, **values):
                if (kind, batch_id) == ("batch", 2):
                    raise OSError("disk gone")
                super().write_log(kind, batch_id, **values)

        worker.tables = Unlogged(spark, root)
    else:
        name = f"_write_{failing_step}"
        monkeypatch.setattr(worker, name, broken(getattr(worker, name)))

    with pytest.raises(StreamingQueryException, match="disk gone"):
        worker.run(file_messages(spark, landed, files_per_batch=1), available_now=True)
    assert worker.tables.committed_through() == 1
    report = worker_report(worker.tables).first()
    assert (report.batches_ok, report.batches_failed, report.status) == (2, 1, "degraded")
    step = "Bronze write" if failing_step == "bronze" else "Silver merge"
    assert report.last_error == f"{step} failed: disk gone"
    failed = worker.tables.log().where("kind = 'failure'").first()
    assert (failed.batch_id, failed.processed) == (2, 0)
    assert failed.failed == worker.tables.bronze_batch(2).count()
    # A reader in between sees the state of the last whole batch.
    state = silver.silver_state(expected_changes(feed.where("batch_id <= 1")))
    assert rows_of(worker.tables.silver()) == rows_of(state)

    again = TicketWorker(spark, root)
    again.run(file_messages(spark, landed, files_per_batch=1), available_now=True)
    check_tables(feed, again.tables)
    report = worker_report(again.tables).first()
    assert (report.batches_ok, report.batches_failed, report.status) == (BATCHES, 1, "ok")


def test_full_state_is_rewritten_and_old_changes_go(spark, feed, tmp_path):
    worker = TicketWorker(spark, str(tmp_path / "lake"), WorkerOptions(min_pending_batches=1, pending_share=0.0))
    for batch_id in range(BATCHES):
        batch = feed.where(F.col("batch_id") == batch_id)
        worker.apply_batch(batch, batch_id)
        worker.apply_batch(batch, batch_id)  # a replay
        assert worker.rewrite_silver_if_due()
        assert not worker.rewrite_silver()
        state = silver.silver_state(expected_changes(feed.where(F.col("batch_id") <= batch_id)))
        assert rows_of(worker.tables.silver()) == rows_of(state)
        assert rows_of(worker.refresh_gold()) == rows_of(gold.gold_counts(state))
    assert worker.tables.numbered("silver", "through") == [2, 3]
    assert worker.tables.numbered("counts", "through") == [2, 3]
    assert worker.tables.numbered("changes", "batch_id") == [3]
    worker.refresh_gold()
    check_tables(feed, worker.tables)
    # Replaying the newest batch over a state that already holds it changes nothing.
    worker.apply_batch(feed.where(F.col("batch_id") == BATCHES - 1), BATCHES - 1)
    check_tables(feed, worker.tables)


def test_rewrite_waits_for_enough_changes(spark, feed, tmp_path, monkeypatch):
    worker = TicketWorker(spark, str(tmp_path / "lake"), WorkerOptions(min_pending_batches=2, pending_share=100.0))
    worker.apply_batch(feed.where("batch_id = 0"), 0)
    assert not worker.rewrite_silver_if_due()
    worker.apply_batch(feed.where("batch_id = 1"), 1)
    assert worker.rewrite_silver_if_due()
    for batch_id in (2, 3):
        worker.apply_batch(feed.where(F.col("batch_id") == batch_id), batch_id)
        state = silver.silver_state(expected_changes(feed.where(F.col("batch_id") <= batch_id)))
        assert rows_of(worker.refresh_gold()) == rows_of(gold.gold_counts(state))
    # The full state is read only where ids of pending changes can be, and stays where it is.
    text = worker.tables.gold_rows(3)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*In\(id, \[\d+,", text)
    assert "LeftSemi, BuildRight" in text and "SortMergeJoin" not in text
    monkeypatch.setattr(tables, "KEY_LIST", 3)
    text = worker.tables.gold_rows(3)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*GreaterThanOrEqual\(id,\d+\), LessThanOrEqual\(id,\d+\)", text)
    assert not worker.rewrite_silver_if_due()
    worker.refresh_gold()
    check_tables(feed, worker.tables)
    worker.options = replace(worker.options, max_pending_batches=2)
    assert worker.rewrite_silver_if_due()
    check_tables(feed, worker.tables)


def test_rebuild_from_bronze(spark, feed, tmp_path):
    worker = TicketWorker(spark, str(tmp_path / "lake"))
    assert rebuild(worker.tables) == -1
    for batch_id in range(BATCHES):
        worker.apply_batch(feed.where(F.col("batch_id") == batch_id), batch_id)
    merged = rows_of(worker.tables.silver())
    for parse_again in (False, True):
        assert rebuild(worker.tables, parse_again) == BATCHES - 1
        assert worker.tables.numbered("silver", "through") == [BATCHES - 1]
        assert rows_of(worker.tables.silver()) == merged


def test_gold_follows_a_rebuild(spark, feed, tmp_path):
    """A Silver read by an older parser, and its Gold, are replaced by what the text says."""
    worker = TicketWorker(spark, str(tmp_path / "lake"))
    worker.apply_batch(feed.where("batch_id = 0"), 0)
    right = rows_of(worker.refresh_gold())
    path = str(tmp_path / "lake" / "bronze" / "batch_id=0")
    misread = worker.tables.bronze_batch(0).withColumn("status", F.lit("misread")).drop("batch_id").collect()
    schema = worker.tables.bronze_batch(0).drop("batch_id").schema
    spark.createDataFrame(misread, schema).write.mode("overwrite").parquet(path)
    assert rebuild(worker.tables) == 0
    assert {row[1] for row in rows_of(worker.tables.gold())} == {"misread"}
    assert rebuild(worker.tables, parse_again=True) == 0
    assert rows_of(worker.tables.gold()) == right == rows_of(gold.gold_counts(worker.tables.silver()))


def test_a_failing_rewrite_is_logged(spark, feed, tmp_path, monkeypatch):
    worker = TicketWorker(spark, str(tmp_path / "lake"))
    worker.apply_batch(feed.where("batch_id = 0"), 0)
    monkeypatch.setattr(worker, "rewrite_silver_if_due", lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        worker._after_batches()
    log = worker.tables.log().where("kind = 'failure'").collect()
    assert [row.error_message.split(":")[0] for row in log] == ["Silver rewrite failed"]


def test_no_silver_before_the_first_upsert(spark, tmp_path):
    worker = TicketWorker(spark, str(tmp_path / "lake"))
    assert worker.refresh_gold() is None and worker.tables.silver() is None and gold_report(worker.tables) is None
    image = {"id": 1, "project_id": 1, "reporter_id": 1, "status": "Open", "priority": "Low"}
    delete = envelope(op="d", before=image, after=None)
    worker.apply_batch(message(spark, delete), 0)
    assert worker.refresh_gold() is None and worker.tables.silver() is None
    worker.apply_batch(message(spark, envelope(), start=1), 1)
    assert rows_of(worker.refresh_gold()) == {("db_1", "Open", 1): 1}
    # Once there, Silver stays, and Gold goes down to no rows with it.
    worker.apply_batch(message(spark, delete, start=2), 2)
    emptied = worker.refresh_gold()
    assert emptied.collect() == [] and emptied.schema == GOLD
    assert worker.tables.silver().schema == SILVER and worker.tables.silver().isEmpty()
    worker.rewrite_silver()
    assert worker.tables.silver().isEmpty()


def test_batch_of_ignored_rows(spark, tmp_path):
    worker = TicketWorker(spark, str(tmp_path / "lake"))
    worker.apply_batch(message(spark, envelope()), 0)
    worker._after_batches()
    foreign = envelope(source={"db": "db_1", "table": "Users"})
    worker.apply_batch(message(spark, foreign, "{}", "no json", start=1), 1)
    row = worker.tables.log().where("kind = 'batch' AND batch_id = 1").first()
    assert (row.success, row.received, row.processed, row.failed, row.ignored) == (True, 2, 0, 1, 1)
    worker._after_batches()
    assert worker.tables.numbered("gold", "through") == [0]


def test_gold_failure_ends_the_job(spark, landed, tmp_path, monkeypatch):
    worker = TicketWorker(spark, str(tmp_path / "lake"))
    monkeypatch.setattr(TicketTables, "gold_rows", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        worker.run(file_messages(spark, landed), available_now=True)
    report = worker_report(worker.tables).first()
    assert (report.status, report.last_error) == ("degraded", "Gold aggregation failed: division by zero")


def test_gold_follows_while_the_stream_runs(spark, feed, landed, tmp_path, monkeypatch):
    """Gold is refreshed between batches and again when idle; then the stream is stopped."""
    worker = TicketWorker(spark, str(tmp_path / "lake"), WorkerOptions(gold_refresh_sec=1.0))
    started = []
    original = worker.start
    monkeypatch.setattr(worker, "start", lambda *args: started.append(original(*args)) or started[0])
    refresh = worker.refresh_gold

    def refresh_and_stop():
        table = refresh()
        if worker._through == BATCHES - 1:
            started[0].stop()
        return table

    monkeypatch.setattr(worker, "refresh_gold", refresh_and_stop)
    worker.run(file_messages(spark, landed, files_per_batch=1))
    check_tables(feed, worker.tables)


def test_monitor_counts_every_message(spark, feed, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "monitor")
    # Days ahead of all others, which come later, in batches whose time stamps run backwards.
    early = message(spark, "{}").withColumn("timestamp", F.lit("2024-02-01 00:00:00").cast("timestamp"))
    land(early, landed, age=1000)
    for n, batch_id in enumerate(reversed(range(BATCHES))):
        land(feed.where(F.col("batch_id") == batch_id), landed, age=100 - n)
    for start in (monitor.start_throughput, monitor.start_raw_feed):
        start(file_messages(spark, landed, files_per_batch=1), root, available_now=True).awaitTermination()

    decoded = decode_messages(feed)
    expected = rows_of(throughput.interval_counts(decoded), "interval_start", "events_in_interval")
    found = rows_of(monitor.throughput_counts(spark, root), "interval_start", "events_in_interval")
    assert found - expected == Counter({row: 1 for row in rows_of(throughput.interval_counts(early.selectExpr("timestamp")))})
    assert expected - found == Counter()
    total = monitor.throughput_points(spark, root).select(F.max("total_received")).first()[0]
    assert total == decoded.count() + 1
    assert spark.read.parquet(f"{root}/raw_feed").count() == decoded.count() + 1


def test_monitor_counts_a_repeated_batch_once(spark, feed, tmp_path):
    landed, root = str(tmp_path / "landed"), str(tmp_path / "monitor")
    land(feed, landed)
    for _ in range(2):
        monitor.start_throughput(file_messages(spark, landed), root, available_now=True).awaitTermination()
        shutil.rmtree(f"{root}/checkpoints/throughput/commits", ignore_errors=True)
    counts = monitor.throughput_counts(spark, root)
    assert counts.agg(F.sum("events_in_interval")).first()[0] == decode_messages(feed).count()


def test_unreadable_gold_is_no_gold(spark, tmp_path):
    worker = TicketWorker(spark, str(tmp_path / "lake"))
    worker.apply_batch(message(spark, envelope()), 0)
    worker.refresh_gold()
    assert gold_report(worker.tables).first().summary == {"Open": 1}
    folder = tmp_path / "lake" / "gold" / "through=0"
    for file in folder.glob("part-*"):
        file.write_bytes(b"not parquet")
    for file in folder.glob(".part-*"):  # the local file system keeps checksums
        file.unlink()
    assert gold_report(worker.tables) is None


def test_half_written_versions_are_not_used(spark, feed, tmp_path):
    worker = TicketWorker(spark, str(tmp_path / "lake"))
    for batch_id in range(BATCHES):
        worker.apply_batch(feed.where(F.col("batch_id") == batch_id), batch_id)
        worker.rewrite_silver()
        if batch_id == 2:
            (tmp_path / "lake" / "silver" / "through=2" / "_SUCCESS").unlink()
            state = silver.silver_state(expected_changes(feed.where("batch_id <= 2")))
            assert rows_of(worker.tables.silver()) == rows_of(state)
    assert worker.tables.numbered("silver", "through") == [1, 3]
    assert worker.tables.numbered("changes", "batch_id") == [2, 3]
    worker.refresh_gold()
    check_tables(feed, worker.tables)


def test_a_foreign_checkpoint_is_refused(spark, tmp_path):
    worker = TicketWorker(spark, str(tmp_path / "lake"))
    for batch_id in (0, 1):
        worker.apply_batch(message(spark, envelope(), start=batch_id), batch_id)
    before = rows_of(worker.tables.bronze())
    with pytest.raises(ValueError, match="batch 0 is older than batch 1"):
        TicketWorker(spark, str(tmp_path / "lake")).apply_batch(message(spark, "{}", start=9), 0)
    assert rows_of(worker.tables.bronze()) == before


def test_broker_options():
    options = BrokerOptions("host:9092", max_batch_rows=5, flush_interval="2s").reader_options()
    assert BrokerOptions("host:9092").for_monitor().reader_options()["startingOffsets"] == "latest"
    assert options["subscribePattern"] == "^tickets_server_.*"
    assert options["startingOffsets"] == "earliest"
    assert (options["minOffsetsPerTrigger"], options["maxOffsetsPerTrigger"]) == ("5", "5")
    assert options["maxTriggerDelay"] == "2s" and "minPartitions" not in options
    assert BrokerOptions("host:9092", min_partitions=64).reader_options()["minPartitions"] == "64"


def test_broker_needs_its_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        broker_messages(spark, BrokerOptions("localhost:9"))


def test_stored_schema(spark, tmp_path):
    worker = TicketWorker(spark, str(tmp_path / "lake"))
    worker.apply_batch(message(spark, envelope()), 0)
    assert worker.tables.changes_batch(0).schema == SILVER_STORE

"""Restarts after failures of the source, with what they log and show meanwhile."""

import shutil
import threading

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from test_streaming import BATCHES, check_tables, feed, land, landed, rows_of  # noqa: F401

from tidemark.operators import health
from tidemark.sources.streams import file_messages
from tidemark.streaming.supervision import RestartPolicy, is_source_failure
from tidemark.streaming.worker import TicketWorker, WorkerOptions, worker_report

QUICK = RestartPolicy(first_delay_sec=0.01, max_delay_sec=0.02)


def test_delays_grow_up_to_a_bound():
    policy = RestartPolicy(first_delay_sec=1, max_delay_sec=10, max_attempts=6)
    assert [policy.delay(n) for n in range(1, 8)] == [1, 2, 4, 8, 10, 10, None]
    assert RestartPolicy().delay(10**6) == 60


def test_whose_failure_it_is():
    assert is_source_failure(None, "offsets are gone", in_batch=False)
    assert is_source_failure(None, "[FAILED_READ_FILE.NO_HINT] Encountered error", in_batch=True)
    assert is_source_failure(None, "Caused by: org.apache.kafka.common.errors.TimeoutException", in_batch=True)
    assert not is_source_failure(None, "disk gone", in_batch=True)


def damaged(folder, batch):
    """Replaces the landed file of a batch by something unreadable; returns what undoes it."""
    import os

    files = sorted((f for f in os.listdir(folder) if f.startswith("part-")), key=lambda f: os.stat(f"{folder}/{f}").st_mtime)
    path, crc = f"{folder}/{files[batch]}", f"{folder}/.{files[batch]}.crc"
    at = os.stat(path).st_mtime
    shutil.copy(path, f"{folder}/_kept")
    shutil.copy(crc, f"{folder}/_kept_crc")
    os.unlink(crc)
    with open(path, "wb") as file:
        file.write(b"no parquet")
    os.utime(path, (at, at))

    def undo():
        shutil.copy(f"{folder}/_kept", path)
        shutil.copy(f"{folder}/_kept_crc", crc)
        os.utime(path, (at, at))

    return undo


class Waits(threading.Event):
    """Stands for the worker's waits: each runs a step, then is over."""

    def __init__(self, *steps):
        super().__init__()
        self.steps, self.delays, self.reports = list(steps), [], []

    def wait(self, delay=None):
        self.delays.append(delay)
        if self.steps:
            self.steps.pop(0)()
        return False


@pytest.mark.parametrize("batch", [0, 2])
def test_a_source_that_fails_twice_and_then_works(spark, feed, landed, tmp_path, batch):  # noqa: F811
    """A file that cannot be read for two attempts: nothing is lost and nothing comes twice."""
    worker = TicketWorker(spark, str(tmp_path / "lake"), WorkerOptions(restart=QUICK))
    undo = damaged(landed, batch)
    seen = []
    worker._stopped = Waits(lambda: seen.append(worker_report(worker.tables, worker).first()), undo)
    worker.run(file_messages(spark, landed, files_per_batch=1), available_now=True)
    assert worker._stopped.delays == [0.01, 0.02]
    check_tables(feed, worker.tables)
    retries = worker.tables.log().where(F.col("kind") == health.RETRY).collect()
    assert [(r.batch_id, r.success) for r in retries] == [(batch, False)] * 2
    assert all(r.error_message.startswith("Source failed, attempt") for r in retries)
    assert worker.tables.log().where(F.col("kind") == health.FAILURE).isEmpty()
    # Meanwhile the job is degraded, afterwards it is not; both attempts are counted.
    assert (seen[0].status, seen[0].batches_ok, seen[0].batches_failed) == ("degraded", batch, 1)
    report = worker_report(worker.tables, worker).first()
    assert (report.status, report.batches_ok, report.batches_failed) == ("ok", BATCHES, 2)


def test_attempts_are_bounded_if_wanted(spark, landed, tmp_path):  # noqa: F811
    policy = RestartPolicy(first_delay_sec=0.01, max_attempts=2)
    worker = TicketWorker(spark, str(tmp_path / "lake"), WorkerOptions(restart=policy))
    damaged(landed, 1)
    with pytest.raises(StreamingQueryException):
        worker.run(file_messages(spark, landed, files_per_batch=1), available_now=True)
    messages = [r.error_message for r in worker.tables.log().where("kind = 'retry'").orderBy("finished_at").collect()]
    assert [m.split(":")[0] for m in messages] == [
        "Source failed, attempt 1 in 0.01 s", "Source failed, attempt 2 in 0.02 s", "Source failed, giving up"
    ]
    assert worker.tables.committed_through() == 0 and not worker.alive and not worker.running


def test_stopped_while_waiting(spark, landed, tmp_path):  # noqa: F811
    worker = TicketWorker(spark, str(tmp_path / "lake"), WorkerOptions(restart=RestartPolicy(first_delay_sec=60)))
    damaged(landed, 0)
    timer = threading.Timer(3.0, worker.stop)
    timer.start()
    worker.run(file_messages(spark, landed, files_per_batch=1), available_now=True)
    timer.join()
    assert worker.tables.committed_through() == -1
    assert worker.tables.log().where("kind = 'retry'").count() == 1


def flaky_source():
    """A source whose offsets cannot be had as long as a file says so; made here, so that it is sent by value."""
    from cases import envelope

    texts = [envelope(ts_ms=n).encode() for n in range(3)]

    class Reader(DataSourceStreamReader):
        def __init__(self, path):
            self.path = path

        def initialOffset(self):
            return {"offset": 0}

        def latestOffset(self):
            with open(self.path) as file:
                left = int(file.read())
            if left:
                with open(self.path, "w") as file:
                    file.write(str(left - 1))
                raise OSError("offsets are gone")
            return {"offset": len(texts)}

        def partitions(self, start, end):
            return [InputPartition((start["offset"], end["offset"]))]

        def read(self, partition):
            for n in range(*partition.value):
                yield ("t", 0, n, None, texts[n])

    class Flaky(DataSource):
        @classmethod
        def name(cls):
            return "flaky"

        def schema(self):
            return "topic string, partition int, offset bigint, timestamp timestamp, value binary"

        def streamReader(self, schema):
            return Reader(self.options["source_path"])

    return Flaky


def test_a_source_without_offsets(spark, tmp_path):
    """A failure outside any batch is told by the query's last event."""
    (tmp_path / "left").write_text("2")
    spark.dataSource.register(flaky_source())
    messages = spark.readStream.format("flaky").option("source_path", str(tmp_path / "left")).load()
    worker = TicketWorker(spark, str(tmp_path / "lake"), WorkerOptions(restart=QUICK))
    worker.run(messages, available_now=True)
    log = worker.tables.log()
    assert log.where("kind = 'retry'").count() == 2
    assert "offsets are gone" in log.where("kind = 'retry'").first().error_message
    assert [r.received for r in log.where("kind = 'batch'").collect()] == [3]
    assert worker.tables.silver().first().ts_ms == 2


def test_a_job_that_failed_for_good_is_degraded_while_it_lives(spark, landed, tmp_path, monkeypatch):  # noqa: F811
    worker = TicketWorker(spark, str(tmp_path / "lake"))
    seen = []

    def broken(*_):
        raise OSError("disk gone")

    remove = spark.streams.removeListener
    monkeypatch.setattr(worker, "_write_changes", broken)
    monkeypatch.setattr(
        type(spark.streams), "removeListener", lambda self, l: (seen.append((worker.alive, worker.running)), remove(l))
    )
    with pytest.raises(StreamingQueryException):
        worker.run(file_messages(spark, landed, files_per_batch=1), available_now=True)
    assert seen == [(True, False)]
    assert worker_report(worker.tables, worker).first().status == "degraded"
    # Without an error in the log, the facts alone tell.
    metrics = health.worker_metrics(worker.tables.log().where("false"))
    for alive, running, status in ((True, True, "ok"), (True, False, "degraded"), (False, False, "ok")):
        assert health.worker_status(metrics, alive, running).first().status == status

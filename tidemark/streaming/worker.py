"""The streaming job that keeps Bronze, Silver and Gold.

Every micro-batch runs through `apply_batch`; Spark commits its offsets only after that returns. An
error in it, or in Gold, is logged and ends the job; the restarted job gets the same batch again. A failure of the
source is logged too, and the job starts itself again after a wait: offsets and batches are as the last good batch left
them, so nothing is lost or comes twice.
"""

from __future__ import annotations

import logging
import threading
import time
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import envelope
from tidemark.operators import decode, gold, health, silver, tickets
from tidemark.schemas import SILVER_STORE
from tidemark.session import session_for
from tidemark.streaming.supervision import JobWatch, RestartPolicy, is_source_failure
from tidemark.streaming.tables import TicketTables

logger = logging.getLogger(__name__)

# The steps an error message names.
BRONZE_STEP, SILVER_STEP, GOLD_STEP = "Bronze write", "Silver merge", "Gold aggregation"
REWRITE_STEP, PACK_STEP = "Silver rewrite", "Packing"
SOURCE_STEP = "Source"


@dataclass(frozen=True)
class WorkerOptions:
    """`gold_refresh_sec` is a fixed value; the others decide when the full Silver state is rewritten.

    With `guard_ts` a change older than what its ticket has seen in earlier batches changes nothing. Folders of old batches
    are joined up to files of `pack_bytes` once there are `pack_folders` of a table.
    It is rewritten once the pending changes have grown to `pending_share` of its size, so a byte of it is
    written about five times for a byte changed; or once there are so many folders that reading them takes longer.
    """

    gold_refresh_sec: float = 10.0
    min_pending_batches: int = 100
    max_pending_batches: int = 2_000
    pending_share: float = 0.2
    guard_ts: bool = False
    pack_folders: int = 1_000
    pack_bytes: int = 256 << 20
    restart: RestartPolicy = field(default_factory=RestartPolicy)


class TicketWorker:
    def __init__(self, spark: SparkSession, root: str, options: WorkerOptions = WorkerOptions()):
        self.spark = spark
        self.tables = TicketTables(spark, root, options.guard_ts)
        self.options = options
        self._through = self.tables.committed_through()
        self._changed_through = self._through
        self._gold_through = self.tables.newest_written("gold", "through")
        #: The job is in run(), and has not failed for good.
        self.alive = self.running = False
        self._stopped = threading.Event()
        self._watch = JobWatch()
        #: What ended the last batch: the text of the error, and whether it was the source's.
        self._batch_error: tuple[str, bool] | None = None

    # One micro-batch

    def apply_batch(self, messages: DataFrame, batch_id: int) -> None:
        """Bronze first, then the deciding changes, both written so that a repeat changes nothing.

        Only the newest batch can come again. An older number belongs to another checkpoint, and
        writing it would replace rows that are still good.
        """
        if batch_id < self._through:
            raise ValueError(f"batch {batch_id} is older than batch {self._through} of {self.tables.root}")
        step = BRONZE_STEP
        try:
            counts = self._write_bronze(messages, batch_id)
            step = SILVER_STEP
            counts["processed"] = self._write_changes(batch_id)
            self.tables.write_log(health.BATCH, batch_id, **counts)
        except Exception as error:
            of_source = step == BRONZE_STEP and is_source_failure(None, self._causes(error), in_batch=True)
            self._batch_error = str(error), of_source
            if not of_source:
                self._log_failure(batch_id, f"{step} failed: {error}")
            raise
        self._through = batch_id
        if counts["processed"] > 0:
            self._changed_through = batch_id

    def _write_bronze(self, messages: DataFrame, batch_id: int) -> dict[str, int]:
        """The only pass over the messages: decoded, read and stored with the raw text, and counted by outcome.

        The counts are taken by the tasks that write, once per task of the last stage whose result counts: a task that is
        run again, after the loss of an executor or beside a slow one, adds nothing, and a repeated batch writes its counts
        anew.
        """
        rows = tickets.classify_events(decode.bronze_rows(decode.decode_events(messages)))
        seen, outcome = Observation(), F.col("outcome")
        counted = rows.observe(
            seen,
            F.count(F.lit(1)).alias("received"),
            F.count_if(outcome.isin(envelope.FAILED, envelope.QUARANTINED)).alias("failed"),
            F.count_if(outcome == envelope.IGNORED).alias("ignored"),
        )
        counted.write.mode("overwrite").parquet(self.tables.batch_path("bronze", batch_id))
        found = seen.get
        return {name: found.get(name) or 0 for name in ("received", "failed", "ignored")}

    def _write_changes(self, batch_id: int) -> int:
        """Reads the batch back from Bronze, without the raw text: the table is the cut in the lineage.

        Returns the number of changes, counted as they are written.
        """
        winners = silver.latest_per_key(tickets.ticket_changes(self.tables.bronze_batch(batch_id)))
        # The order the winners have already, so Spark drops this sort.
        ordered = winners.sortWithinPartitions("batch_id", *silver.KEY)
        stored = ordered.select(*(name for name in SILVER_STORE.fieldNames() if name != "batch_id"))
        seen = Observation()
        counted = stored.observe(seen, F.count(F.lit(1)).alias("processed"))
        counted.write.mode("overwrite").parquet(self.tables.batch_path("changes", batch_id))
        return seen.get.get("processed") or 0

    def _causes(self, error: Exception) -> str:
        """The error's text, with those of its causes in the engine."""
        origin = getattr(error, "_origin", None)
        return str(error) if origin is None else self.spark._jvm.org.apache.spark.util.Utils.exceptionString(origin)

    def _log_failure(self, batch_id: int, message: str) -> None:
        """A failed batch fails whole, as far as its rows reached Bronze; the first error is the one raised."""
        try:
            written = self.tables.exists("bronze", f"batch_id={batch_id}", "_SUCCESS")
            received = self.tables.bronze_batch(batch_id).count() if written else None
            self.tables.write_log(
                health.FAILURE, batch_id, error_message=message, received=received, processed=0, failed=received
            )
        except Exception:
            logger.exception("Could not log: %s", message)

    # Between batches

    def refresh_gold(self) -> DataFrame | None:
        """Brings Gold to the last batch; None, and nothing written, while there is no Silver."""
        through = self._through
        if through < 0 or through != self.tables.newest_written("gold", "through"):
            if not self.tables.write_gold(through):
                return None
        self._gold_through = through
        return self.tables.gold()

    def rewrite_silver_if_due(self) -> bool:
        """Writes a new full state once the pending changes are many, and large beside the last one."""
        through = self._through
        base = self.tables.full_state_through(through)
        pending = self.tables.pending_batches(base, through)
        if len(pending) < max(self.options.min_pending_batches, 1):
            return False
        if len(pending) < self.options.max_pending_batches:
            state_bytes, pending_bytes = self.tables.state_sizes(base, through)
            if pending_bytes < self.options.pending_share * state_bytes:
                return False
        return self.rewrite_silver()

    def rewrite_silver(self) -> bool:
        through = self._through
        base = self.tables.full_state_through(through)
        if base == through:
            return False
        size = sum(self.tables.state_sizes(base, through))
        tables = self.tables.within(session_for(self.spark, size))
        if base < 0 and tables.silver_rows(through) is None:
            return False
        before = tables._buckets(base) if base >= 0 else None
        buckets = tables.buckets_for(size, before)
        winners = silver.last_change(tables.changes_between(base, through), tables.guard_ts)
        keyed, unkeyed = tables.next_state(base, winners)
        tables.write_full_state(keyed, unkeyed, through, buckets, dealt=before == buckets)
        older = tables.drop_older("silver")
        if older is not None:
            for n in tables.numbered("changes", "batch_id"):
                if n <= older:
                    tables.remove("changes", f"batch_id={n}")
        return True

    def pack_if_due(self) -> bool:
        """Joins the folders of old batches up to large files once there are many of them."""
        packed = False
        for table in ("bronze", "log"):
            packs = self.tables.packs(table)
            if len(packs.folders(self._through - 1)) >= self.options.pack_folders:
                packed = packs.pack(self._through - 1, self.options.pack_bytes) or packed
        return packed

    # The job

    def start(self, messages: DataFrame, available_now: bool = False) -> StreamingQuery:
        trigger = {"availableNow": True} if available_now else {"processingTime": "0 seconds"}
        return (
            messages.writeStream.foreachBatch(self.apply_batch)
            .option("checkpointLocation", self.tables.path("checkpoints", "tickets"))
            .trigger(**trigger)
            .start()
        )

    def stop(self) -> None:
        """Ends the job after its batch, or its wait."""
        self._stopped.set()

    def run(self, messages: DataFrame, available_now: bool = False) -> None:
        """Runs until the stream ends or fails for good; Gold follows at its own pace, also while the stream idles."""
        try:
            self.refresh_gold()
        except Exception as error:
            logger.warning("Gold is not refreshed before the first batch: %s", error)
        self._stopped.clear()
        self.alive = self.running = True
        self.spark.streams.addListener(self._watch)
        attempt = 0
        try:
            while True:
                before = self._through
                failure = self._run_once(messages, available_now)
                if failure is None or self._stopped.is_set():
                    return
                error, text = failure
                attempt = 1 if self._through > before else attempt + 1
                delay = self.options.restart.delay(attempt)
                plan = "giving up" if delay is None else f"attempt {attempt} in {delay:g} s"
                message = f"{SOURCE_STEP} failed, {plan}: {text}"
                logger.warning(message)
                self.tables.write_log(health.RETRY, self._through + 1, error_message=message, processed=0)
                if delay is None:
                    raise error
                if self._stopped.wait(delay):
                    return
        except Exception:
            self.running = False
            raise
        finally:
            self.spark.streams.removeListener(self._watch)
            self.alive = self.running = False

    def _run_once(self, messages: DataFrame, available_now: bool) -> tuple[Exception, str] | None:
        """One run of the stream: None when it ended, the error if the source failed; other errors are raised."""
        self._batch_error = None
        query = self.start(messages, available_now)
        self._watch.follow(str(query.runId))
        try:
            while not self._stopped.is_set():
                try:
                    ended = query.awaitTermination(self.options.gold_refresh_sec)
                except StreamingQueryException as error:
                    if self._of_source(error):
                        return error, self._batch_error[0] if self._batch_error else str(error)
                    raise
                self._after_batches()
                if ended:
                    break
            return None
        finally:
            query.stop()

    def _of_source(self, error: StreamingQueryException) -> bool:
        """What the query's own last event says of it, unless a batch has judged it already."""
        if self._batch_error is not None:
            return self._batch_error[1]
        until = time.monotonic() + 5
        while not self._watch.ended and time.monotonic() < until:
            time.sleep(0.01)
        return is_source_failure(self._watch.error_class, self._watch.error or str(error), in_batch=False)

    def _after_batches(self) -> None:
        if self._changed_through <= self._gold_through:
            return
        step = GOLD_STEP
        try:
            self.refresh_gold()
            step = REWRITE_STEP
            self.rewrite_silver_if_due()
            step = PACK_STEP
            self.pack_if_due()
        except Exception as error:
            self._log_failure(self._through, f"{step} failed: {error}")
            raise


def gold_report(tables: TicketTables) -> DataFrame | None:
    """Gold as a viewer wants it on connecting, None if it is missing or cannot be read."""
    try:
        table = tables.gold()
        if table is None:
            return None
        summary = gold.gold_summary(table)
        summary.isEmpty()  # reads the few rows now, as an unreadable file shows only then
        return summary
    except Exception as error:
        logger.warning("No summary, as Gold cannot be read: %s", error)
        return None


def worker_report(tables: TicketTables, worker: TicketWorker | None = None) -> DataFrame:
    """Counters and health of the job in one row; with the worker itself, also whether it has stopped while it lives."""
    metrics = health.worker_metrics(tables.log())
    if worker is None:
        return health.worker_status(metrics)
    return health.worker_status(metrics, alive=worker.alive, running=worker.running)

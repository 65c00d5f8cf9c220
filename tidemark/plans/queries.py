"""Every operator as a query over the `events` table replayed as change messages.

All queries read the whole table. Where a merge needs a target and a batch, the history before
CUT_OVER is the target and everything after it arrives as one batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import timing
from tidemark.operators import decode, gold, health, silver, throughput, tickets
from tidemark.plans import rebuild
from tidemark.schemas import MESSAGE, SILVER
from tidemark.session import shared_folder, stored_once
from tidemark.sources.replay import change_messages
from tidemark.sources.streams import file_messages, on_topics
from tidemark.streaming import monitor
from tidemark.streaming.tables import TicketTables
from tidemark.streaming.worker import TicketWorker, WorkerOptions, gold_report

TOPIC_PATTERN = "^tickets_server_.*"
CUT_OVER = "2024-01-16 00:00:00"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_topics(change_messages(read_events(spark, sf_dir)), TOPIC_PATTERN)


def decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.decode_messages(messages(spark, sf_dir))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets.classify_events(decode.bronze_rows(decode.decode_events(messages(spark, sf_dir))))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets.ticket_changes(classified(spark, sf_dir))


def quarantined_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets.quarantined_changes(classified(spark, sf_dir))


def state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.silver_state(changes(spark, sf_dir))


def gold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.gold_counts(state(spark, sf_dir))


def _changes_of(events: DataFrame) -> DataFrame:
    found = decode.decode_events(on_topics(change_messages(events), TOPIC_PATTERN))
    return tickets.ticket_changes(tickets.classify_events(decode.bronze_rows(found)))


def _one_batch(rows: DataFrame) -> DataFrame:
    return silver.latest_per_key(rows.withColumn("batch_id", F.lit(0).cast("bigint"))).select(*SILVER.fieldNames())


def merge_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = read_events(spark, sf_dir)
    cut = F.lit(CUT_OVER).cast("timestamp_ntz")
    history, later = events.where(F.col("ts") < cut), events.where(F.col("ts") >= cut)
    return silver.silver_state(_changes_of(history)), _one_batch(_changes_of(later))


def topic_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = change_messages(read_events(spark, sf_dir), with_value=False)
    return on_topics(every, TOPIC_PATTERN).select("topic", "partition", "offset")


def feed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topics of both servers in one pass."""
    every = change_messages(read_events(spark, sf_dir), with_value=False)
    both = on_topics(every, *(f"^tickets_server_{server}[.]" for server in (1, 2)))
    return both.groupBy("topic", "partition").agg(
        F.count(F.lit(1)).alias("messages"), F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset")
    )


def capture_table_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = change_messages(read_events(spark, sf_dir), with_value=False)
    return decode.captured_tables(every).select("offset", "source_table")


def decode_valid_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoded(spark, sf_dir).select("topic", "partition", "offset", "text")


def bronze_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.bronze_rows(decoded(spark, sf_dir))


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode.raw_feed(decoded(spark, sf_dir))


def envelope_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(spark, sf_dir).select("batch_id", "offset", "outcome")


def ticket_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir)


def ts_ms_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).groupBy("ts_ms").agg(F.count(F.lit(1)).alias("events"))


def source_db_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).groupBy("source_db").agg(F.count(F.lit(1)).alias("events"))


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.latest_per_key(changes(spark, sf_dir)).select("batch_id", "offset", *SILVER.fieldNames())


def silver_first_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.first_batch(_one_batch(changes(spark, sf_dir)))


def silver_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch is used twice, so its winners are kept, as the worker keeps them before merging."""
    target, winners = merge_sides(spark, sf_dir)
    return silver.merge_changes(target, stored_once(winners))


def silver_added_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge of a batch with a column that Silver does not have yet."""
    target, winners = merge_sides(spark, sf_dir)
    return silver.merge_changes(target.drop("priority"), stored_once(winners))


def silver_merge_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.merge_updates(*merge_sides(spark, sf_dir))


def silver_merge_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.merge_deletes(*merge_sides(spark, sf_dir))


def silver_merge_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver.merge_inserts(*merge_sides(spark, sf_dir))


def silver_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state(spark, sf_dir).where("id IS NULL OR source_db IS NULL")


def silver_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver where no older change replaces a newer one, by `ts_ms` over all batches."""
    return silver.silver_state(changes(spark, sf_dir), guard_ts=True)


def late_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch winners that the guard refuses, and what their ticket had seen."""
    late = silver.late_changes(silver.latest_per_key(changes(spark, sf_dir)))
    return late.select("batch_id", "id", "source_db", "ts_ms", "mark")


def gold_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold after the merge, from the counts before it and the rows the merge takes out and puts in."""
    target, winners = map(stored_once, merge_sides(spark, sf_dir))
    added = winners.where(silver.IS_UPSERT)
    return gold.gold_after_changes(gold.gold_counts(target), silver.replaced_rows(target, winners), added)


def gold_summary_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = gold.gold_summary(gold_table(spark, sf_dir))
    return summary.select("source_db", F.explode("summary").alias("status", "count"))


def gold_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column for every database that Gold names."""
    return gold.gold_pivot(stored_once(gold_table(spark, sf_dir)))


def gold_of_no_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold of a Silver that the deletes of all changes leave empty: typed, without rows."""
    deletes = changes(spark, sf_dir).where(silver.IS_DELETE)
    return gold.gold_counts(silver.silver_state(deletes))


def gold_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gold.gold_dimensions(gold_table(spark, sf_dir))


def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets.batch_outcomes(classified(spark, sf_dir))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = stored_once(throughput.interval_counts(decoded(spark, sf_dir)))
    return throughput.with_rate(throughput.fill_intervals(counts, per_chunk=60))


def throughput_3s(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that do not divide their events evenly, so that rates are cut."""
    counts = stored_once(throughput.interval_counts(decoded(spark, sf_dir), 3.0))
    return _with_text_start(throughput.with_rate(throughput.fill_intervals(counts, 3.0), 3.0))


def _with_text_start(rows: DataFrame) -> DataFrame:
    return rows.withColumn("interval_start", timing.iso_utc(F.col("interval_start")))


def throughput_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_text_start(points(spark, sf_dir))


def throughput_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = throughput.with_running_total(points(spark, sf_dir), chunk="1 minute")
    return _with_text_start(totals.select("interval_start", "events_in_interval", "total_received"))


def throughput_last60(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_text_start(throughput.last_points(points(spark, sf_dir)))


def throughput_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per minute, added up from the seconds."""
    return _with_text_start(throughput.rolled_up(throughput.interval_counts(decoded(spark, sf_dir)), 60.0))


def throughput_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per hour, added up from the minutes."""
    minutes = throughput.rolled_up(throughput.interval_counts(decoded(spark, sf_dir)), 60.0)
    return _with_text_start(throughput.rolled_up(minutes, 3600.0))


# A run of the streaming jobs

STREAM_BATCHES = 24
_streams: dict[tuple[str, str], str] = {}


#: Messages of one landed file; a batch of more lands as several files, each written, and later read, by a task of its own.
FILE_MESSAGES = 25_000


def _landed(events: DataFrame, folder: str, rows: int, batches: range) -> int:
    """Lands the messages of some batches, a write after the other; returns the files of each.

    The events are dealt out before their messages are made of them. A batch of few messages, where event numbers have gaps,
    gets empty files, as the streams tell batches by the number of files.
    """
    files = max(1, -(-rows // FILE_MESSAGES))
    held = _files_in(events.sparkSession, folder)
    for batch in batches:
        part = events.where(F.col("event_id").between(batch * rows, (batch + 1) * rows - 1))
        messages = change_messages(part.repartition(files), batch_rows=rows).select(*MESSAGE.fieldNames())
        messages.write.mode("append").parquet(folder)
        held += files
        for _ in range(held - _files_in(events.sparkSession, folder)):
            events.sparkSession.createDataFrame([], MESSAGE).coalesce(1).write.mode("append").parquet(folder)
    return files


def _files_in(spark: SparkSession, folder: str) -> int:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.listStatus(path) if files.exists(path) else []
    return sum(status.getPath().getName().startswith("part-") for status in found)


def _streamed(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the tables after the events went through both jobs, one run for all queries of a session.

    The worker takes STREAM_BATCHES landed batches, is stopped half-way, rewrites Silver, packs the older batches and goes
    on; last it is given a batch that fails. The monitor reads the same files newest first, so that
    time stamps run backwards, and rolls its counts up.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _streams:
        return _streams[key]
    root = f"{shared_folder(spark)}/lake-{uuid.uuid4().hex}"
    worker = TicketWorker(spark, f"{root}/tickets", WorkerOptions(gold_refresh_sec=5.0))
    events = read_events(spark, sf_dir)
    count, last = events.agg(F.count(F.lit(1)), F.max("event_id")).first()
    rows, half = -(-count // STREAM_BATCHES), STREAM_BATCHES // 2
    for batches in (range(half), range(half, last // rows + 1)):
        files = _landed(events, f"{root}/landed", rows, batches)
        landed = file_messages(spark, f"{root}/landed", files_per_batch=files)
        worker.run(on_topics(landed, TOPIC_PATTERN), available_now=True)
        if half in batches:
            break
        worker.rewrite_silver()
        for table in ("bronze", "log"):
            worker.tables.packs(table).pack(worker.tables.committed_through() - 1, worker.options.pack_bytes)
    unreadable = spark.read.parquet(f"{root}/landed").withColumn("value", F.raise_error(F.lit("unreadable")).cast("binary"))
    try:
        worker.apply_batch(unreadable, worker.tables.committed_through() + 1)
    except Exception as error:
        if "unreadable" not in str(error):
            raise
    backwards = file_messages(spark, f"{root}/landed", files_per_batch=files, latest_first=True)
    monitor.start_throughput(on_topics(backwards, TOPIC_PATTERN), root, available_now=True).awaitTermination()
    monitor.roll_up(spark, root)
    _streams[key] = root
    return root


def _tables(spark: SparkSession, sf_dir: str) -> TicketTables:
    return TicketTables(spark, f"{_streamed(spark, sf_dir)}/tickets")


def stream_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).silver()


def stream_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tables(spark, sf_dir).gold()


def stream_batch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _tables(spark, sf_dir).log().where(F.col("kind") == health.BATCH)
    return log.select("batch_id", "success", "received", "processed", "failed", "ignored")


def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_text_start(monitor.throughput_points(spark, _streamed(spark, sf_dir)))


def stream_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message once, from packed batches and from folders."""
    rows = _tables(spark, sf_dir).bronze()
    return rows.select("batch_id", "topic", "partition", "offset", "raw_payload", "outcome")


def stream_gold_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a viewer gets on connecting."""
    return gold_report(_tables(spark, sf_dir)).select("source_db", F.explode("summary").alias("status", "count"))


def stream_last60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest points of the chart, from the tier of seconds."""
    return _with_text_start(monitor.last_points(spark, _streamed(spark, sf_dir)))


def stream_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_text_start(monitor.tier_counts(spark, _streamed(spark, sf_dir), "minute"))


def rebuild_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold after Silver was made anew from the text in Bronze."""
    tables = _tables(spark, sf_dir)
    rebuild.rebuild(tables, parse_again=True)
    return tables.gold()


def worker_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of the log that the run left; the time of the run is not part of the result."""
    metrics = health.worker_metrics(_tables(spark, sf_dir).log())
    return metrics.select("events_received", "batches_ok", "batches_failed", _failed_step())


def worker_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = health.worker_status(health.worker_metrics(_tables(spark, sf_dir).log()))
    return status.select("status", _failed_step())


def _failed_step() -> Column:
    """The step that the last error names; what follows is the engine's own text."""
    return F.substring_index("last_error", ":", 1).alias("last_error")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "topic_subscription": topic_subscription,
    "feed_union": feed_union,
    "capture_table_filter": capture_table_filter,
    "decode_valid_messages": decode_valid_messages,
    "bronze_rows": bronze_rows,
    "raw_feed": raw_feed,
    "envelope_classify": envelope_classify,
    "ticket_changes": ticket_changes,
    "quarantined_changes": quarantined_changes,
    "ts_ms_default": ts_ms_default,
    "source_db_default": source_db_default,
    "latest_per_key": latest_per_key,
    "silver_first_batch": silver_first_batch,
    "silver_merge": silver_merge,
    "silver_added_column": silver_added_column,
    "silver_merge_updates": silver_merge_updates,
    "silver_merge_deletes": silver_merge_deletes,
    "silver_merge_inserts": silver_merge_inserts,
    "silver_null_keys": silver_null_keys,
    "silver_state": state,
    "silver_guarded": silver_guarded,
    "late_changes": late_changes,
    "gold_counts": gold_table,
    "gold_refresh": gold_refresh,
    "gold_summary_map": gold_summary_map,
    "gold_pivot": gold_pivot,
    "gold_of_no_tickets": gold_of_no_tickets,
    "gold_dimensions": gold_dimensions,
    "batch_outcomes": batch_outcomes,
    "throughput_windows": throughput_windows,
    "throughput_3s": throughput_3s,
    "throughput_running_total": throughput_running_total,
    "throughput_last60": throughput_last60,
    "throughput_minutes": throughput_minutes,
    "throughput_hours": throughput_hours,
    "stream_silver": stream_silver,
    "stream_gold": stream_gold,
    "stream_batch_log": stream_batch_log,
    "stream_throughput": stream_throughput,
    "stream_bronze": stream_bronze,
    "stream_gold_report": stream_gold_report,
    "stream_last60": stream_last60,
    "stream_minutes": stream_minutes,
    "rebuild_gold": rebuild_gold,
    "worker_metrics": worker_metrics,
    "worker_status": worker_status,
}

"""Counters and health over the batch log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a row of the log reports: a batch, a failed attempt, a failure of the source that is tried again, or a Gold
# refresh between batches.
BATCH, FAILURE, RETRY, GOLD_REFRESH = "batch", "failure", "retry", "gold"


def worker_metrics(batch_log: DataFrame) -> DataFrame:
    """Totals over the log, one row; `last_error` is cleared by the next good batch."""
    attempts = batch_log.where(F.col("kind").isin(BATCH, FAILURE, RETRY))
    newest = F.max_by(
        F.struct("finished_at", "success", "error_message"), F.struct("finished_at", "batch_id")
    )
    return (
        attempts.agg(
            F.coalesce(F.sum(F.when(F.col("success"), F.col("received"))), F.lit(0)).alias("events_received"),
            F.count_if("success").alias("batches_ok"),
            F.count_if(~F.col("success")).alias("batches_failed"),
            newest.alias("_newest"),
        )
        .select(
            "events_received",
            "batches_ok",
            "batches_failed",
            F.col("_newest.finished_at").alias("last_batch_at"),
            F.when(~F.col("_newest.success"), F.col("_newest.error_message")).alias("last_error"),
        )
    )


def worker_status(metrics: DataFrame, alive: bool = False, running: bool = False) -> DataFrame:
    """`degraded` while the last attempt has an error, or the job has stopped though its process lives; else `ok`.

    `alive` and `running` are facts of the job's process; nothing is known of them from the log alone.
    """
    troubled = (F.coalesce(F.col("last_error"), F.lit("")) != "") | F.lit(alive and not running)
    return metrics.withColumn("status", F.when(troubled, "degraded").otherwise("ok"))

"""Bronze rows to ticket changes, and the outcome counts of a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import envelope
from tidemark.functions.once import with_computed_once
from tidemark.schemas import ENVELOPE, SILVER

# Position of an event; `offset` breaks ties of `ts_ms`, the rest makes the order total.
POSITION = ["batch_id", "topic", "partition", "offset"]


def classify_events(bronze: DataFrame) -> DataFrame:
    """Adds outcome and ticket fields to Bronze rows; the fields count only where the outcome is `ok`.

    Rows with `event` were read on the way in and lose it here; of others the text is parsed.
    """
    kept = [name for name in bronze.columns if name != "event"]
    if "event" not in bronze.columns:
        parsed = with_computed_once(bronze, wrapped=F.from_json("raw_payload", ENVELOPE))
        bronze = parsed.select(*kept, F.col("wrapped.payload").alias("event"))
    body = F.col("event.payload")
    image = F.col("image")
    return bronze.select(
        *kept,
        envelope.event_outcome(body).alias("outcome"),
        envelope.row_image(body).alias("image"),
        envelope.source_database(body).alias("source_db"),
        body["op"].alias("op"),
        envelope.change_time(body).alias("ts_ms"),
    ).select(
        *kept,
        "outcome",
        envelope.ticket_id(image).alias("id"),
        *(image[name].alias(name) for name in ("project_id", "reporter_id", "status", "priority")),
        "source_db",
        "op",
        "ts_ms",
    )


def ticket_changes(events: DataFrame) -> DataFrame:
    """The classified events that change a ticket."""
    return events.where(F.col("outcome") == envelope.OK).select(*POSITION, *SILVER.fieldNames())


def quarantined_changes(events: DataFrame) -> DataFrame:
    """The classified events set aside for the type of their id, with the raw text."""
    return events.where(F.col("outcome") == envelope.QUARANTINED).select(*POSITION, "raw_payload")


def batch_outcomes(events: DataFrame) -> DataFrame:
    """Counts per batch: rows received, failed (or set aside) and ignored, and tickets touched (`processed`).

    Grouped by ticket first, so a busy batch or ticket is spread and pre-aggregated before it meets
    the one row of its batch.
    """
    is_ok = F.col("outcome") == envelope.OK
    per_ticket = (
        events.groupBy(
            "batch_id",
            "outcome",
            F.when(is_ok, F.col("id")).alias("id"),
            F.when(is_ok, F.col("source_db")).alias("source_db"),
        )
        .agg(F.count(F.lit(1)).alias("rows"))
    )

    def rows_with(*outcomes: str):
        return F.sum(F.when(F.col("outcome").isin(*outcomes), F.col("rows")).otherwise(0))

    return per_ticket.groupBy("batch_id").agg(
        F.sum("rows").alias("received"),
        F.count_if(is_ok).alias("processed"),
        rows_with(envelope.FAILED, envelope.QUARANTINED).alias("failed"),
        rows_with(envelope.IGNORED).alias("ignored"),
    )

"""Messages to Bronze rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.messages import is_json_object, parsed, topic_or_unknown, wrap_event
from tidemark.functions.once import with_computed_once
from tidemark.schemas import EVENT

# Fixed value: tables the capture includes.
CAPTURED_TABLES = ".*Tickets$"


def captured_tables(changes: DataFrame, pattern: str = CAPTURED_TABLES) -> DataFrame:
    """Changes of the tables the capture is set to include."""
    return changes.where(F.col("source_table").rlike(pattern))


def _decoded(messages: DataFrame, fields: T.StructType) -> DataFrame:
    """Messages holding a JSON object, with `text` in place of `value`, and `read`, which proves it."""
    kept = [F.col(name) for name in messages.columns if name != "value"]
    texts = messages.select(*kept, F.col("value").cast("string").alias("text"))
    read = with_computed_once(texts, read=parsed(F.col("text"), fields))
    return read.where(is_json_object(F.col("text"), F.col("read")))


def decode_messages(messages: DataFrame) -> DataFrame:
    """Messages holding a JSON object, with `text` in place of `value`; all others are skipped."""
    return _decoded(messages, T.StructType([])).drop("read")


def decode_events(messages: DataFrame) -> DataFrame:
    """The same with `event`, what is read of the text, from the parse that tests it."""
    return _decoded(messages, EVENT).withColumn("event", F.get("read", F.lit(0))).drop("read")


def bronze_rows(decoded: DataFrame) -> DataFrame:
    """One raw row per decoded message, foreign tables and broken envelopes included; `event` and `batch_id` stay."""
    topic = topic_or_unknown(F.col("topic"))
    kept = [F.col(name) for name in ("batch_id", "event") if name in decoded.columns]
    return decoded.select(
        *kept,
        topic.alias("topic"),
        "partition",
        "offset",
        wrap_event(topic, F.col("partition"), F.col("offset"), F.col("text")).alias("raw_payload"),
    )


def raw_feed(decoded: DataFrame) -> DataFrame:
    """The decoded messages themselves, for a viewer."""
    return decoded.select(
        topic_or_unknown(F.col("topic")).alias("topic"), "partition", "offset", F.col("text").alias("payload")
    )

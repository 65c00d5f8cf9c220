"""Table schemas. Field names and types are fixed; only `batch_id` is added to the logical columns."""

from pyspark.sql import types as T

# Columns read from a message source; a Kafka source has these among its own.
MESSAGE = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("value", T.BinaryType()),
    ]
)

_ROW_IMAGE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("project_id", T.LongType()),
        T.StructField("reporter_id", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("priority", T.StringType()),
    ]
)

# As it is read: the id as text, so that one of another type can be told from none.
_READ_IMAGE = T.StructType([T.StructField("id", T.StringType()), *_ROW_IMAGE.fields[1:]])

# The part of a message that is read; all other fields are skipped by the JSON parser. The source is a map, so that a
# key that is there and null can be told from none.
EVENT = T.StructType(
    [
        T.StructField(
            "payload",
            T.StructType(
                [
                    T.StructField("op", T.StringType()),
                    T.StructField("ts_ms", T.LongType()),
                    T.StructField("source", T.MapType(T.StringType(), T.StringType())),
                    T.StructField("before", _READ_IMAGE),
                    T.StructField("after", _READ_IMAGE),
                ]
            ),
        )
    ]
)

# The same in a Bronze payload, which wraps the message.
ENVELOPE = T.StructType([T.StructField("payload", EVENT)])

SILVER = T.StructType(
    [
        *_ROW_IMAGE.fields,
        T.StructField("source_db", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("ts_ms", T.LongType()),
    ]
)

# What is stored: the raw row with what was read from it, so that nothing after it parses JSON again.
BRONZE_STORE = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("raw_payload", T.StringType()),
        T.StructField("outcome", T.StringType()),
        *SILVER.fields,
        T.StructField("batch_id", T.LongType()),
    ]
)

# What is stored: Silver plus the batch that wrote the row.
SILVER_STORE = T.StructType([*SILVER.fields, T.StructField("batch_id", T.LongType())])

GOLD = T.StructType(
    [
        T.StructField("source_db", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("count", T.LongType()),
    ]
)

BATCH_LOG = T.StructType(
    [
        T.StructField("success", T.BooleanType()),
        T.StructField("received", T.LongType()),
        T.StructField("processed", T.LongType()),
        T.StructField("failed", T.LongType()),
        T.StructField("ignored", T.LongType()),
        T.StructField("gold_recomputed", T.BooleanType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

THROUGHPUT = T.StructType(
    [
        T.StructField("interval_start", T.TimestampType()),
        T.StructField("events_in_interval", T.LongType()),
    ]
)

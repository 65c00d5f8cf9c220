"""Streaming message sources. Both give the columns of `schemas.MESSAGE`."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import MESSAGE


@dataclass(frozen=True)
class BrokerOptions:
    """Batch size, interval and starting point are fixed values; servers and topics are the deployment's."""

    bootstrap_servers: str
    topic_pattern: str = "^tickets_server_.*"
    starting_offsets: str = "earliest"
    max_batch_rows: int | None = 20_000
    flush_interval: str = "1s"
    min_partitions: int | None = None

    def for_monitor(self) -> BrokerOptions:
        """The monitor only counts what arrives from now on, all of it in each batch."""
        return replace(self, starting_offsets="latest", max_batch_rows=None)

    def reader_options(self) -> dict[str, str]:
        """A batch starts at `max_batch_rows` waiting messages, or `flush_interval` after the last one."""
        rows = str(self.max_batch_rows)
        size = {"minOffsetsPerTrigger": rows, "maxOffsetsPerTrigger": rows, "maxTriggerDelay": self.flush_interval}
        # Topics with few partitions: reads each in several pieces, so that all cores can parse.
        pieces = {} if self.min_partitions is None else {"minPartitions": str(self.min_partitions)}
        return {
            **pieces,
            "kafka.bootstrap.servers": self.bootstrap_servers,
            "subscribePattern": self.topic_pattern,
            "startingOffsets": self.starting_offsets,
            **({} if self.max_batch_rows is None else size),
        }


def broker_messages(spark: SparkSession, options: BrokerOptions) -> DataFrame:
    """Messages of all topics matching the pattern; needs the Kafka connector on the class path."""
    stream = spark.readStream.format("kafka").options(**options.reader_options()).load()
    return stream.select(*MESSAGE.fieldNames())


def file_messages(
    spark: SparkSession, path: str, files_per_batch: int | None = None, latest_first: bool = False
) -> DataFrame:
    """Messages landed as Parquet files; new files are picked up as they appear."""
    reader = spark.readStream.schema(MESSAGE).option("latestFirst", str(latest_first).lower())
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def on_topics(messages: DataFrame, *patterns: str) -> DataFrame:
    """Subscription by topic patterns, for messages that are already at rest: one pass for all patterns."""
    return messages.where(F.col("topic").rlike("|".join(f"(?:{pattern})" for pattern in patterns)))


def fan_in(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Messages of several servers as one."""
    for other in others:
        first = first.unionByName(other)
    return first

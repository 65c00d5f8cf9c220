"""Ticket counts by database and status, and the views made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gold_counts(silver: DataFrame) -> DataFrame:
    """Tickets per database and status; NULL is a group of its own."""
    return silver.groupBy("source_db", "status").agg(F.count(F.lit(1)).alias("count"))


def gold_after_changes(counts: DataFrame, replaced: DataFrame, added: DataFrame) -> DataFrame:
    """Gold of a Silver whose `counts` are known and that then lost some rows and got others.

    The same as counting it anew, at the cost of the rows that changed.
    """
    parts = [counts.select("source_db", "status", "count")]
    for rows, step in ((replaced, -1), (added, 1)):
        parts.append(rows.select("source_db", "status", F.lit(step).cast("bigint").alias("count")))
    changed = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return changed.groupBy("source_db", "status").agg(F.sum("count").alias("count")).where(F.col("count") > 0)


def named_groups(gold: DataFrame) -> DataFrame:
    """Gold without the groups that lack a database or status."""
    return gold.where(F.col("source_db").isNotNull() & F.col("status").isNotNull())


def gold_summary(gold: DataFrame) -> DataFrame:
    """One row per database with a map from status to count."""
    entries = F.collect_list(F.struct("status", "count"))
    return named_groups(gold).groupBy("source_db").agg(F.map_from_entries(entries).alias("summary"))


def gold_pivot(gold: DataFrame, databases: Sequence[str] | None = None) -> DataFrame:
    """A row per status and a column per database, 0 where a database has no such ticket.

    Without `databases` they are read from Gold, which holds few rows; pass them to save that job.
    """
    pivoted = named_groups(gold).groupBy("status").pivot("source_db", list(databases) if databases else None)
    return pivoted.agg(F.sum("count")).na.fill(0)


def gold_dimensions(gold: DataFrame) -> DataFrame:
    """The distinct databases and statuses of Gold, in one pass."""
    entries = (F.struct(F.lit(name).alias("dimension"), F.col(name).alias("value")) for name in ("source_db", "status"))
    return named_groups(gold).select(F.inline(F.array(*entries))).distinct()

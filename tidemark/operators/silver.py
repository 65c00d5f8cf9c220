"""Current state of each ticket per source database.

Inside a batch the change with the highest `ts_ms` wins. Between batches the later batch wins whatever
its `ts_ms`. A ticket without `id` or `source_db` matches nothing: its change is always added as a new row.
So the state is known without replaying the batches one by one: per key the winner of the last batch
holding that key, deletes dropped, and every winner whose key is incomplete.

With `guard_ts` a change that is older by `ts_ms` than what its ticket has seen in earlier batches is late and changes
nothing; at equal `ts_ms` the later batch wins. What a ticket has seen outlives the ticket: the delete that removed it
stays as a mark, so that nothing older brings it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.envelope import DELETE
from tidemark.schemas import SILVER

KEY = ["source_db", "id"]
IS_UPSERT = f"op <> '{DELETE}'"
IS_DELETE = f"op = '{DELETE}'"
_WITHIN_BATCH = ["ts_ms", "offset", "topic", "partition"]


def key_incomplete() -> Column:
    return F.col("id").isNull() | F.col("source_db").isNull()


def _first_per(rows: DataFrame, keys: list[str | Column], newest_first: list[str]) -> DataFrame:
    """The newest row per key.

    Spark keeps one row per key in each task before the shuffle, so a key holding a third of all rows
    moves one row per task.
    """
    order = Window.partitionBy(*keys).orderBy(*(F.desc(name) for name in newest_first))
    return rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def latest_per_key(changes: DataFrame) -> DataFrame:
    """Latest change per ticket in each batch; incomplete keys group like any other value."""
    return _first_per(changes, ["batch_id", *KEY], _WITHIN_BATCH)


def last_change(changes: DataFrame, guard_ts: bool = False) -> DataFrame:
    """The change that decides each ticket, deletes included, in one shuffle.

    Takes all changes, or the per-batch winners only: the result is the same.
    """
    order = ["ts_ms", "batch_id", *_WITHIN_BATCH[1:]] if guard_ts else ["batch_id", *_WITHIN_BATCH]
    own_row = F.when(key_incomplete(), F.col("batch_id"))
    return _first_per(changes, [*KEY, own_row], [name for name in order if name in changes.columns])


def silver_state(changes: DataFrame, guard_ts: bool = False) -> DataFrame:
    """Silver after all batches."""
    return last_change(changes, guard_ts).where(IS_UPSERT).select(*SILVER.fieldNames())


def late_changes(winners: DataFrame) -> DataFrame:
    """The winners of batches that a guard refuses, with `mark`, the newest `ts_ms` of their ticket in earlier batches.

    A ticket has one winner per batch, so a window holds as many rows of it as there are batches.
    """
    earlier = Window.partitionBy(*KEY).orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    marked = winners.where(~key_incomplete()).withColumn("mark", F.max("ts_ms").over(earlier))
    return marked.where("ts_ms < mark")


def first_batch(winners: DataFrame) -> DataFrame:
    """Silver written by its first batch; deletes have nothing to remove."""
    return winners.where(IS_UPSERT).select(*SILVER.fieldNames())


def merge_changes(target: DataFrame, winners: DataFrame, broadcast_keys: bool = False) -> DataFrame:
    """MERGE of one change per key into Silver: matched rows go, all non-delete changes come in.

    Covers update (old row out, new row in), delete (old row out) and insert (new row in). `ts_ms` is
    not compared. A column only one side has is NULL on the other. `broadcast_keys` is for callers who
    know that the winners are small: the target then stays where it is. Otherwise both sides are shuffled,
    unless Spark finds the keys small. Neither side has a complete key twice; rows without a complete key
    match nothing and are led around the join, as they would all meet in one partition.
    """
    kept = _unmatched(target.where(~key_incomplete()), winners, broadcast_keys)
    kept = kept.unionByName(target.where(key_incomplete()))
    return kept.unionByName(winners.where(IS_UPSERT), allowMissingColumns=True)


def merge_keyed(target: DataFrame, winners: DataFrame, broadcast_keys: bool = False) -> DataFrame:
    """The same for a target in which every row has a complete key, and that has all columns."""
    return _unmatched(target, winners, broadcast_keys).unionByName(winners.where(IS_UPSERT).select(*target.columns))


def _unmatched(target: DataFrame, winners: DataFrame, broadcast_keys: bool) -> DataFrame:
    keys = winners.where(~key_incomplete()).select(*KEY)
    return target.join(F.broadcast(keys) if broadcast_keys else keys, KEY, "left_anti")


def merge_dealt(target: DataFrame, winners: DataFrame, guard_ts: bool = False) -> DataFrame:
    """The deciding change of every complete key, deletes included, for a target dealt into buckets by KEY.

    One full join, for which the target stays where it is and only the winners move, however many; its rows come out
    dealt as they were. Both sides have the same columns. With `guard_ts` the target holds marks, and the winners that are
    older than what is there lose; without, its rows are all replaced.
    """
    old = target.select(*KEY, F.struct(*target.columns).alias("old"))
    new = winners.where(~key_incomplete()).select(*KEY, F.struct(*target.columns).alias("new"))
    is_new = F.col("new").isNotNull()
    if guard_ts:
        is_new &= F.coalesce(F.col("new.ts_ms") >= F.col("old.ts_ms"), F.lit(True))
    row = F.when(is_new, F.col("new")).otherwise(F.col("old"))
    return old.join(new, KEY, "full").select(row.alias("row")).select("row.*")


def newer_changes(target: DataFrame, winners: DataFrame, broadcast_keys: bool = False) -> DataFrame:
    """The winners that a guard lets through, by the rows and marks of `target`."""
    marks = replaced_rows(target, winners, broadcast_keys).select(*KEY, F.col("ts_ms").alias("_mark"))
    marked = winners.join(F.broadcast(marks) if broadcast_keys else marks, KEY, "left")
    kept = marked.where(F.coalesce(F.col("ts_ms") >= F.col("_mark"), F.lit(True)))
    return kept.select(*winners.columns)


def replaced_rows(target: DataFrame, winners: DataFrame, broadcast_keys: bool = False) -> DataFrame:
    """The rows a merge takes out of Silver, by update or delete."""
    keys = winners.where(~key_incomplete()).select(*KEY)
    return target.where(~key_incomplete()).join(F.broadcast(keys) if broadcast_keys else keys, KEY, "left_semi")


def merge_updates(target: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows a merge changes in place, with their new values."""
    return winners.where(IS_UPSERT).join(target.select(*KEY), KEY, "left_semi")


def merge_deletes(target: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows a merge removes, with their old values."""
    return replaced_rows(target, winners.where(IS_DELETE))


def merge_inserts(target: DataFrame, winners: DataFrame) -> DataFrame:
    """The rows a merge adds, those with incomplete keys among them."""
    upserts = winners.where(IS_UPSERT)
    new = upserts.where(~key_incomplete()).join(target.select(*KEY), KEY, "left_anti")
    return new.unionByName(upserts.where(key_incomplete()))

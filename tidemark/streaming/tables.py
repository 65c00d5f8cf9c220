"""Stored tables under one root folder, as plain Parquet.

    bronze/batch_id=N      raw rows of batch N, with outcome and ticket fields
    changes/batch_id=N     one deciding change per ticket of batch N, deletes included
    silver/through=N       full state after batch N, written from time to time: tickets with a complete key
    unkeyed/through=N      its other tickets, which match nothing and only ever get more
    counts/through=N       its rows per database and status
    gold/through=N         counts after batch N
    log/kind=K/batch_id=N  what became of batch N
    packs/                 old batches of bronze and log in few large files (packs.py)

A batch writes its own folder by overwrite, so writing it again leaves the same rows. Silver at any
batch is the newest full state with the later changes merged in: a batch costs its own size, whatever
the size of Silver, and a reader never sees a batch half applied.

The full state is dealt into buckets by key, and sorted by id in each. So a merge of many changes moves the changes to
the buckets and the state nowhere, and the new state comes out dealt alike. A few changed ids are looked up through
the row groups' ranges and Bloom filters. With `guard_ts` the full state also keeps the deletes, as marks of what a ticket has
seen; readers leave them out.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas
from tidemark.operators import gold, health, silver
from tidemark.session import KEY_LIST
from tidemark.streaming.packs import Packs

_WRITTEN = "_SUCCESS"

# Pending changes of up to so many bytes of Parquet are matched by broadcast.
BROADCAST_BYTES = 16 << 20

# A bucket of the full state, and a row group in it (of Parquet). There are powers of two of buckets, so that a
# growing state is dealt anew only now and then.
BUCKET_BYTES = 256 << 20
ROW_GROUP_BYTES = 16 << 20
_BUCKETS = "_buckets="


@dataclass(frozen=True)
class TicketTables:
    spark: SparkSession
    root: str
    guard_ts: bool = False
    bucket_bytes: int = BUCKET_BYTES
    row_group_bytes: int = ROW_GROUP_BYTES

    def within(self, session: SparkSession) -> TicketTables:
        """The same tables in another session."""
        return replace(self, spark=session)

    # Folders

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def batch_path(self, table: str, batch_id: int) -> str:
        return self.path(table, f"batch_id={batch_id}")

    def log_path(self, kind: str, batch_id: int) -> str:
        return self.path("log", f"kind={kind}", f"batch_id={batch_id}")

    def _file_system(self):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path
        return hadoop_path, hadoop_path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def numbered(self, folder: str, key: str) -> list[int]:
        """Numbers N of the folders `folder/key=N`, ascending."""
        hadoop_path, files = self._file_system()
        parent = hadoop_path(self.path(folder))
        if not files.exists(parent):
            return []
        names = (status.getPath().getName() for status in files.listStatus(parent))
        return sorted(int(name.split("=", 1)[1]) for name in names if name.startswith(f"{key}="))

    def newest_written(self, folder: str, key: str, at_most: int | None = None) -> int:
        """Highest number of a folder that was written to the end, -1 if there is none."""
        for n in reversed(self.numbered(folder, key)):
            if (at_most is None or n <= at_most) and self.exists(folder, f"{key}={n}", _WRITTEN):
                return n
        return -1

    def exists(self, *parts: str) -> bool:
        hadoop_path, files = self._file_system()
        return files.exists(hadoop_path(self.path(*parts)))

    def remove(self, *parts: str) -> None:
        hadoop_path, files = self._file_system()
        files.delete(hadoop_path(self.path(*parts)), True)

    def size_of(self, *parts: str) -> int:
        """Bytes of a folder."""
        hadoop_path, files = self._file_system()
        return files.getContentSummary(hadoop_path(self.path(*parts))).getLength()

    # Readers

    def _read(self, schema: T.StructType, table: str, *folders: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path(table)).parquet(*folders)

    def packs(self, table: str) -> Packs:
        schema = {"bronze": schemas.BRONZE_STORE, "log": schemas.BATCH_LOG}[table]
        return Packs(self.spark, self.root, table, schema)

    def bronze(self) -> DataFrame:
        """The rows of all committed batches; one that is being written is left out."""
        return self.packs("bronze").read().where(F.col("batch_id") <= self.committed_through())

    def bronze_batch(self, batch_id: int) -> DataFrame:
        return self._read(schemas.BRONZE_STORE, "bronze", self.batch_path("bronze", batch_id))

    def changes_batch(self, batch_id: int) -> DataFrame:
        return self._read(schemas.SILVER_STORE, "changes", self.batch_path("changes", batch_id))

    def changes_between(self, after: int, through: int) -> DataFrame:
        folders = (self.batch_path("changes", n) for n in self.pending_batches(after, through))
        return self._read(schemas.SILVER_STORE, "changes", *folders)

    def log(self) -> DataFrame:
        return self.packs("log").read()

    def committed_through(self) -> int:
        """Last batch that was written whole, -1 before the first."""
        return self.newest_written("log/kind=batch", "batch_id")

    def full_state_through(self, through: int) -> int:
        """Batch of the newest full state not after `through`, -1 if there is none."""
        return self.newest_written("silver", "through", at_most=through)

    def pending_batches(self, base: int, through: int) -> list[int]:
        """Batches whose changes the full state `base` does not hold yet."""
        return [n for n in self.numbered("changes", "batch_id") if base < n <= through]

    def state_sizes(self, base: int, through: int) -> tuple[int, int]:
        """Bytes of the full state `base`, 0 if there is none, and of the changes after it."""
        state_bytes = self.size_of("silver", f"through={base}") if base >= 0 else 0
        return state_bytes, sum(self.size_of("changes", f"batch_id={n}") for n in self.pending_batches(base, through))

    # The full state

    def _buckets(self, base: int) -> int | None:
        """Buckets of a full state, None if it is not dealt."""
        hadoop_path, files = self._file_system()
        names = (f.getPath().getName() for f in files.listStatus(hadoop_path(self.path("silver", f"through={base}"))))
        return next((int(name.removeprefix(_BUCKETS)) for name in names if name.startswith(_BUCKETS)), None)

    def _table_name(self, base: int, buckets: int) -> str:
        """Name under which the session's catalog knows a dealt state: only tables of a catalog can have buckets."""
        return f"tidemark_{hashlib.md5(self.path('').encode()).hexdigest()[:16]}_{base}_{buckets}"

    def state(self, base: int) -> DataFrame:
        """The rows of the full state `base` with a complete key, marks included."""
        path, buckets = self.path("silver", f"through={base}"), self._buckets(base)
        if buckets is None:
            return self.spark.read.schema(schemas.SILVER_STORE).parquet(path)
        name = self._table_name(base, buckets)
        columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schemas.SILVER_STORE.fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (source_db, id) "
            f"SORTED BY (id, source_db) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows.where(silver.IS_UPSERT) if self.guard_ts else rows

    def _unkeyed(self, base: int) -> DataFrame:
        # The folder is read as a table of its own: its number is not a column.
        return self.spark.read.schema(schemas.SILVER_STORE).parquet(self.path("unkeyed", f"through={base}"))

    def silver_rows(self, through: int) -> DataFrame | None:
        """Silver after batch `through` as stored rows; None if no ticket was ever written."""
        base = self.full_state_through(through)
        pending = self.changes_between(base, through)
        winners = silver.last_change(pending, self.guard_ts)
        if base < 0:
            return None if pending.where(silver.IS_UPSERT).isEmpty() else winners.where(silver.IS_UPSERT)
        few = self.state_sizes(base, through)[1] <= BROADCAST_BYTES
        if few and not self.guard_ts:
            return silver.merge_keyed(self.state(base), winners, broadcast_keys=True).unionByName(self._unkeyed(base))
        keyed, unkeyed = self.next_state(base, winners)
        return keyed.where(silver.IS_UPSERT).unionByName(unkeyed)

    def next_state(self, base: int, winners: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The state after `base` and later winners: rows with a complete key, deletes included, and the others."""
        added = winners.where(silver.key_incomplete()).where(silver.IS_UPSERT).select(*schemas.SILVER_STORE.fieldNames())
        if base < 0:
            return winners.where(~silver.key_incomplete()).select(*added.columns), added
        keyed = silver.merge_dealt(self.state(base), winners, self.guard_ts)
        return keyed, self._unkeyed(base).unionByName(added)

    def gold_rows(self, through: int) -> DataFrame | None:
        """Gold after batch `through`; None if no ticket was ever written.

        The counts of the full state are taken over. Of its rows only those the pending changes replace
        are needed: their ids go to the scan, or the range of the ids if they are many, and it skips the row groups
        that hold none of them.
        """
        base = self.full_state_through(through)
        if base < 0:
            rows = self.silver_rows(through)
            return None if rows is None else gold.gold_counts(rows)
        pending = self.changes_between(base, through)
        few = self.state_sizes(base, through)[1] <= BROADCAST_BYTES
        winners = silver.last_change(pending, self.guard_ts)
        near = self.state(base).where(self._ids_of(pending))
        if self.guard_ts:
            winners = silver.newer_changes(near, winners, broadcast_keys=few)
        replaced = silver.replaced_rows(self._live(near), winners, broadcast_keys=few)
        return gold.gold_after_changes(self._counts(base), replaced, winners.where(silver.IS_UPSERT))

    def _ids_of(self, changes: DataFrame) -> Column:
        """A filter for the ids of some changes: a list of up to KEY_LIST, or their range."""
        ids = [row.id for row in changes.where("id IS NOT NULL").select("id").distinct().limit(KEY_LIST + 1).collect()]
        if len(ids) <= KEY_LIST:
            return F.col("id").isin(ids)
        first, last = changes.agg(F.min("id"), F.max("id")).first()
        return F.col("id").between(F.lit(first), F.lit(last))

    def _counts(self, base: int) -> DataFrame:
        """Counts of a full state, made by whoever needs them first."""
        path = self.path("counts", f"through={base}")
        if not self.exists("counts", f"through={base}", _WRITTEN):
            rows = self._live(self.state(base)).unionByName(self._unkeyed(base))
            gold.gold_counts(rows).repartition(1).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schemas.GOLD).parquet(path)

    def silver(self) -> DataFrame | None:
        rows = self.silver_rows(self.committed_through())
        return None if rows is None else rows.select(*schemas.SILVER.fieldNames())

    def gold(self) -> DataFrame | None:
        """The newest Gold table, None before the first."""
        newest = self.newest_written("gold", "through")
        if newest < 0:
            return None
        return self.spark.read.schema(schemas.GOLD).parquet(self.path("gold", f"through={newest}"))

    # Writers

    def write_gold(self, through: int) -> bool:
        """Gold after batch `through`; False, and nothing written, while there is no Silver."""
        rows = self.gold_rows(through)
        if rows is None:
            return False
        rows.repartition(1).write.mode("overwrite").parquet(self.path("gold", f"through={through}"))
        self.drop_older("gold")
        self.write_log(health.GOLD_REFRESH, through, processed=0, failed=0, gold_recomputed=True)
        return True

    def buckets_for(self, size: int, before: int | None = None) -> int:
        """Buckets for a state of so many bytes: a power of two, and as before unless that is off by more than four."""
        wanted = 1 << max(0, -(-size // self.bucket_bytes) - 1).bit_length()
        return before if before and before // 4 <= wanted <= before else wanted

    def write_full_state(self, keyed: DataFrame, unkeyed: DataFrame, through: int, buckets: int, dealt: bool = False) -> None:
        """Full state after batch `through`; `dealt` if the keyed rows lie in so many partitions by key already."""
        fields = schemas.SILVER_STORE.fieldNames()
        rows = keyed if self.guard_ts else keyed.where(silver.IS_UPSERT)
        rows = rows.select(*fields) if dealt else rows.select(*fields).repartition(buckets, *silver.KEY)
        self.remove("counts", f"through={through}")
        self.remove("silver", f"through={through}")
        unkeyed.select(*fields).write.mode("overwrite").parquet(self.path("unkeyed", f"through={through}"))
        path = self.path("silver", f"through={through}")
        options = {
            "path": path,
            "parquet.block.size": self.row_group_bytes,
            "parquet.bloom.filter.enabled#id": "true",
            "parquet.bloom.filter.adaptive.enabled": "true",
            "parquet.bloom.filter.max.bytes": 128 << 10,
        }
        writer = rows.write.format("parquet").mode("overwrite").options(**options)
        name = self._table_name(through, buckets)
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        writer.bucketBy(buckets, *silver.KEY).sortBy("id", "source_db").saveAsTable(name)
        # Without this mark, after a crash here, the state is read as files that are not dealt.
        hadoop_path, files = self._file_system()
        files.create(hadoop_path(f"{path}/{_BUCKETS}{buckets}"), True).close()

    def drop_older(self, table: str) -> int | None:
        """Keeps the newest version and the one before, for those who still read it.

        Returns the number of the one before, None if the newest is the only one. What a crash left
        half written goes too.
        """
        versions = self.numbered(table, "through")
        kept = [n for n in versions if self.exists(table, f"through={n}", _WRITTEN)][-2:]
        for n in versions:
            if n not in kept:
                if table == "silver":
                    self.remove("counts", f"through={n}")
                    self.remove("unkeyed", f"through={n}")
                    if buckets := self._buckets(n):
                        self.spark.sql(f"DROP TABLE IF EXISTS {self._table_name(n, buckets)}")
                self.remove(table, f"through={n}")
        return kept[0] if len(kept) == 2 else None

    def write_log(
        self, kind: str, batch_id: int, error_message: str | None = None, **values: int | bool | None
    ) -> None:
        """One row, by overwrite for what can be repeated and by append for a failure, of which there may be more."""
        row = {"success": error_message is None, "error_message": error_message, "gold_recomputed": False, **values}
        columns = [
            F.lit(row.get(field.name)).cast(field.dataType).alias(field.name)
            for field in schemas.BATCH_LOG.fields
            if field.name not in ("finished_at", "kind", "batch_id")
        ]
        entry = self.spark.range(1, numPartitions=1).select(*columns, F.current_timestamp().alias("finished_at"))
        entry.write.mode("append" if error_message else "overwrite").parquet(self.log_path(kind, batch_id))

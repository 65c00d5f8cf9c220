"""Folders of single batches joined up to few large files, with an atomic switch.

    packs/TABLE/version=V    a marker: the packs that count, and the folders they replace
    packs/TABLE/data-U/pack=K   the packs that one run wrote

A run deals successive batches to packs by their bytes, writes each pack as one file, and then creates one marker.
A pack is written by one task that passes its batches through row by row: nothing is shuffled or sorted, so the task holds
a row group, whatever the size of the pack.
Until the marker is there its packs do not count, and from then on the folders it names do not; so a reader sees
every row once, whenever it looks, and a crash before or after the switch leaves nothing to repair. What a marker
replaced is deleted by the next run, when nobody reads it any more. Of two runs at a time one fails to create its
marker, and its packs never count.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Packs that one job writes, and a row group in them (of Parquet), which is also the least that a reader's task can take.
JOB_PACKS = 64
ROW_GROUP_BYTES = 8 << 20


@dataclass(frozen=True)
class Marker:
    version: int = 0
    packs: list[str] = field(default_factory=list)
    replaced: list[str] = field(default_factory=list)


def packs_of(sizes: list[tuple[int, int]], pack_bytes: int) -> list[int]:
    """Last batches of the packs of successive batches (number, bytes): a pack ends when it reaches `pack_bytes`."""
    ends, held = [], 0
    for batch, size in sizes:
        if held == 0:
            ends.append(batch)
        ends[-1] = batch
        held = 0 if held + size >= pack_bytes else held + max(size, 1)
    return ends


@dataclass(frozen=True)
class Packs:
    """A table of batch folders (`.../batch_id=N`, at any depth below other `name=value` folders) under `root`."""

    spark: SparkSession
    root: str
    table: str
    schema: T.StructType

    def _path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def _files(self):
        hadoop_path = self.spark._jvm.org.apache.hadoop.fs.Path
        return hadoop_path, hadoop_path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *parts: str) -> list[str]:
        hadoop_path, files = self._files()
        folder = hadoop_path(self._path(*parts))
        if not files.exists(folder):
            return []
        return sorted(status.getPath().getName() for status in files.listStatus(folder))

    def _batch_folders(self, *parts: str) -> list[str]:
        found = []
        for name in self._names(*parts):
            if name.startswith("batch_id="):
                found.append("/".join([*parts, name]))
            elif "=" in name:
                found += self._batch_folders(*parts, name)
        return found

    # Markers

    def marker(self) -> Marker:
        """The newest marker that is whole."""
        hadoop_path, files = self._files()
        names = [name for name in self._names("packs", self.table) if name.startswith("version=")]
        for name in sorted(names, key=lambda n: int(n.split("=")[1]), reverse=True):
            stream = files.open(hadoop_path(self._path("packs", self.table, name)))
            try:
                text = bytes(stream.readAllBytes()).decode()
            finally:
                stream.close()
            try:
                return Marker(**json.loads(text))
            except ValueError:
                continue
        return Marker()

    def _switch(self, marker: Marker) -> None:
        hadoop_path, files = self._files()
        stream = files.create(hadoop_path(self._path("packs", self.table, f"version={marker.version}")), False)
        try:
            stream.write(bytearray(json.dumps(marker.__dict__).encode()))
        finally:
            stream.close()

    def _remove(self, folder: str) -> None:
        hadoop_path, files = self._files()
        files.delete(hadoop_path(self._path(folder)), True)

    # Reading

    def folders(self, through: int | None = None) -> list[str]:
        """Folders of batches, up to `through`, that no pack replaces."""
        replaced = set(self.marker().replaced)
        found = [folder for folder in self._batch_folders(self.table) if folder not in replaced]
        return [folder for folder in found if through is None or _batch(folder) <= through]

    def read(self) -> DataFrame:
        """Every row of the table, from packs and from folders."""
        marker = self.marker()
        parts = [self._read(self._path(self.table), *self.folders())]
        if marker.packs:
            parts.append(self.spark.read.schema(self.schema).parquet(*(self._path(pack) for pack in marker.packs)))
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        return found

    def _read(self, base: str, *folders: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema).option("basePath", base)
        return reader.parquet(*(self._path(folder) for folder in folders))

    def size(self) -> int:
        """Bytes of what counts."""
        hadoop_path, files = self._files()
        paths = [self._path(name) for name in [*self.folders(), *self.marker().packs]]
        return sum(files.getContentSummary(hadoop_path(path)).getLength() for path in paths)

    # Packing

    def pack(self, through: int, pack_bytes: int) -> bool:
        """Packs the batches up to `through`, which must not be written again; False if there are fewer than two."""
        before = self.marker()
        for folder in before.replaced:
            self._remove(folder)
        for name in self._names("packs", self.table):
            folder = f"packs/{self.table}/{name}"
            if name.startswith("data-") and not any(pack.startswith(f"{folder}/") for pack in before.packs):
                self._remove(folder)
        folders = sorted(self.folders(through), key=_batch)
        if len({_batch(folder) for folder in folders}) < 2:
            return False
        hadoop_path, files = self._files()
        sizes: dict[int, int] = {}
        for folder in folders:
            size = files.getContentSummary(hadoop_path(self._path(folder))).getLength()
            sizes[_batch(folder)] = sizes.get(_batch(folder), 0) + size
        ends = packs_of(list(sizes.items()), pack_bytes)
        target = f"packs/{self.table}/data-{uuid.uuid4().hex}"
        self._write_packs([[f for f in folders if last < _batch(f) <= end] for last, end in zip([-1, *ends], ends)], target)
        packs = [f"{target}/{name}" for name in self._names(*target.split("/")) if name.startswith("pack=")]
        self._switch(Marker(before.version + 1, [*before.packs, *packs], folders))
        return True

    def _write_packs(self, packs: list[list[str]], target: str) -> None:
        """Writes some lists of folders as a file each, in `target/pack=K`."""
        session = self.spark.newSession()
        # A task writes one pack, so it keeps one file open; without this Spark sorts its rows by pack first.
        session.conf.set("spark.sql.maxConcurrentOutputFileWriters", "1")
        reader = replace(self, spark=session)
        for first in range(0, len(packs), JOB_PACKS):
            parts = [
                reader._read(self._path(self.table), *folders).coalesce(1).withColumn("pack", F.lit(number))
                for number, folders in enumerate(packs[first : first + JOB_PACKS], first)
            ]
            writer = reduce(DataFrame.unionByName, parts).write.mode("append").option("parquet.block.size", ROW_GROUP_BYTES)
            writer.partitionBy("pack").parquet(self._path(target))


def _batch(folder: str) -> int:
    return int(folder.rsplit("=", 1)[1])

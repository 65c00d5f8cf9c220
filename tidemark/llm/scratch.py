"""What every operator needs of the cluster: its code on the executors, and lineage cut in the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import tidemark
from tidemark.session import shared_folder

PACKAGE = "tidemark.zip"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application."""
    context = spark.sparkContext
    if any(file.endswith(PACKAGE) for file in context.listFiles):
        return
    root = Path(tidemark.__file__).parent
    path = Path(tempfile.mkdtemp(prefix="tidemark-")) / PACKAGE
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(path))


def free_name(taken: Iterable[str], wanted: str) -> str:
    """`wanted`, or the same with so many line strokes behind it that no column in `taken` is called so."""
    names = {name.lower() for name in taken}
    while wanted.lower() in names:
        wanted += "_"
    return wanted


def release_memory() -> None:
    """Hands freed memory back to the system, where its C library can: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def map_arrow(
    frame: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """mapInArrow with a function of this package."""
    ship(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release_memory()

    return frame.mapInArrow(run, schema)


#: Partitions that a kept table has at most, if set.
KEPT_PARTITIONS = "tidemark.kept.partitions"


def cut(frame: DataFrame) -> DataFrame:
    """`frame`, computed now and kept by checkpoint() in the shared folder; Spark removes it when unused."""
    spark = frame.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    parts = spark.conf.get(KEPT_PARTITIONS, None)
    return (frame.coalesce(int(parts)) if parts else frame).checkpoint()


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Has the queries run within use some settings; `_` stands for a point in their names."""
    named = {name.replace("_", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name, None) for name in named}
    for name, value in named.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def frees_shuffles(spark: SparkSession):
    """Has the queries run within drop their shuffle files when they end; a lost one is computed again."""
    return settings(spark, spark_sql_classic_shuffleDependency_fileCleanup_enabled="true")


def small_batches(spark: SparkSession):
    """Has the queries run within use Arrow batches of a few MB, as a Python worker holds many times their size in arrays."""
    return settings(spark, spark_sql_execution_arrow_maxBytesPerBatch=str(8 << 20), spark_sql_execution_arrow_maxRecordsPerBatch="4000")


def few_files(docs: DataFrame, part_bytes: int = 16 << 20, least: int = 16):
    """Has what is kept within lie in a file for so many bytes of `docs` at most, whatever the number of shuffle partitions."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = min(max(size // part_bytes, least), (1 << 31) - 1)
    return settings(docs.sparkSession, tidemark_kept_partitions=str(parts))


@dataclass
class Stored:
    """A table in the shared folder, until it is removed."""

    frame: DataFrame
    path: str

    def remove(self) -> None:
        remove(self.frame.sparkSession, self.path)


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(frame: DataFrame, codec: str = "zstd") -> Stored:
    """`frame` as compressed Parquet in the shared folder; for what is too large for a checkpoint."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    frame.write.option("compression", codec).parquet(path)
    return Stored(spark.read.schema(frame.schema).parquet(path), path)

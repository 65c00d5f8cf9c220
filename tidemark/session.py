"""Session settings, sizes of large jobs, and the shared scratch folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


# Ids that a lookup in a stored table gives to the scan one by one.
KEY_LIST = 1_000


def job_builder(app_name: str) -> SparkSession.Builder:
    """Settings every job of this package expects; sizes are left to the cluster.

    Call-site tracking is off: it makes every column expression of a micro-batch several times as slow
    to build.
    """
    return (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.parquet.pushdown.inFilterThreshold", str(KEY_LIST))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by `spark.checkpoint.dir`.

    Only a local session may do without the setting; it gets a new temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="tidemark-")


def stored_once(rows: DataFrame) -> DataFrame:
    """`rows`, computed now and kept by checkpoint() in the shared folder, for a result that is used several times.

    Spark removes it once it is no longer used, in sessions with the settings of `job_builder`.
    """
    context = rows.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint()


MIB = 1 << 20


def job_sizes(input_bytes: int, max_partitions: int = 200_000) -> dict[str, str]:
    """Settings for one large job over so many bytes of Parquet.

    Shuffles start with a partition per 512 MiB of input, `max_partitions` at most (100 TB), and AQE joins
    those that stay small. Splits grow beyond 128 MiB where there would be more than 50,000 of them: the
    driver keeps a record per pair of task and partition block.
    """
    partitions = min(max(input_bytes // (512 * MIB), 200), max_partitions)
    split = max(input_bytes // 50_000, 128 * MIB)
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(split),
    }


def session_for(spark: SparkSession, input_bytes: int) -> SparkSession:
    """A session of its own for a large job, so that its sizes do not reach the micro-batches."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", str(KEY_LIST))
    for name, value in job_sizes(input_bytes).items():
        session.conf.set(name, value)
    return session

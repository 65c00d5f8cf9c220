"""A corpus pipeline over `documents`: five stages, each one operator of tidemark.llm.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and is written to the
shared folder as Parquet and read again before the next. Stages work in place of missing values as
their operators define. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, language, mixing
from tidemark.llm.queries import row_key, token_rows
from tidemark.llm.scratch import cut, free_name, remove
from tidemark.session import shared_folder

#: A document stays if this share of its letters is in learned languages, one or several.
MIN_KNOWN_SHARE = 0.5


def keep(docs: DataFrame, good: DataFrame) -> DataFrame:
    """The rows of `docs` whose id and text are in `good` (no repeats); repeated rows share their fate."""
    return named(docs).join(good, row_name(docs), "left_semi").drop(row_name(docs))


def row_name(docs: DataFrame) -> str:
    """A column that the documents do not have."""
    return free_name(docs.columns, "_row")


def named(docs: DataFrame) -> DataFrame:
    return docs.withColumn(row_name(docs), row_key())


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language, or mostly in scripts of other languages than those learned."""
    name = row_name(docs)
    found = language.identify(named(docs), docs, id_column=name)
    good = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("known") >= MIN_KNOWN_SHARE))
    return keep(docs, good.select(name))


def join_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest id, and of repeated rows one."""
    name = row_name(docs)
    good = jaccard.representatives(named(docs), name)
    return named(docs).join(good, name, "left_semi").dropDuplicates([name]).drop(name)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name = row_name(docs)
    found = decontaminate.find_passages(named(docs), benchmark, id_column=name)
    return keep(docs, decontaminate.hit_counts(found, name).where("NOT contaminated").select(name))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and shuffles documents so that sources have shares by the root of their size."""
    return mixing.mix(docs, mixing.tempered_weights(docs)).select(docs.columns)


def write_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_rows(spark, docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", join_near_duplicates),
    ("benchmark_decontamination", remove_benchmark),
    ("source_mixing", mix_sources),
    ("token_ids", write_token_ids),
]
#: Tokenizing is not expressible in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        rows = stage(spark, docs, sf_dir)
        rows.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(rows.schema).parquet(f"{folder}/{name}")
        if number:
            remove(spark, f"{folder}/{STAGES[number - 1][0]}")
    found = cut(docs)
    remove(spark, folder)
    return found

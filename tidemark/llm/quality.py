"""Quality rules: counts that rule a document out, and a hashed n-gram log-likelihood ratio.

Two multinomials over hashed runs of NGRAM bytes are counted, one over the trusted documents and one
over all. A document's score is the mean over its runs of log(p_trusted / p_all); it is kept if no
base rule fails and the score is THRESHOLD or more. The count over all takes in every document, the
trusted one the TRUSTED_DOCS trusted documents with the smallest hashes of id at most, whose ids are
broadcast. Both are summed per task before they are shuffled, and fit into 2 ** BUCKET_BITS rows
whatever the input.

Defined results: null and wordless texts have zero counts, fail the base rule and score 0; texts with
no run of NGRAM bytes score 0; without trusted documents every score is 0; repeated documents are
judged one by one, and a document is trusted if any of its labels says so; null ids are never trusted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import map_arrow
from tidemark.llm.words import NOT_WHITE, mix, run_starts, runs_of, slices, span_hashes, split_words

NGRAM = 4
BUCKET_BITS = 16
THRESHOLD = -0.25
MIN_WORDS = 50
TRUSTED_DOCS = 100_000
SYMBOLS = b"[#*$%&|<>]"[1:-1]


def byte_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each run of NGRAM bytes within one text, and how many runs each text has."""
    counts = np.maximum(np.diff(offsets) - NGRAM + 1, 0)
    if len(data) < NGRAM:
        return np.zeros(0, np.int64), counts
    wide = data.astype(np.uint64)
    code = wide[: len(data) - NGRAM + 1].copy()
    for j in range(1, NGRAM):
        code |= wide[j : len(data) - NGRAM + 1 + j] << np.uint64(8 * j)
    buckets = (mix(code) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    within = np.ones(len(data), bool)
    for end in offsets[1:]:
        within[max(0, end - NGRAM + 1) : end] = False
    return buckets[within[: len(buckets)]], counts


def ngram_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """Rows bucket, trusted, raw; `docs` has id and text, `trusted` an id column without repeats."""
    sample = trusted.where("id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(TRUSTED_DOCS)
    marked = docs.join(F.broadcast(sample.withColumn("is_trusted", F.lit(True))), "id", "left")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                flags = np.array([bool(v.as_py()) for v in batch.column("is_trusted").slice(low, high - low)])
                buckets, counts = byte_runs(data, offsets)
                good = np.repeat(flags, counts)
                totals[0] += np.bincount(buckets[good], minlength=1 << BUCKET_BITS)
                totals[1] += np.bincount(buckets, minlength=1 << BUCKET_BITS)
        found = np.flatnonzero(totals[1])
        yield pa.RecordBatch.from_pydict({"bucket": found, "trusted": totals[0][found], "raw": totals[1][found]})

    rows = map_arrow(marked.select("text", "is_trusted"), count, "bucket bigint, trusted bigint, raw bigint")
    return rows.groupBy("bucket").agg(F.sum("trusted").alias("trusted"), F.sum("raw").alias("raw"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log(p_trusted / p_all) per bucket with one added to each count; 2 ** BUCKET_BITS numbers."""
    totals = np.ones((2, 1 << BUCKET_BITS))
    rows = counts.toPandas()
    if rows["trusted"].sum() == 0:
        return np.zeros(1 << BUCKET_BITS)
    totals[0][rows["bucket"]] += rows["trusted"]
    totals[1][rows["bucket"]] += rows["raw"]
    return np.log(totals[0] / totals[0].sum()) - np.log(totals[1] / totals[1].sum())


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[r]:first[r + 1]] for each r."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def repeated_words(hashes: np.ndarray, words) -> np.ndarray:
    """Per text, the words in runs of three that it has twice or more."""
    starts = run_starts(words, 3)
    keys = mix(runs_of(hashes, 3)[starts] if len(starts) else np.zeros(0, np.uint64))
    rows = words.rows()[starts]
    _, which, counts = np.unique(keys ^ mix(rows.astype(np.uint64)), return_inverse=True, return_counts=True)
    inside = np.zeros(len(words.start), bool)
    again = starts[counts[which] > 1]
    for j in range(3):
        inside[again + j] = True
    return sums(inside.astype(np.int64), words.first)


def repeated_lines(data: np.ndarray, offsets: np.ndarray, words) -> np.ndarray:
    """Per text, the lines with a word that equal an earlier line of the text."""
    breaks = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    start = start[start < len(data)]
    row = np.searchsorted(offsets, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(data)), offsets[1:][row])
    end = end - ((end > start) & (data[end - 1] == 10))
    n_words = np.searchsorted(words.start, end) - np.searchsorted(words.start, start)
    start, end, row = start[n_words > 0], end[n_words > 0], row[n_words > 0]
    keys = span_hashes(data, start, end) ^ mix(row.astype(np.uint64))
    _, firsts = np.unique(keys, return_index=True)
    later = np.ones(len(keys), np.int64)
    later[firsts] = 0
    return np.bincount(row, later, len(offsets) - 1).astype(np.int64)


def judge(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    trusted: str = "quality = 1 AND toxic = 0",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row of `docs`: id, counts, base_failed, kept and score; `trusted` picks rows of `labels`."""
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    good = labels.where(trusted).select(F.col(id_column).alias("id")).distinct()
    weights = docs.sparkSession.sparkContext.broadcast(log_ratios(ngram_counts(plain, good)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = np.zeros(256, np.int64)
        symbols[list(SYMBOLS)] = 1
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                words = split_words(data, offsets, NOT_WHITE)
                hashes = words.hashes()
                begins = ((data & 0xC0) != 0x80) & NOT_WHITE[data]
                n_words, n_repeat = words.counts, repeated_words(hashes, words)
                buckets, counts = byte_runs(data, offsets)
                first = np.concatenate([[0], np.cumsum(counts)])
                score = sums(weights.value[buckets], first) / np.maximum(counts, 1)
                failed = (n_words < MIN_WORDS) | (100 * n_repeat > 50 * n_words)
                columns = {
                    id_column: batch.column("id").slice(low, high - low),
                    "n_words": n_words.astype(np.int64),
                    "word_chars": sums(begins.astype(np.int64), offsets),
                    "n_symbols": sums(symbols[data], offsets),
                    "n_dup_lines": repeated_lines(data, offsets, words),
                    "n_repeat_words": n_repeat,
                    "base_failed": failed,
                    "kept": ~failed & (score >= threshold),
                    "score": score,
                }
                yield pa.RecordBatch.from_pydict(columns)

    schema = (
        f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, n_words bigint, word_chars bigint, "
        "n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, score double"
    )
    return map_arrow(plain, measure, schema)

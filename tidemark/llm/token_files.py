"""Token ids of documents in files that give fast access to one short document.

A file set is a folder of Parquet tables, so that any store Spark reaches will do, and so that tasks
may be repeated:

* `dictionary`: one row with the zstandard dictionary, trained on serialized id arrays of a sample of
  about DICTIONARY_DOCS documents, twice as many at most (whole corpora compress with it; it changes
  sizes only), and its hash, the SHA-256 in hex.
* `blocks`: one row per block of about BLOCK_BYTES. `data` is the frames of successive documents, each
  compressed alone. The other columns are the offset index: `ids`, `offsets` into `data` (one more than
  documents) and `n_tokens`, with the first and last id for skipping whole blocks, the place of the
  block in the set (`shard`, `block`, and `before`, the ids of its shard before it) and the hash of
  the dictionary. Reading the index does not read `data`.

Documents lie in ascending order of id, nulls first, equal ids by a hash of the text. An id array is little-endian
unsigned 32-bit; the end id closes each document.

Defined results: null and empty texts are the end id alone; repeated documents are stored again; an
empty table gives a set without blocks; other columns are not stored.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyspark
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.scratch import map_arrow
from tidemark.llm.words import byte_table, slices, spans_equal, split_words

END_ID = 2
#: Sample for the dictionary: documents, and bytes of each that are used to train it.
DICTIONARY_DOCS, DICTIONARY_DOC_BYTES, DICTIONARY_BYTES = 1000, 16 << 10, 64 << 10
BLOCK_BYTES = 1 << 20
#: Distinct chunks whose ids and bytes a worker remembers (about 60 bytes each), and bytes of them.
REMEMBERED_CHUNKS, REMEMBERED_BYTES = 500_000, 8 << 20
CHUNK_BYTES = byte_table(" \n")
WORD_END = "</w>"
#: What stays a token of its own behind a word.
POINTS = (".", ",", ";", ":", "!", "?")


class Encoder:
    """Encodes whole columns by looking up the id arrays of chunks between blanks and line ends.

    The tokenizer drops white space and never joins what stands on both sides of it, so chunks can be
    encoded alone; each is encoded once while it is remembered. Chunks are looked up by hash, and their bytes are compared
    before the ids of one are taken for another; where they differ, the texts around are encoded whole. Every run of letters ends with
    a token that ends a word, so new chunks of letters alone are encoded together and parted at those
    tokens, and so are those with a point behind. Of a tokenizer that only lowers ASCII letters, takes them as one
    word and digits one by one, ASCII words go to the model as they are, and digits are looked up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        parts = (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))
        steps = [(stored[part] or {}).get(name, []) for part, name in parts]
        words = [step.get("pattern", {}).get("Regex", "").split("|")[-3:-1] for step in steps[1]]
        single = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in (*POINTS, *"0123456789")}
        self.direct = (
            [step["type"] for step in steps[0]] == ["NFC", "Replace", "Lowercase"]
            and [step["type"] for step in steps[1]] == ["Split", "ByteLevel"]
            and words[0] == ["[\\p{L}]+", "[\\p{N}]"]
            and all(len(ids) == 1 for ids in single.values())
        )
        self.single = {c: ids[0] for c, ids in single.items() if ids}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # sorted hashes of chunks, where their ids are in flat, and how many
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        #: The bytes of all chunks, and where those of each start and end.
        self.content, self.held = np.zeros(1 << 16, np.uint8), 0
        self.start, self.end = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _put(self, ids: np.ndarray) -> int:
        first, self.used = self.used, self.used + len(ids)
        if self.used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        self.flat[first : self.used] = ids
        return first

    def _one_by_one(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        size = np.array([len(ids) for ids in found], np.int64)
        first = self._put(np.array([i for ids in found for i in ids], np.uint32))
        return first + np.cumsum(size) - size, size

    def _together(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that are runs of letters, or these with a point behind, which is a token of its own."""
        text = " ".join(chunks)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        words = np.array([1 + (c[-1] in POINTS) for c in chunks], np.int64)
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) != words.sum() or last[-1] != len(ids):
            return self._one_by_one(chunks)
        last = last[np.cumsum(words) - 1]
        first = np.concatenate([[0], last[:-1]])
        return self._put(ids) + first, last - first

    def _direct(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ASCII words, or runs of digits, with or without a point behind."""
        tokenize, single, found = self.model.tokenize, self.single, []
        for chunk in chunks:
            body = chunk[:-1] if chunk[-1] in POINTS else chunk
            ids = [token.id for token in tokenize(body.lower())] if body.isalpha() else [single[c] for c in body]
            if body is not chunk:
                ids.append(single[chunk[-1]])
            found.append(ids)
        size = np.array([len(ids) for ids in found], np.int64)
        first = self._put(np.fromiter(chain.from_iterable(found), np.uint32, size.sum()))
        return first + np.cumsum(size) - size, size

    def _keep(self, content: bytes) -> int:
        start, self.held = self.held, self.held + len(content)
        if self.held > len(self.content):
            self.content = np.concatenate([self.content, np.zeros(max(len(self.content), len(content)), np.uint8)])
        self.content[start : self.held] = np.frombuffer(content, np.uint8)
        return start

    def _learn(self, hashes: np.ndarray, contents: list[bytes]) -> None:
        """Adds sorted hashes, with their chunks."""
        chunks = [content.decode() for content in contents]
        first, size = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        bodies = [c[:-1] if c[-1] in POINTS else c for c in chunks]
        plain = np.array([body.isalpha() for body in bodies])
        direct = np.array([self.direct and body.isascii() and (body.isalpha() or body.isdigit()) for body in bodies])
        ways = ((~plain & ~direct, self._one_by_one), (plain & ~direct, self._together), (direct, self._direct))
        for rows, encode in ((np.flatnonzero(chosen), encode) for chosen, encode in ways):
            for low in range(0, len(rows), 1000):
                part = rows[low : low + 1000]
                first[part], size[part] = encode([chunks[i] for i in part])
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.first, self.size = np.insert(self.first, at, first), np.insert(self.size, at, size)
        ends = self._keep(b"".join(contents)) + np.cumsum([len(content) for content in contents])
        starts = ends - [len(content) for content in contents]
        self.start, self.end = np.insert(self.start, at, starts), np.insert(self.end, at, ends)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for low, high, data, offsets in slices(texts):
            words = split_words(data, offsets, CHUNK_BYTES)
            hashes, where, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
            new = self._unknown(hashes)
            if len(self.known) and (len(self.known) + new.sum() > REMEMBERED_CHUNKS or self.held > REMEMBERED_BYTES):
                self.forget()
                new[:] = True
            if new.any():
                content, at = data.tobytes(), where[new]
                places = zip(words.start[at].tolist(), words.end[at].tolist())
                self._learn(hashes[new], [content[a:b] for a, b in places])
            at = np.searchsorted(self.known, hashes)[which]
            if not spans_equal(data, words.start, words.end, self.content, self.start[at], self.end[at]):
                yield from self._whole(texts.slice(low, high - low))
                continue
            first, size = self.first[at], self.size[at]
            before = np.concatenate([[0], np.cumsum(size)])
            ids = self.flat[np.repeat(first - before[:-1], size) + np.arange(before[-1])]
            ends = before[words.first]
            for a, b in zip(ends[:-1], ends[1:]):
                yield ids[a:b]

    def _unknown(self, hashes: np.ndarray) -> np.ndarray:
        if len(self.known) == 0:
            return np.ones(len(hashes), bool)
        return self.known[np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)] != hashes

    def _whole(self, texts: pa.Array) -> Iterator[np.ndarray]:
        for text in texts.to_pylist():
            yield np.array(self.tokenizer.encode(text or "", add_special_tokens=False).ids, np.uint32)


_encoders: dict[str, Encoder] = {}


def id_bytes(path: str, texts: pa.Array, end_id: int) -> Iterator[bytes]:
    """The id array of each text, with the end id, as bytes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    end = np.array([end_id], "<u4").tobytes()
    for ids in _encoders[path].encode(texts):
        yield ids.astype("<u4", copy=False).tobytes() + end


def train_dictionary(plain: DataFrame, path: str, end_id: int) -> bytes:
    """A dictionary from the documents whose hash is in a share of all hashes; empty if they are too few."""

    def serialize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [found[:DICTIONARY_DOC_BYTES] for found in id_bytes(path, batch.column("text"), end_id)]
            yield pa.RecordBatch.from_pydict({"ids": pa.array(ids, pa.binary())})

    share = DICTIONARY_DOCS / max(plain.count(), DICTIONARY_DOCS)
    chosen = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(share * (1 << 40))
    some = plain.where(chosen).select(F.substring("text", 1, DICTIONARY_DOC_BYTES).alias("text"))
    sample = map_arrow(some.limit(2 * DICTIONARY_DOCS), serialize, "ids binary")
    samples = [bytes(row.ids) for row in sample.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(content) if content else None


BLOCKS = (
    "shard int, block int, before bigint, ids array<{id}>, offsets array<bigint>, n_tokens array<bigint>, dictionary string, "
    "first_id {id}, last_id {id}, data binary"
)


def write_ids(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    end_id: int = END_ID,
    shards: int | None = None,
) -> None:
    """Writes the file set of `docs` as so many ranges of ids, or as many as the session has shuffle partitions."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    id_type = docs.schema[id_column].dataType.simpleString()
    content = train_dictionary(plain, tokenizer_path, end_id)
    digest = hashlib.sha256(content).hexdigest()
    shared = spark.sparkContext.broadcast(content)
    kept = spark.createDataFrame([(digest, bytearray(content))], "hash string, content binary")
    kept.write.parquet(f"{folder}/dictionary")

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = pyspark.TaskContext.get().partitionId(), 0
        frames = zstandard.ZstdCompressor(dict_data=_dictionary(shared.value), level=3)
        before, ids, offsets, counts, data = 0, [], [0], [], bytearray()

        def block() -> pa.RecordBatch:
            columns = {
                "shard": pa.array([shard], pa.int32()),
                "block": pa.array([number], pa.int32()),
                "before": pa.array([before], pa.int64()),
                "ids": pa.array([ids], pa.list_(kind)),
                "offsets": pa.array([offsets], pa.list_(pa.int64())),
                "n_tokens": pa.array([counts], pa.list_(pa.int64())),
                "dictionary": pa.array([digest], pa.string()),
                "first_id": pa.array(ids[:1], kind),
                "last_id": pa.array(ids[-1:], kind),
                "data": pa.array([bytes(data)], pa.binary()),
            }
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            kind = batch.column("id").type
            for key, array in zip(batch.column("id"), id_bytes(tokenizer_path, batch.column("text"), end_id)):
                data += frames.compress(array)
                ids.append(key.as_py())
                counts.append(len(array) // 4)
                offsets.append(len(data))
                if len(data) >= BLOCK_BYTES:
                    yield block()
                    number, before = number + 1, before + sum(counts)
                    ids, offsets, counts, data = [], [0], [], bytearray()
        if ids:
            yield block()

    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    ranges = plain.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    map_arrow(ranges, compress, BLOCKS.format(id=id_type)).write.parquet(f"{folder}/blocks")


def _with_start(blocks: DataFrame) -> DataFrame:
    """Adds `start`, the number of ids before each block in the whole set.

    Only the sums of the shards, a row for each, meet in one task and are broadcast.
    """
    size = F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, b: a + b)
    shards = blocks.groupBy("shard").agg(F.sum(size).alias("size"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("shard_start"))
    return blocks.join(F.broadcast(starts), "shard").withColumn("start", F.col("before") + F.col("shard_start"))


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks without their data."""
    return _with_start(spark.read.parquet(f"{folder}/blocks").drop("data"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the set: id, start, n_tokens and id_bytes, decoded from its frame."""
    stored = spark.read.parquet(f"{folder}/blocks")
    kept = spark.read.parquet(f"{folder}/dictionary").first()
    dictionary = spark.sparkContext.broadcast((kept.hash, bytes(kept.content)))
    id_type = stored.schema["first_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, content = dictionary.value
        frames = zstandard.ZstdDecompressor(dict_data=_dictionary(content))
        for batch in batches:
            for row in range(batch.num_rows):
                of = {name: batch.column(name)[row] for name in batch.schema.names}
                if of["dictionary"].as_py() != digest:
                    raise ValueError(f"block was written with dictionary {of['dictionary']}, not {digest}")
                view, offsets = memoryview(of["data"].as_buffer()), of["offsets"].as_py()
                counts = np.array(of["n_tokens"].as_py(), np.int64)
                start = of["start"].as_py() + np.cumsum(counts) - counts
                arrays = [frames.decompress(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                columns = {
                    "id": of["ids"].values,
                    "start": pa.array(start, pa.int64()),
                    "n_tokens": pa.array([len(a) // 4 for a in arrays], pa.int64()),
                    "id_bytes": pa.array(arrays, pa.binary()),
                }
                yield pa.RecordBatch.from_pydict(columns)

    needed = _with_start(stored).select("ids", "offsets", "n_tokens", "dictionary", "start", "data")
    return map_arrow(needed, decode, f"id {id_type}, start bigint, n_tokens bigint, id_bytes binary")


def lookup(spark: SparkSession, folder: str, wanted: int) -> DataFrame:
    """One document by its id: the index finds its block, and only its frame is decoded of that block."""
    near = index(spark, folder).where(F.lit(wanted).between(F.col("first_id"), F.col("last_id")))
    place = F.array_position("ids", F.lit(wanted)).cast("int")
    data = spark.read.parquet(f"{folder}/blocks").select("shard", "block", "data")
    at = near.where(place > 0).withColumn("place", place).join(data, ["shard", "block"])
    first, end = F.col("offsets")[F.col("place") - 1], F.col("offsets")[F.col("place")]
    kept = spark.read.parquet(f"{folder}/dictionary").first()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frames = zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(kept.content)))
        for batch in batches:
            arrays = [frames.decompress(f.as_py()) for f in batch.column("frame")]
            yield pa.RecordBatch.from_pydict({"id_bytes": pa.array(arrays, pa.binary())})

    frame = F.expr("substring(data, CAST(low + 1 AS INT), CAST(high - low AS INT))")
    found = at.select("data", first.alias("low"), end.alias("high")).select(frame.alias("frame"))
    return map_arrow(found, decode, "id_bytes binary")

"""Benchmark decontamination by Wu-Manber search for word windows of benchmark items.

Words are runs of ASCII letters, digits and all bytes outside ASCII, with A-Z lower-cased. A window is
`width` consecutive words of an item; an item of fewer words, but not none, is one window. Windows of
one length form one pattern class. Its shift table holds, for every pair of adjacent words in a
pattern, how far the scan may move when the text shows that pair at the window's end; any other pair
moves the scan by the whole window less one word. Where the shift is 0 the pair picks a bucket of
patterns and the words of the text are compared with them directly.

Defined results: null or wordless texts have no words and no hits; an empty benchmark hits nothing;
repeated documents are judged one by one; repeated item ids count once; a null item id is the empty
string; other columns of either table are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import cut, map_arrow
from tidemark.llm.words import ALPHANUMERIC, LOWER, Words, mix, slices, split_words

WIDTH = 10
#: Words of the benchmark that one broadcast holds; a larger one is searched block by block.
BLOCK_WORDS = 500_000


def item_words(texts: pa.Array) -> list[tuple[list[bytes], np.ndarray]]:
    """The words of each text, and their hashes."""
    found = []
    for _, _, data, offsets in slices(texts):
        words = split_words(LOWER[data], offsets, ALPHANUMERIC)
        hashes = words.hashes()
        for a, b in zip(words.first[:-1], words.first[1:]):
            found.append(([words.text(w) for w in range(a, b)], hashes[a:b]))
    return found


def pairs(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(3) + right)


class PatternClass:
    """All windows of `length` words: shift table over word pairs and buckets by the last pair."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.longest_shift = length - self.block + 1
        self.shifts: dict[int, int] = {}
        self.buckets: dict[int, dict[bytes, set[str]]] = {}

    def add(self, words: list[bytes], hashes: np.ndarray, item: str) -> None:
        keys = (pairs(hashes[:-1], hashes[1:]) if self.block == 2 else hashes).tolist()
        for place, key in enumerate(keys):
            shift = self.longest_shift - 1 - place
            self.shifts[key] = min(shift, self.shifts.get(key, shift))
        self.buckets.setdefault(keys[-1], {}).setdefault(b" ".join(words), set()).add(item)

    def close(self) -> None:
        self.keys = np.array(sorted(self.shifts), np.uint64)
        self.steps = np.array([self.shifts[int(key)] for key in self.keys], np.int64)

    def find(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """Row, first word and items of every occurrence; all rows are scanned in step."""
        rows = np.flatnonzero(words.counts >= self.length)
        ends = words.first[:-1][rows] + self.length - 1
        limits = words.first[1:][rows]
        while len(rows):
            keys = pairs(hashes[ends - 1], hashes[ends]) if self.block == 2 else hashes[ends]
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            steps = np.where(self.keys[at] == keys, self.steps[at], self.longest_shift)
            for i in np.flatnonzero(steps == 0):
                first = int(ends[i]) - self.length + 1
                items = self.buckets[int(keys[i])].get(words.text(first, self.length))
                if items:
                    yield int(rows[i]), first, items
            ends = ends + np.maximum(steps, 1)
            left = ends < limits
            if not left.all():
                rows, ends, limits = rows[left], ends[left], limits[left]


def pattern_classes(items: list[tuple[str, list[bytes], np.ndarray]], width: int) -> list[PatternClass]:
    classes: dict[int, PatternClass] = {}
    for item, words, hashes in items:
        length = min(width, len(words))
        for place in range(len(words) - length + 1):
            chosen = classes.setdefault(length, PatternClass(length))
            chosen.add(words[place : place + length], hashes[place : place + length], item)
    for each in classes.values():
        each.close()
    return list(classes.values())


def benchmark_blocks(benchmark: DataFrame, id_column: str, text_column: str, width: int) -> Iterator[list[PatternClass]]:
    """Pattern classes of successive items with BLOCK_WORDS words together, or of one longer item."""
    block, size = [], 0
    chosen = benchmark.select(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.col(text_column).cast("string"))
    for item, text in chosen.toLocalIterator():
        words, hashes = item_words(pa.array([text], pa.string()))[0]
        if not words:
            continue
        if block and size + len(words) > BLOCK_WORDS:
            yield pattern_classes(block, width)
            block, size = [], 0
        block.append((item, words, hashes))
        size += len(words)
    yield pattern_classes(block, width)


def find_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
) -> DataFrame:
    """Per row of `docs`: id, n_words, hit (a byte 0 or 1 per word) and items (sorted texts)."""
    spark = docs.sparkSession
    result = f"id {docs.schema[id_column].dataType.simpleString()}, n_words bigint, hit binary, items array<string>"
    found = docs.select(
        F.col(id_column).alias("id"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.lit(None).cast("binary").alias("hit"),
        F.array().cast("array<string>").alias("items"),
        F.col(text_column).cast("string").alias("text"),
    )
    blocks = benchmark_blocks(benchmark, item_column, item_text, width)
    block = next(blocks)
    while block is not None:
        patterns, following = spark.sparkContext.broadcast(block), next(blocks, None)
        last = following is None

        def search(batches: Iterator[pa.RecordBatch], patterns=patterns, last=last) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low, high, data, offsets in slices(batch.column("text")):
                    part = batch.slice(low, high - low)
                    words = split_words(LOWER[data], offsets, ALPHANUMERIC)
                    hashes = words.hashes()
                    edges = np.zeros(len(hashes) + 1, np.int32)
                    items: dict[int, set[str]] = {}
                    for each in patterns.value:
                        for row, first, names in each.find(words, hashes):
                            edges[first] += 1
                            edges[first + each.length] -= 1
                            items.setdefault(row, set()).update(names)
                    hit = (np.cumsum(edges[:-1]) > 0).astype(np.uint8)
                    before, known = part.column("hit"), part.column("items")
                    rows = range(high - low)
                    covers = [hit[words.first[r] : words.first[r + 1]] for r in rows]
                    if before.null_count < len(before):
                        covers = [c | np.frombuffer(b.as_py(), np.uint8) for c, b in zip(covers, before)]
                    names = [sorted(items.get(r, set()).union(known[r].as_py())) for r in rows]
                    columns = {
                        "id": part.column("id"),
                        "n_words": pa.array(words.counts, pa.int64()),
                        "hit": pa.array([c.tobytes() for c in covers], pa.binary()),
                        "items": pa.array(names, pa.list_(pa.string())),
                    }
                    yield pa.RecordBatch.from_pydict(columns if last else columns | {"text": part.column("text")})

        found = map_arrow(found, search, result if last else f"{result}, text string")
        if not last:
            found = cut(found)
        block = following
    return found


def hit_counts(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """What find_passages found, as counts: one row per document without its text."""
    n_hit = F.length(F.translate(F.hex("hit"), "0", "")).cast("bigint")
    return found.select(
        F.col("id").alias(id_column),
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )

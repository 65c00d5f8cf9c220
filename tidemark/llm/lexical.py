"""Ranked lexical search by dense blocked matrix products.

Terms are runs of ASCII letters, digits and all characters outside ASCII, with A-Z lower-cased. With N
the documents that have a term, L all their terms, n the terms of a document, df the documents holding a
term and tf its occurrences in a document, a term weighs w = floor(1000 * ln((2 N + 2) / (2 df + 1))), its
impact in a document is (10**9 tf) div (1000 tf + 12 m) with m = 75 + (25 n N) div L, and a document's score
for an item is the sum of weight times impact over the item's terms, repeats included.

Items are the query set, so each document meets all of them, in blocks. Items are grouped by the bytes
of their terms (GROUP_BYTES, checked); a group's distinct terms are what one broadcast holds. A first pass
over the documents counts N, L and df, pre-aggregated in each task. In the second, the items of a group
form tiles of up to TILE_ITEMS with a compact vocabulary of their own, cut into strips; a tile of documents
becomes a dense matrix of impacts over that vocabulary, and one BLAS product per strip gives the scores of
all pairs of the two tiles. All numbers are whole and every strip's sums stay below 2**53, so float64 is exact
in any order of summation; strips are added as 64-bit integers. Each task keeps the best `k` of each
item over its tiles: what equals the k-th best score so far stays a candidate, and ties go by id. Tasks put out
at most `k` rows per item, which are ranked in two steps.

Words are looked up by hash and then compared byte by byte.

Defined results: null and wordless texts are in no ranking and not in N; items without terms, or whose terms no
document holds, have no rows; items with the same id are ranked each for itself, a null id is kept; repeated
documents are ranked each for itself; a null document id comes before all others; empty tables give no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.scratch import cut, map_arrow
from tidemark.llm.words import ALPHANUMERIC, LOWER, Words, slices, span_hashes, split_words

TOP = 20
#: Term bytes of the items that one pass over the documents serves (16 are added for each term); a larger item is a
#: group of its own.
GROUP_BYTES = 8 << 20
#: Items, terms and documents of a tile.
TILE_ITEMS, STRIP_TERMS, TILE_DOCS = 32, 1024, 512
#: Impacts are below this, and whole numbers up to EXACT are exact in float64.
IMPACT, EXACT = 10**6, 1 << 53
#: Parts into which the tasks' results are first ranked.
SALTS = 64
_DOCUMENTS, _TERMS = -1, -2


def document_words(texts: pa.Array) -> Iterator[tuple[int, int, Words]]:
    for low, high, data, offsets in slices(texts):
        yield low, high, split_words(LOWER[data], offsets, ALPHANUMERIC)


def item_terms(items: DataFrame, text_column: str) -> DataFrame:
    """Rows item, term, repeats of items that have a number in column `item`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, _, words in document_words(batch.column("text")):
                rows = words.rows()
                terms = pa.array([words.text(w) for w in range(len(rows))], pa.binary())
                table = pa.table({"item": batch.column("item").take(pa.array(rows + low)), "term": terms})
                counted = table.group_by(["item", "term"]).aggregate([([], "count_all")])
                yield from counted.rename_columns(["item", "term", "repeats"]).to_batches()

    return map_arrow(
        items.select("item", F.col(text_column).cast("string").alias("text")),
        count,
        "item bigint, term binary, repeats bigint",
    )


class Vocabulary:
    """Distinct terms, found in texts by hash and then by their bytes."""

    def __init__(self, terms: list[bytes]):
        lengths = np.array([len(t) for t in terms], np.int64)
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(terms), np.uint8)
        hashes = span_hashes(data, ends - lengths, ends)
        order = np.argsort(hashes, kind="stable")
        #: Terms of equal hash stand side by side; `depth` is the longest such run.
        self.data, self.start, self.end = data, (ends - lengths)[order], ends[order]
        self.hashes, self.number = hashes[order], order
        new = np.flatnonzero(np.append(True, self.hashes[1:] != self.hashes[:-1])) if len(terms) else np.zeros(0, int)
        self.depth = int(np.diff(np.append(new, len(terms))).max(initial=0))

    def numbers(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The words that are terms, and the number of each."""
        hashes = words.hashes()
        first = np.searchsorted(self.hashes, hashes)
        found = np.full(len(hashes), -1)
        for step in range(self.depth):
            at = np.minimum(first + step, len(self.hashes) - 1)
            near = np.flatnonzero((found < 0) & (self.hashes[at] == hashes))
            near = near[self._equal(words, near, at[near])]
            found[near] = self.number[at[near]]
        known = np.flatnonzero(found >= 0)
        return known, found[known]

    def _equal(self, words: Words, w: np.ndarray, term: np.ndarray) -> np.ndarray:
        lengths = self.end[term] - self.start[term]
        same = words.end[w] - words.start[w] == lengths
        if not same.any():
            return same
        lengths, left, right = lengths[same], words.start[w][same], self.start[term][same]
        begun = np.cumsum(lengths) - lengths
        within = np.arange(lengths.sum()) - np.repeat(begun, lengths)
        differ = words.data[within + np.repeat(left, lengths)] != self.data[within + np.repeat(right, lengths)]
        same[same] = np.add.reduceat(differ, begun) == 0
        return same


def _per_document(words: Words, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and tf of every term in every text, sorted by row."""
    known, numbers = vocabulary.numbers(words)
    size = max(len(vocabulary.number), 1)
    pairs, tf = np.unique(words.rows()[known] * size + numbers, return_counts=True)
    return pairs // size, pairs % size, tf


def corpus_counts(docs: DataFrame, vocabulary, size: int) -> tuple[int, int, np.ndarray]:
    """N, L and the df of each of `size` terms in the broadcast vocabulary, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, terms = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for _, _, words in document_words(batch.column("text")):
                documents += int((words.counts > 0).sum())
                terms += len(words.start)
                df += np.bincount(_per_document(words, vocabulary.value)[1], minlength=size)
        seen = np.flatnonzero(df)
        names = np.concatenate([seen, [_DOCUMENTS, _TERMS]])
        yield pa.RecordBatch.from_pydict({"term": names, "n": np.concatenate([df[seen], [documents, terms]])})

    counted = map_arrow(docs.select("text"), count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = {row.term: row.n for row in counted.collect()}
    df = np.array([found.get(t, 0) for t in range(size)], np.int64)
    return found.get(_DOCUMENTS, 0), found.get(_TERMS, 0), df


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass
class Strip:
    """Some terms of an item tile, and the matrix of the items' weights for them."""

    terms: np.ndarray
    weights: np.ndarray


@dataclass
class Tile:
    items: np.ndarray
    strips: list[Strip]


def strips(entries: list[tuple[int, int, int]], items: int) -> list[Strip]:
    """Strips of the (place of item, term, weight) of a tile.

    In a strip the weights of one item add up to less than EXACT / IMPACT. A larger weight is dealt to several
    strips, as the product is linear in it.
    """
    limit = EXACT // IMPACT - 1
    found: list[dict[tuple[int, int], int]] = []
    used: list[np.ndarray] = []
    columns: list[dict[int, int]] = []
    low = 0
    for item, term, value in sorted(entries, key=lambda e: e[1]):
        # Strips that are full of earlier terms take no more, but for the term that filled the last of them.
        while low < len(columns) and len(columns[low]) == STRIP_TERMS and term not in columns[low]:
            low += 1
        place = low
        while value > 0:
            if place == len(found):
                found.append({})
                used.append(np.zeros(items, np.int64))
                columns.append({})
            room = limit - int(used[place][item])
            if room > 0 and (term in columns[place] or len(columns[place]) < STRIP_TERMS):
                part = min(value, room)
                columns[place].setdefault(term, len(columns[place]))
                found[place][item, term] = part
                used[place][item] += part
                value -= part
            place += 1
    result = []
    for cells, order in zip(found, columns):
        matrix = np.zeros((len(order), items))
        for (item, term), part in cells.items():
            matrix[order[term], item] = part
        result.append(Strip(np.array(list(order), np.int64), matrix))
    return result


def tiles(rows: list, weights: np.ndarray, numbers: dict[bytes, int]) -> list[Tile]:
    """Items, in the order of their numbers, as tiles."""
    items = sorted({row.item for row in rows})
    place = {item: i for i, item in enumerate(items)}
    parts: list[list[tuple[int, int, int]]] = [[] for _ in range(-(-len(items) // TILE_ITEMS))]
    for row in rows:
        term = numbers[bytes(row.term)]
        tile, within = divmod(place[row.item], TILE_ITEMS)
        parts[tile].append((within, term, int(weights[term]) * row.repeats))
    result = []
    for i, part in enumerate(parts):
        names = np.array(items[i * TILE_ITEMS : (i + 1) * TILE_ITEMS], np.int64)
        result.append(Tile(names, strips(part, len(names))))
    return result


class Best:
    """The best `k` documents of each item so far."""

    def __init__(self, items: np.ndarray, k: int):
        self.items, self.k = items, k
        self.least = np.ones(len(items), np.int64)
        empty = np.zeros(0, np.int64)
        #: Place of the item, score, whether the id is not null, id.
        self.rows = (empty, empty, empty, empty)

    def add(self, scores: np.ndarray, has: np.ndarray, ids: np.ndarray) -> None:
        """A tile of scores, documents by items."""
        least = self.least
        if len(scores) > self.k:
            kth = len(scores) - self.k
            least = np.maximum(least, np.partition(scores, kth, axis=0)[kth])
        doc, item = np.nonzero(scores >= least)
        if len(doc) == 0:
            return
        new = (item, scores[doc, item], has[doc], ids[doc])
        item, score, has, ids = (np.concatenate(both) for both in zip(self.rows, new))
        order = np.lexsort((ids, has, -score, item))
        begun = np.searchsorted(item[order], np.arange(len(self.items)))
        rank = np.arange(len(order)) - begun[item[order]]
        order, last = order[rank < self.k], order[rank == self.k - 1]
        self.rows = item[order], score[order], has[order], ids[order]
        self.least[item[last]] = score[last]


def impacts(counts: np.ndarray, row: np.ndarray, tf: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Whole impacts; `counts` are the terms of each text."""
    m = np.array([75 + 25 * n * documents // max(terms, 1) for n in counts.tolist()], np.int64)
    return 10**9 * tf.astype(np.int64) // (1000 * tf + 12 * m[row])


def best_of_group(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """Rows item, doc, score: of each item the best `k` documents of each task. `rows` are a group's item terms."""
    spark = docs.sparkSession
    names = sorted({bytes(row.term) for row in rows})
    size = len(names)
    vocabulary = spark.sparkContext.broadcast(Vocabulary(names))
    documents, terms, df = corpus_counts(docs, vocabulary, size)
    weights = np.array([weight(documents, n) if n else 0 for n in df.tolist()], np.int64)
    shared = spark.sparkContext.broadcast(tiles(rows, weights, {name: i for i, name in enumerate(names)}))

    def scores(tile: Tile, column: np.ndarray, row: np.ndarray, term: np.ndarray, impact: np.ndarray, count: int) -> np.ndarray:
        total = np.zeros((count, len(tile.items)), np.int64)
        for strip in tile.strips:
            column[strip.terms] = np.arange(len(strip.terms))
            place = column[term]
            here = place >= 0
            matrix = np.zeros((count, len(strip.terms)))
            matrix[row[here], place[here]] = impact[here]
            total += (matrix @ strip.weights).astype(np.int64)
            column[strip.terms] = -1
        return total

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(tile.items, k) for tile in shared.value]
        column = np.full(size, -1)
        for batch in batches:
            ids = batch.column("id").cast(pa.int64())
            has = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = ids.fill_null(0).to_numpy()
            for low, high, words in document_words(batch.column("text")):
                row, term, tf = _per_document(words, vocabulary.value)
                impact = impacts(words.counts, row, tf, documents, terms)
                for first in range(0, high - low, TILE_DOCS):
                    last = min(first + TILE_DOCS, high - low)
                    a, b = np.searchsorted(row, [first, last])
                    at = slice(low + first, low + last)
                    for tile, found in zip(shared.value, best):
                        found.add(scores(tile, column, row[a:b] - first, term[a:b], impact[a:b], last - first), has[at], ids[at])
        task = pyspark.TaskContext.get().partitionId() % SALTS
        for found in best:
            item, score, has, ids = found.rows
            yield pa.RecordBatch.from_pydict(
                {
                    "item": found.items[item],
                    "doc": pa.array(ids, pa.int64(), mask=has == 0),
                    "score": score,
                    "salt": np.full(len(item), task, np.int32),
                }
            )

    return map_arrow(docs.select("id", "text"), search, "item bigint, doc bigint, score bigint, salt int")


def _group(groups: int) -> Column:
    return F.pmod(F.xxhash64("item"), F.lit(groups))


def group_count(terms: DataFrame) -> int:
    """So many groups that each holds GROUP_BYTES at most, or one item."""
    sizes = terms.groupBy("item").agg(F.sum(F.length("term") + 16).alias("size"))
    groups = -(-(sizes.agg(F.sum("size")).first()[0] or 0) // GROUP_BYTES)
    while groups:
        held = sizes.groupBy(_group(groups)).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("items"))
        if held.where((F.col("size") > GROUP_BYTES) & (F.col("items") > 1)).isEmpty():
            break
        groups *= 2
    return groups


def _first(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_first("doc"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Rows item_column, rank, id_column, score: of each item the `k` best documents with a score above 0."""
    wanted = items.select(F.col(item_column).alias("name"), F.col(item_text).cast("string").alias("text"))
    # Numbers are given once and kept, so that all passes name items alike.
    wanted = cut(wanted.withColumn("item", F.monotonically_increasing_id()))
    terms = cut(item_terms(wanted, "text"))
    groups = group_count(terms)
    plain = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    found = docs.sparkSession.createDataFrame([], "item bigint, doc bigint, score bigint, salt int")
    for group in range(groups):
        rows = terms.where(_group(groups) == group).collect()
        if rows:
            found = found.unionByName(_first(best_of_group(plain, rows, k), k, "item", "salt").drop("rank"))
    ranked = _first(found, k, "item").withColumn("rank", F.col("rank").cast("int"))
    named = ranked.join(wanted.select("item", "name"), "item")
    return named.select(F.col("name").alias(item_column), "rank", F.col("doc").alias(id_column), "score")

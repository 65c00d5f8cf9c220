"""Merkle manifest of a table: a tree per group of rows, a tree over the groups' roots, and proofs.

H is the lower-case hex SHA-256 of concatenated texts. Leaves of a group stand in a fixed order; while there are
several nodes, each two successive ones become their H, and a last one alone becomes the H of itself. What
remains is the group's subroot; the subroots, in order of the group, give the root in the same way.

A tree is stored as blocks: aligned subtrees of `block_height` levels above their leaves. The roots of the blocks are
the leaves of the next round's blocks, and so on up to a single block, so that a tree over 2**36 rows has
three rounds. A block keeps its nodes in van Emde Boas order: its upper half of levels first, then the lower
subtrees from left to right, each again split at half of its height. The address of a node follows from its
depth and number by the same recursion (`addresses`), which serves writing as well as looking up siblings.

Leaves get their places by a range shuffle of digests and ids (no texts): each range numbers its rows, and only
the counts of ranges and groups are summed up by a window. So a group with a third of all rows is spread over
ranges and blocks like any other. Proofs go down: a block's siblings above it come from its parent block.

Defined results: a null group is a group of its own, before all others; leaves ascend by id, a null id first, then by
digest; repeated rows are leaves each; an empty table has no rows and no root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.scratch import Stored, map_arrow, ship, stored

#: Levels of a block above its leaves, where nothing else is said.
HEIGHT = 12
#: A step of a path: whether the sibling is missing, right or left of the node, and its digest.
ALONE, RIGHT, LEFT = 0, 1, 2
STEP = 33
#: Blocks whose paths (under 3 KB each) a join broadcasts.
BROADCAST_BLOCKS = 10_000
_BLOCKS = "tree string, block bigint, total bigint, height int, root binary, nodes binary"


def h(*texts: bytes) -> bytes:
    return hashlib.sha256(b"".join(texts)).hexdigest().encode()


def field(value: Column) -> Column:
    """A value as a part of a leaf: `-` for null, else its bytes after their number."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*(field(value) for value in values)), 256))


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


@lru_cache(maxsize=64)
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """By depth, the place of each node of a full binary tree in van Emde Boas order."""
    if levels == 1:
        return (np.zeros(1, np.int64),)
    upper = levels // 2
    lower = levels - upper
    starts = (1 << upper) - 1 + np.arange(1 << upper) * ((1 << lower) - 1)
    return addresses(upper) + tuple((starts[:, None] + each).ravel() for each in addresses(lower))


def block_nodes(digests: list[bytes], height: int) -> np.ndarray:
    """All nodes above some leaves, in van Emde Boas order; missing ones are zero."""
    places = addresses(height + 1)
    nodes = np.zeros(((2 << height) - 1, 32), np.uint8)
    level = [digest.hex().encode() for digest in digests]
    for depth in range(height, -1, -1):
        content = np.frombuffer(bytes.fromhex(b"".join(level).decode()), np.uint8)
        nodes[places[depth][: len(level)]] = content.reshape(-1, 32)
        level = [h(*level[i : i + 2]) for i in range(0, len(level), 2)]
    return nodes


def sibling_steps(nodes: np.ndarray, count: int, height: int) -> np.ndarray:
    """The steps from each of `count` leaves up to the root of their block."""
    places = addresses(height + 1)
    steps = np.zeros((count, height, STEP), np.uint8)
    for level in range(height):
        size = (count - 1 >> level) + 1
        node = np.arange(count) >> level
        there = np.flatnonzero(node ^ 1 < size)
        steps[there, level, 0] = np.where(node[there] & 1, LEFT, RIGHT)
        steps[there, level, 1:] = nodes[places[height - level][node[there] ^ 1]]
    return steps


def fold(digest: bytes, path: bytes) -> bytes:
    """The root that a leaf's digest leads to."""
    node = digest.hex().encode()
    for at in range(0, len(path), STEP):
        sibling, side = path[at + 1 : at + STEP].hex().encode(), path[at]
        node = h(node) if side == ALONE else (h(node, sibling) if side == RIGHT else h(sibling, node))
    return bytes.fromhex(node.decode())


def path_digest(path: bytes) -> bytes:
    """The digest of all siblings of a path."""
    steps = np.frombuffer(path, np.uint8).reshape(-1, STEP)
    return hashlib.sha256(steps[steps[:, 0] != ALONE, 1:].tobytes().hex().encode()).digest()


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, Stored]:
    """Adds `place` and `total`: the number of each row in its `tree`, in the given order, and the tree's rows.

    The stored table is what the result is read from.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = rows.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, done = pyspark.TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            within = np.empty(batch.num_rows, np.int64)
            for name, low, high in _runs(batch.column("tree")):
                done = done if name == tree else 0
                within[low:high] = np.arange(done, done + high - low)
                tree, done = name, done + high - low
            extra = {"shard": np.full(batch.num_rows, shard, np.int32), "within": within}
            yield pa.RecordBatch.from_pydict({**{c: batch.column(c) for c in columns}, **extra})

    schema = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes) + ", shard int, within bigint"
    ordered = rows.repartitionByRange(ranges, "tree", *order).sortWithinPartitions("tree", *order)
    kept = stored(map_arrow(ordered, count, schema))
    sizes = kept.frame.groupBy("tree", "shard").agg(F.count(F.lit(1)).alias("size"))
    earlier = Window.partitionBy("tree").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "tree",
        "shard",
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"),
        F.sum("size").over(Window.partitionBy("tree")).alias("total"),
    )
    placed = kept.frame.join(sizes, ["tree", "shard"]).withColumn("place", F.col("before") + F.col("within"))
    return placed.select("tree", "place", "total", *(c for c in columns if c != "tree")), kept


def _runs(trees: pa.Array) -> list[tuple[str, int, int]]:
    """Successive equal names: name, first row, row after the last."""
    names = trees.to_pylist()
    cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
    return [(names[a], a, b) for a, b in zip(cuts[:-1], cuts[1:])]


def _fields(frame: DataFrame, names: list[str], between: str) -> str:
    types = dict(frame.dtypes)
    return ", ".join(f"`{name}`{between}{types[name]}" for name in names)


@dataclass
class Forest:
    """Trees stored as rounds of blocks; `carried` columns stand beside the leaves."""

    spark: SparkSession
    folder: str
    rounds: int
    block_height: int
    carried: list[str]
    carried_types: str
    schema: str

    def blocks(self, round: int) -> DataFrame:
        schema = self.schema if round == 0 else _BLOCKS
        return self.spark.read.schema(schema).parquet(f"{self.folder}/round={round}")

    def roots(self) -> DataFrame:
        """Rows tree, root."""
        return self.blocks(self.rounds - 1).select("tree", "root")

    def _with(self, round: int, paths: DataFrame) -> DataFrame:
        """Blocks with their paths, which are broadcast if there are few blocks."""
        blocks = self.blocks(round)
        few = blocks.count() <= BROADCAST_BLOCKS
        return blocks.drop("root").join(F.broadcast(paths) if few else paths, ["tree", "block"])

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """Per leaf: tree, tree_root, leaf, path and the carried columns; paths go on with `path` of `above`, by tree."""
        paths = self.blocks(self.rounds - 1).select("tree", "block", F.col("root").alias("tree_root"))
        if above is None:
            paths = paths.withColumn("path", F.lit(b""))
        else:
            paths = paths.join(above.select("tree", "path"), "tree")
        for round in range(self.rounds - 1, 0, -1):
            schema = "tree string, tree_root binary, block bigint, path binary"
            paths = map_arrow(self._with(round, paths), _descend(self.block_height), schema)
        schema = f"tree string, tree_root binary, leaf binary, path binary{', ' * bool(self.carried)}{self.carried_types}"
        return map_arrow(self._with(0, paths), _expand(self.block_height, self.carried), schema)


def _expanded(batch: pa.RecordBatch, row: int, block_height: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Nodes of a block, places of its leaves, and their paths."""
    of = {name: batch.column(name)[row].as_py() for name in ("total", "block", "height", "path")}
    nodes = np.frombuffer(batch.column("nodes")[row].as_buffer(), np.uint8).reshape(-1, 32)
    # Only the last block of a tree has fewer leaves than fit in.
    count = min(of["total"] - (of["block"] << block_height), 1 << of["height"])
    steps = sibling_steps(nodes, count, of["height"]).reshape(count, -1)
    return nodes, addresses(of["height"] + 1)[of["height"]][:count], [step.tobytes() + of["path"] for step in steps]


def _names(batch: pa.RecordBatch, row: int, times: int) -> dict[str, pa.Array]:
    """The tree of a block and its root, repeated."""
    return {
        "tree": pa.array([batch.column("tree")[row].as_py()] * times, pa.string()),
        "tree_root": pa.array([batch.column("tree_root")[row].as_py()] * times, pa.binary()),
    }


def _descend(block_height: int):
    """From blocks of a round with their paths to the paths of the blocks below."""

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                paths = _expanded(batch, row, block_height)[2]
                first = batch.column("block")[row].as_py() << block_height
                columns = {"block": np.arange(first, first + len(paths)), "path": pa.array(paths, pa.binary())}
                yield pa.RecordBatch.from_pydict(_names(batch, row, len(paths)) | columns)

    return descend


def _expand(block_height: int, carried: list[str]):
    """From the lowest blocks with their paths to their leaves."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                nodes, at, paths = _expanded(batch, row, block_height)
                columns = _names(batch, row, len(paths)) | {
                    "leaf": pa.array([node.tobytes() for node in nodes[at]], pa.binary()),
                    "path": pa.array(paths, pa.binary()),
                }
                if carried:
                    rows = batch.column("rows")[row].values
                    columns |= {name: rows.field(name) for name in carried}
                yield pa.RecordBatch.from_pydict(columns)

    return expand


def grow(leaves: DataFrame, folder: str, block_height: int = HEIGHT) -> Forest:
    """Writes the rounds of blocks over rows tree, place, total, digest; all other columns are carried."""
    spark = leaves.sparkSession
    ship(spark)
    carried = [name for name in leaves.columns if name not in ("tree", "place", "total", "digest")]
    types = _fields(leaves, carried, " ")
    schema = f"{_BLOCKS}, rows array<struct<{_fields(leaves, carried, ': ')}>>" if carried else _BLOCKS

    def build(carried: list[str]):
        def block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            table = table.sort_by("place")
            total, number = table.column("total")[0].as_py(), key[1].as_py()
            height = block_height if total > 1 << block_height else (total - 1).bit_length()
            nodes = block_nodes(table.column("digest").to_pylist(), height)
            columns = {
                "tree": pa.array([key[0].as_py()], pa.string()),
                "block": pa.array([number], pa.int64()),
                "total": pa.array([total], pa.int64()),
                "height": pa.array([height], pa.int32()),
                "root": pa.array([nodes[0].tobytes()], pa.binary()),
                "nodes": pa.array([nodes.tobytes()], pa.binary()),
            }
            if carried:
                parts = [table.column(name).combine_chunks() for name in carried]
                rows = pa.StructArray.from_arrays(parts, carried)
                columns["rows"] = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.table(columns)

        return block

    most = leaves.agg(F.max("total")).first()[0] or 0
    rounds = 0
    while rounds == 0 or most > 1:
        grouped = leaves.withColumn("block", F.shiftright("place", block_height)).groupBy("tree", "block")
        made = grouped.applyInArrow(build(carried if rounds == 0 else []), schema if rounds == 0 else _BLOCKS)
        made.write.parquet(f"{folder}/round={rounds}")
        size = 1 << block_height
        above = F.floor((F.col("total") + (size - 1)) / size).cast("bigint")
        read = spark.read.schema(_BLOCKS).parquet(f"{folder}/round={rounds}")
        leaves = read.select("tree", F.col("block").alias("place"), above.alias("total"), F.col("root").alias("digest"))
        most = -(-most // size)
        rounds += 1
    return Forest(spark, folder, rounds, block_height, carried, types, schema)


@dataclass
class Manifest:
    """The trees of all groups, and the tree over their roots."""

    groups: Forest
    top: Forest

    def root(self) -> bytes | None:
        """The root of the whole table."""
        found = self.top.roots().first()
        return bytes(found.root) if found else None

    def proofs(self) -> DataFrame:
        """Per row: leaf, subroot, root, path from leaf to root, and the id and carried columns."""
        above = self.top.proofs().select(F.col("group").alias("tree"), "path")
        found = self.groups.proofs(above).withColumnRenamed("tree_root", "subroot").drop("tree")
        return found.withColumn("root", F.lit(self.root()).cast("binary"))


def write_manifest(
    rows: DataFrame,
    folder: str,
    digest: Column,
    group: str = "lang",
    id_column: str = "doc_id",
    block_height: int = HEIGHT,
    **carried: Column,
) -> Manifest:
    """Writes the manifest of `rows` by the given digests; the id, and the columns in `carried`, stand beside leaves."""
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    kept = {"digest": digest, "id": F.col(id_column), **carried, "number": F.monotonically_increasing_id()}
    leaves = stored(rows.select(key.alias("tree"), *(value.alias(name) for name, value in kept.items())))
    placed, sorted_leaves = numbered(leaves.frame, ["id", "digest", "number"])
    groups = grow(placed.drop("number"), f"{folder}/groups", block_height)
    leaves.remove()
    sorted_leaves.remove()
    roots = groups.roots().select(F.lit("").alias("tree"), F.col("tree").alias("group"), F.col("root").alias("digest"))
    placed, sorted_roots = numbered(roots, ["group"])
    top = grow(placed, f"{folder}/top", block_height)
    sorted_roots.remove()
    return Manifest(groups, top)


def folded(proofs: DataFrame, claim: str, path: str = "path") -> DataFrame:
    """Adds `folded_root`, the root that the digest in column `claim` leads to, and `path_digest`."""
    columns = proofs.columns

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, paths = batch.column(claim).to_pylist(), batch.column(path).to_pylist()
            roots = [None if d is None else fold(d, p) for d, p in zip(digests, paths)]
            extra = {"folded_root": roots, "path_digest": [path_digest(p) for p in paths]}
            yield pa.RecordBatch.from_pydict(
                {**{c: batch.column(c) for c in columns}, **{c: pa.array(v, pa.binary()) for c, v in extra.items()}}
            )

    schema = ", ".join(f"`{name}` {kind}" for name, kind in proofs.dtypes)
    return map_arrow(proofs, climb, f"{schema}, folded_root binary, path_digest binary")

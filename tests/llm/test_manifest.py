"""The Merkle manifest against a plain version, in one round and in many."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, queries

from . import brute
from .conftest import SF_DIR

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def table(odd):
    """Odd documents in four groups, one of them null, one of a single row, with nulls in every column."""
    key = F.coalesce("doc_id", F.lit(0))
    lang = F.when(key == 5, "ü").when(key % 3 == 0, "en").when(key % 3 == 1, "").otherwise(F.lit(None))
    source = F.when(key % 2 == 0, "web")
    rows = odd.withColumns({"lang": lang, "source": source, "n_chars": F.when(key % 4 != 1, F.length("text"))})
    return rows.withColumns({name: F.lit(name) for name in ("tree", "place", "total", "digest", "number", "path", "rows")})


def checked(manifest):
    found = merkle.folded(manifest.proofs().withColumn("claim", F.coalesce("claim", "leaf")), "claim")
    digests = [merkle.hex_text(F.col(c)).alias(c) for c in ("leaf", "subroot", "root", "path_digest", "folded_root")]
    rows = found.select("id", *digests, (F.col("folded_root") == F.col("root")).alias("verified")).collect()
    return Counter(map(tuple, rows))


@pytest.mark.parametrize("block_height", [1, 2, merkle.HEIGHT])
def test_manifest_of_odd_documents(spark, odd, tmp_path, block_height):
    rows = table(odd)
    columns = [F.col(name) for name in FIELDS]
    claim = F.when(F.expr(queries.TAMPERED), merkle.leaf(*columns[:3], F.col("n_chars") + 1, F.col("text")))
    manifest = merkle.write_manifest(
        rows, str(tmp_path / "manifest"), merkle.leaf(*columns), block_height=block_height, claim=claim
    )
    assert (manifest.groups.rounds > 2) == (block_height == 1)
    plain = [tuple(row) for row in rows.select(*FIELDS).collect()]
    expected = brute.manifest(plain)
    assert checked(manifest) == Counter(expected)
    assert not all(row[-1] for row in expected) and any(row[-1] for row in expected)


def test_manifest_query(spark, documents):
    expected = brute.manifest([tuple(row) for row in documents.select(*FIELDS).collect()])
    found = queries.op12_merkle_manifest(spark, SF_DIR).select(*COLUMNS).collect()
    assert Counter(map(tuple, found)) == Counter(expected)


def test_few_and_many_blocks(spark, documents, tmp_path, monkeypatch):
    """Paths that are broadcast, and paths that are shuffled."""
    found = []
    leaf = merkle.leaf(*(F.col(name) for name in FIELDS))
    manifest = merkle.write_manifest(documents, str(tmp_path / "manifest"), leaf, block_height=3)
    for few in (merkle.BROADCAST_BLOCKS, 0):
        monkeypatch.setattr(merkle, "BROADCAST_BLOCKS", few)
        found.append(Counter((r.id, bytes(r.leaf), bytes(r.path)) for r in manifest.proofs().collect()))
    assert found[0] == found[1] and sum(found[0].values()) == documents.count()
    assert all(merkle.fold(leaf, path) == manifest.root() for _, leaf, path in found[0])


@pytest.mark.parametrize("levels", range(1, 14))
def test_addresses(levels):
    """Every node has a place of its own; aligned subtrees below the upper half lie together."""
    places = merkle.addresses(levels)
    assert [len(p) for p in places] == [1 << d for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range((1 << levels) - 1))
    upper = levels // 2
    for number in range(1 << upper if upper else 0):
        below = np.concatenate([places[d].reshape(1 << upper, -1)[number] for d in range(upper, levels)])
        assert below.max() - below.min() == len(below) - 1


def test_empty_manifest(spark, no_documents, tmp_path):
    leaf = merkle.leaf(*(F.col(name) for name in FIELDS))
    manifest = merkle.write_manifest(no_documents, str(tmp_path / "manifest"), leaf)
    assert manifest.root() is None and manifest.proofs().isEmpty()

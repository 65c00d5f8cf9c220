"""Lexical search against brute force, with tiles of every size."""

from collections import Counter

import numpy as np
import pytest

from tidemark.llm import lexical, queries
from tidemark.llm.words import ALPHANUMERIC, split_words

from . import brute
from .conftest import SF_DIR

ITEMS = [
    (1, brute.PASSAGE), (2, "owls owls OWLS dawn"), (2, "owls owls OWLS dawn"), (3, None), (4, ""), (5, "nowhere to be found"),
    (None, "alpha3 beta"), (6, "é 漢字 a b c one"), (7, brute.LONG[:4000]), (8, brute.MORSE), (9, "single " * 40),
]


def rows(frame):
    return Counter((row.item_id, row["rank"], row.doc_id, row.score) for row in frame.collect())


def pairs(frame, *columns):
    return [tuple(row) for row in frame.select(*columns).collect()]


@pytest.mark.parametrize(
    "sizes",
    [{}, {"TILE_ITEMS": 2, "STRIP_TERMS": 3, "TILE_DOCS": 4, "GROUP_BYTES": 300}, {"EXACT": 10**6 * 4000, "STRIP_TERMS": 5}],
)
@pytest.mark.parametrize("k", [1, 3, 20])
def test_search_on_odd_documents(spark, odd, monkeypatch, sizes, k):
    for name, value in sizes.items():
        monkeypatch.setattr(lexical, name, value)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = rows(lexical.search(odd, items, k))
    assert found == Counter(brute.search(pairs(odd, "doc_id", "text"), ITEMS, k))


def test_search_query(spark, documents):
    items = pairs(spark.read.parquet(f"{SF_DIR}/benchmark.parquet"), "item_id", "text")
    expected = brute.search(pairs(documents, "doc_id", "text"), items)
    assert rows(queries.op13_lexical_search(spark, SF_DIR)) == Counter(expected)


def test_strips_stay_exact(monkeypatch):
    """Weights of an item in a strip are bounded, and strips add up to all weights."""
    monkeypatch.setattr(lexical, "STRIP_TERMS", 4)
    generator = np.random.default_rng(2)
    entries = [(int(i), int(t), int(w)) for i, t, w in zip(generator.integers(0, 5, 80), generator.integers(0, 30, 80), generator.integers(0, 3 * 10**9, 80))]
    entries = [(i, t, w) for (i, t), w in {(i, t): w for i, t, w in entries}.items()]
    entries.append((4, 31, 10**11))
    total = Counter()
    for strip in lexical.strips(entries, 5):
        assert len(strip.terms) <= 4 and len(set(strip.terms)) == len(strip.terms)
        assert (strip.weights.sum(axis=0) * lexical.IMPACT < lexical.EXACT).all()
        for column, term in enumerate(strip.terms):
            for item in range(5):
                total[item, int(term)] += int(strip.weights[column, item])
    assert +total == Counter({(i, t): w for i, t, w in entries if w})


def test_terms_of_equal_hash(monkeypatch):
    """Words are told apart by their bytes."""
    monkeypatch.setattr(lexical, "span_hashes", lambda data, start, end: (end - start).astype(np.uint64))
    vocabulary = lexical.Vocabulary([b"aa", b"bb", b"ccc", b"cc"])
    data = np.frombuffer(b"bb xx cc ccc aa ddd b", np.uint8)
    words = split_words(data, np.array([0, len(data)]), ALPHANUMERIC)
    monkeypatch.setattr(type(words), "hashes", lambda self: (self.end - self.start).astype(np.uint64))
    known, numbers = vocabulary.numbers(words)
    assert list(zip(known.tolist(), numbers.tolist())) == [(0, 1), (2, 3), (3, 2), (4, 0)]


def test_ties_at_the_last_rank():
    """Documents that equal the last one kept push it out by their id, whenever they come."""
    best = lexical.Best(np.array([7]), 2)
    for ids in ([9, 8], [5, 6], [7], [1]):
        best.add(np.full((len(ids), 1), 3), np.ones(len(ids), np.int64), np.array(ids))
    assert best.rows[3].tolist() == [1, 5]


def test_empty_tables(spark, no_documents):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical.search(no_documents, items).isEmpty()
    assert lexical.search(items.selectExpr("item_id AS doc_id", "text"), items.limit(0)).isEmpty()


def test_groups_of_items(spark, monkeypatch):
    """Each group is within its bound, or one item."""
    items = spark.createDataFrame([(i, f"t{i} x{i} " * 3) for i in range(40)], "item bigint, text string")
    terms = lexical.item_terms(items, "text")
    monkeypatch.setattr(lexical, "GROUP_BYTES", 120)
    groups = lexical.group_count(terms)
    held = terms.groupBy(lexical._group(groups).alias("g")).agg({"item": "count"}).collect()
    assert all(row[1] <= 6 for row in held)

"""Operators with a fixed contract against brute force, on odd documents and on a whole small table."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from . import brute
from .conftest import SF_DIR
from tidemark.llm import decontaminate, jaccard, licence_texts, licences, quality, queries, repeats
from tidemark.llm.words import NOT_WHITE, slices, split_words


def pairs(frame):
    return [(row.doc_id, row.text) for row in frame.select("doc_id", "text").collect()]


def rows(frame, *columns):
    return Counter(tuple(row) for row in frame.select("doc_id", *columns).collect())


def expected(documents, values):
    return Counter((key, *value) for (key, _), value in zip(documents, values))


def test_words_of_slices_and_bytes():
    import pyarrow as pa

    column = pa.array([None, "", " a  bb\tc\n", "é x", "zz"])[1:]
    for _, _, data, offsets in slices(column):
        words = split_words(data, offsets, NOT_WHITE)
        assert words.counts.tolist() == [0, 3, 2, 1]
        assert [words.text(w) for w in range(6)] == [b"a", b"bb", b"c", "é".encode(), b"x", b"zz"]


GROUPS = ("n_shingles", "component_id")


def test_jaccard_on_odd_documents(odd):
    documents = pairs(odd)
    assert rows(jaccard.components(odd), *GROUPS) == expected(documents, brute.groups(documents))


def test_jaccard_query(spark, documents):
    found = rows(queries.op1_ngram_jaccard(spark, SF_DIR), *GROUPS)
    assert found == expected(pairs(documents), brute.groups(pairs(documents)))


def edited_copies():
    """Copies with ever more words changed, so that groups are chains around the threshold."""
    base = [f"word{i}" for i in range(120)]
    texts = []
    for i in range(60):
        words = list(base)
        for j in range(i % 12):
            words[(7 * i + 11 * j) % 120] = f"new{i}n{j}"
        texts.append((1000 + i, " ".join(words)))
    return texts + [(2000 + i, " ".join(base[i : i + 30])) for i in range(60)]


@pytest.mark.parametrize("small", [1, 3, 8])
def test_jaccard_large_clusters(spark, monkeypatch, small):
    """The way of large clusters: centres, then blocks of what is still apart."""
    documents = edited_copies()
    for name, value in (("CLUSTER", 3), ("BLOCK", 4), ("SALTED", 5), ("BROADCAST_ROWS", 0), ("SMALL", small)):
        monkeypatch.setattr(jaccard, name, value)
    frame = spark.createDataFrame(documents, "doc_id bigint, text string").repartition(6)
    assert rows(jaccard.components(frame), *GROUPS) == expected(documents, brute.groups(documents))


@pytest.mark.parametrize("boundary", [0, 5, 30, 64])
def test_prefix_keys_meet(boundary):
    """Every linked pair shares a key, whatever the boundary and the order."""
    import numpy as np

    documents = edited_copies()[::3]
    sets = [np.unique(np.array([hash(s) & (1 << 63) - 1 for s in brute.shingles(t)], np.uint64)) for _, t in documents]
    values, counts = np.unique(np.concatenate(sets), return_counts=True)
    order = jaccard.Order(values[counts > 5], counts[counts > 5])
    order.boundary = boundary
    keys = [set(order.keys(s)[0].tolist()) for s in sets]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            shared = len(np.intersect1d(a, b))
            if 100 * shared >= 75 * (len(a) + len(b) - shared):
                assert keys[i] & keys[j]


def test_links_of_documents(spark, odd, documents):
    for frame in (odd, documents):
        expected_links = [(n,) for n in brute.links(pairs(frame))]
        assert rows(jaccard.components(frame), "n_links") == expected(pairs(frame), expected_links)


@pytest.mark.parametrize("block", [7, 1000])
def test_links_of_large_clusters(spark, monkeypatch, block):
    """Counted over blocks, each pair once, repeated rows included."""
    documents = edited_copies()
    documents += documents[:5] + [(3000, documents[7][1])]
    for name, value in (("CLUSTER", 3), ("BLOCK", 4), ("SALTED", 5), ("LINK_BLOCK", block)):
        monkeypatch.setattr(jaccard, name, value)
    frame = spark.createDataFrame(documents, "doc_id bigint, text string").repartition(6)
    expected_links = [(n,) for n in brute.links(documents)]
    assert rows(jaccard.components(frame), "n_links") == expected(documents, expected_links)


def test_long_lists_in_parts(monkeypatch):
    """A list that comes in parts gives the same classes in one piece."""
    import numpy as np

    monkeypatch.setattr(jaccard, "LIST_ROWS", 4)
    n = np.array([10, 11, 12, 13, 14, 15, 40, 41, 42], np.int32)
    columns = {"key": np.full(9, 7), "class": np.arange(9), "n": n, "place": np.zeros(9, np.int32), "rare": n[::-1]}
    whole = jaccard.ListCutter().cut(columns, False)
    cutter, pieces = jaccard.ListCutter(), {}
    for low, high in ((0, 3), (3, 6), (6, 9)):
        part = cutter.cut({c: v[low:high] for c, v in columns.items()}, high < 9)
        for piece, name in zip(part["piece"], part["class"]):
            pieces.setdefault(piece, set()).add(int(name))
    parts = {}
    for piece, name in zip(whole["piece"], whole["class"]):
        parts.setdefault(piece, set()).add(int(name))
    assert sorted(map(sorted, parts.values())) == [[0, 1, 2, 3, 4, 5], [6, 7, 8]]
    assert all(any(p <= q for q in pieces.values()) for p in parts.values())


REPEATS = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_repeats_on_odd_documents(odd):
    documents = pairs(odd)
    assert rows(repeats.remove_repeats(odd), *REPEATS) == expected(documents, brute.repeats(documents))


@pytest.mark.parametrize("group", [100_000, 0])
def test_repeats_query(spark, documents, monkeypatch, group):
    """With names merged in one task, and string by string."""
    monkeypatch.setattr(repeats, "GROUP", group)
    found = rows(queries.op6_repeated_bytes(spark, SF_DIR), *REPEATS)
    assert found == expected(pairs(documents), brute.repeats(pairs(documents)))


def test_repeats_keeps_bytes(spark):
    text = "".join(chr(97 + i * 7 % 26) + chr(97 + i % 25) for i in range(60))
    frame = spark.createDataFrame([(1, text), (2, "<<" + text[10:80] + ">>")], "doc_id bigint, text string")
    kept = {row.doc_id: (bytes(row.kept), row.spans) for row in repeats.remove_repeats(frame, with_bytes=True).collect()}
    assert kept[1] == (text.encode(), None)
    assert kept[2][0] == b"<<>>" and [(s.low, s.high) for s in kept[2][1]] == [(2, 72)]


def test_cover_is_a_difference_cover():
    differences = {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER}
    assert differences == set(range(repeats.PERIOD))


HITS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
ITEMS = [
    (1, brute.PASSAGE),
    (2, "watch from old oak trees"),
    (2, "watch from old oak trees"),
    (10, "one"),
    (None, "alpha3 alpha4"),
    (5, None),
    (6, " .,- "),
    (7, " ".join(f"w{i % 977}x{i}" for i in range(29_000, 29_040))),
]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_WORDS, 15])
def test_decontamination_on_odd_documents(spark, odd, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    benchmark = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = decontaminate.hit_counts(decontaminate.find_passages(odd, benchmark))
    documents = pairs(odd)
    assert rows(found, *HITS) == expected(documents, [brute.hits(t, ITEMS) for _, t in documents])


def test_decontamination_query(spark, documents):
    items = [tuple(row) for row in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    found = rows(queries.op10_decontaminate(spark, SF_DIR), *HITS)
    assert found == expected(pairs(documents), [brute.hits(t, items) for _, t in pairs(documents)])
    assert any(row[-1] for row in found)


LICENCE = ("n_words", "n_base", "first_word", "last_word", "base_labels")


def test_licence_base_on_odd_documents(odd):
    documents = pairs(odd)
    found = licences.scan(odd)
    assert rows(found, *LICENCE) == expected(documents, [brute.licence_base(t) for _, t in documents])
    assert {row.labels for row in found.where("doc_id = 20").collect()} == {"cc-by,cc-by-nc,reserved"}


def test_licence_query(spark, documents):
    found = queries.op3_licence_scan(spark, SF_DIR)
    assert rows(found, *LICENCE) == expected(pairs(documents), [brute.licence_base(t) for _, t in pairs(documents)])
    assert found.where("score < 0 OR score > 1 OR NOT startswith(labels, '') OR labels IS NULL").isEmpty()


def test_licence_spans(spark):
    notice = next(text for text, label in licences.TEMPLATES if label == "mit" and text.startswith("Permission"))
    text = f"{notice} and so on. {notice.replace('software', 'program')}"
    frame = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = licences.scan(frame).first()
    assert row.labels == "mit" and len(row.spans) == 2 and row.score == 1.0
    assert row.spans[0].first_word == 0 and 0.75 <= row.spans[1].coverage < 1


def labels_of(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [row.labels for row in licences.scan(frame).orderBy("doc_id").collect()]


def test_whole_licences_have_their_label_alone(spark):
    texts = {label: text for label, text in licence_texts.WHOLE_TEXTS.items() if label != "gpl"}
    noise = "Copyright 2020 by somebody. "
    assert labels_of(spark, [noise + text + " The end of it." for text in texts.values()]) == list(texts)
    # Without punctuation, and on lines of a comment.
    commented = ["\n".join(" * " + line.replace(",", "") for line in text.splitlines()) for text in texts.values()]
    assert labels_of(spark, commented) == list(texts)


def test_sections_and_versions(spark):
    texts = {
        licence_texts.sections(licence_texts.MIT)[2]: "mit",
        licence_texts.sections(licence_texts.ZLIB)[0]: "zlib",
        licence_texts.sections(licence_texts.BSD)[4]: "bsd",
        " ".join(licence_texts.sections(licence_texts.MIT)[2].split()[8:]): "mit",  # without its beginning
        "Licensed under CC BY-SA 3.0": "cc-by,cc-by-sa",
        "Licensed under CC BY-NC-SA 2.5": "cc-by,cc-by-nc-sa",
        "Licensed under CC BY-NC": "cc-by",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License": "cc-by-sa-3.0",
        "This work is licensed under the GNU General Public License, version 2": "gpl,gpl-2.0",
        "CC0 1.0 Universal": "cc0",
        "all of this work was done by the author and is provided as is with the use of this software in mind": "",
        "the software is provided": "",
    }
    assert labels_of(spark, list(texts)) == list(texts.values())


def test_coverage_against_every_chain(spark):
    """Labels of mutilated sections against the words that runs of three or more can cover, found by trying all."""
    import random

    chosen = random.Random(7)
    sections = [t for t in licences.TEMPLATES if len(brute.plain_words(t[0])) >= 40]
    texts, expected = [], []
    for text, label in sections:
        words = brute.plain_words(text)
        for changed in (2, len(words) // 12, len(words) // 4):
            places = chosen.sample(range(len(words)), changed)
            mutilated = [f"zz{i}" if i in places else w for i, w in enumerate(words)]
            runs = "".join("x" if i in places else "." for i in range(len(words))).split("x")
            covered = sum(len(r) for r in runs if len(r) >= licences.MIN_MATCH)
            texts.append(" ".join(mutilated))
            expected.append(label if covered >= licences.LABEL_COVERAGE * len(words) else None)
    for found, label, text in zip(labels_of(spark, texts), expected, texts):
        names = set(found.split(",")) - {""}
        assert (label in names) == (label is not None), text
        assert names <= {label, "gpl", "reserved"}


def test_matching_statistics():
    """Against the longest run of any template, word by word."""
    templates = [("a b c d b c", "x"), ("b c b a d", "y"), ("c d b c b", "z")]
    automaton = licences.Automaton(templates, [("d b", "p")])
    numbers = {w: i for i, w in enumerate(sorted("abcd", key=lambda w: _hash(w)))}
    text = "a b c b c d b c b a d a b c d d b".split()
    for place, (_, length) in enumerate(automaton.statistics([numbers[w] for w in text])):
        longest = max(
            n for n in range(place + 2) if any(" ".join(text[place + 1 - n : place + 1]) in t for t, _ in (*templates, ("d b", "")))
        )
        assert length == longest


def _hash(word):
    return int(decontaminate.item_words(__import__("pyarrow").array([word]))[0][1][0])


QUALITY = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_on_odd_documents(spark, odd):
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 0), (None, 1, 0), (14, 0, 0)], "doc_id bigint, quality int, toxic int")
    documents = pairs(odd)
    found = quality.judge(odd, labels)
    assert rows(found, *QUALITY) == expected(documents, [brute.quality(t) for _, t in documents])
    without = quality.judge(odd, labels.limit(0))
    assert without.where("score != 0 OR kept = base_failed").isEmpty()


def test_quality_query(spark, documents):
    found = queries.op8_quality_rules(spark, SF_DIR)
    assert rows(found, *QUALITY) == expected(pairs(documents), [brute.quality(t) for _, t in pairs(documents)])
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    shares = found.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    shares = {row[0]: row[1] for row in shares}
    assert shares[0] < 0.1
    assert found.join(labels.where("quality = 1"), "doc_id").where("NOT kept AND NOT base_failed").isEmpty()


def test_quality_score(spark, documents):
    """Scores against counts in plain Python."""
    import math

    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    good = {row.doc_id for row in labels.where("quality = 1 AND toxic = 0").collect()}
    import numpy as np

    counts = np.ones((2, 1 << quality.BUCKET_BITS))
    data = {key: np.frombuffer(text.encode(), np.uint8) for key, text in pairs(documents)}
    buckets = {key: quality.byte_runs(d, np.array([0, len(d)]))[0] for key, d in data.items()}
    for key, found in buckets.items():
        for bucket in found:
            counts[1][bucket] += 1
            counts[0][bucket] += key in good
    logs = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    for row in queries.op8_quality_rules(spark, SF_DIR).select("doc_id", "score").collect():
        found = buckets[row.doc_id]
        assert math.isclose(row.score, logs[found].mean() if len(found) else 0, abs_tol=1e-9)


def test_empty_tables(no_documents, spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id bigint, text string")
    assert jaccard.components(no_documents).isEmpty()
    assert repeats.remove_repeats(no_documents).isEmpty()
    assert decontaminate.hit_counts(decontaminate.find_passages(no_documents, benchmark)).isEmpty()
    assert licences.scan(no_documents).isEmpty()
    assert quality.judge(no_documents, labels).isEmpty()

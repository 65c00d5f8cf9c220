"""BPE by chunks against the tokenizers library, and round trips."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, queries

from . import brute
from .conftest import SF_DIR

PATH = public_tokenizers.path(queries.BYTE_TOKENIZER)
LIBRARY = Tokenizer.from_file(PATH)
#: What words, contractions, runs of white space and special tokens are made of.
PARTS = [
    "a", "b", " ", "  ", "\n", "\t", "'s", "'", "'ll", "'l", "l", "re", "1", "22", "é", "漢", "字", "́", " ", " ",
    "<|endoftext|>", "<|endof", "text|>", "!", "!!", "😀", "\r\n", " x", "'ve", "d", "　", "٣", "\x00", "\x85",
]


def library(texts):
    return [e.ids for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def by_chunks(texts):
    return [ids.tolist() for part in bpe.Encoder(PATH).encode(pa.array(texts, pa.string())) for ids in part]


def odd_texts(seed):
    chosen = random.Random(seed)
    texts = ["".join(chosen.choice(PARTS) for _ in range(chosen.randrange(300))) for _ in range(300)]
    texts += ["".join(chosen.choice(chosen.sample(PARTS, 3)) for _ in range(chosen.randrange(150))) for _ in range(300)]
    texts += ["a" * k + " " * k + "\n" * k + "a'll'l" * k for k in range(40)]
    return texts + [text for _, text in brute.ODD]


@pytest.mark.parametrize("sizes", [(16, 9, 128, 4096, 4), (4, 2, 2, 9, 1), (4, 3, 3, 30, 2), (2, 1, 1, 3, 1)])
def test_chunks_give_the_ids_of_whole_texts(monkeypatch, sizes):
    for name, value in zip(("WINDOW", "CUT_BITS", "LEAST", "MOST", "HEAD_WORDS"), sizes):
        monkeypatch.setattr(bpe, name, value)
    texts = odd_texts(sum(sizes))
    assert by_chunks(texts) == library(texts)


def test_long_runs_without_a_border():
    texts = ["single" * 30_000, " " * 100_000 + "x", "'" * 20_000, "ab " * 30_000, "é" * 50_000]
    assert by_chunks(texts) == library(texts)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 0)
    texts = [text for _, text in brute.ODD] * 2
    assert by_chunks(texts) == library(texts)


def test_shared_passages_share_chunks():
    """A copy behind other text, and within another document, is cut alike and encoded once."""
    chosen = random.Random(1)
    passage = " ".join(chosen.choice(("tree", "stone", "river", "cloud", "bird")) + str(i) for i in range(2000))
    texts = [passage, f"other words first {passage}", f"{passage} and more"]
    encoder = bpe.Encoder(PATH)
    held = []
    for text in texts:
        list(encoder.encode(pa.array([text])))
        held.append(encoder.held)
    assert held[2] < 1.2 * held[0]


def test_cuts_are_between_characters():
    text = ("漢字é" * 3000).encode()
    data = np.frombuffer(text, np.uint8)
    ends = bpe.Cutter(data).ends(0, len(data))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and (sizes[:-1] >= bpe.LEAST).all() and (sizes <= bpe.MOST + 4).all()
    for end in ends:
        text[:end].decode()


def test_round_trip_of_odd_documents(spark, odd):
    rows = odd.withColumn("ids", F.lit("x"))
    found = bpe.decode(bpe.encode(rows, PATH), PATH).collect()
    documents = [(row.doc_id, row.text) for row in odd.select("doc_id", "text").collect()]
    expected = Counter((k, t or "", tuple(ids)) for (k, t), ids in zip(documents, library(t for _, t in documents)))
    assert Counter((row.doc_id, row.text, tuple(row.ids)) for row in found) == expected


def test_decoding_as_the_library_does(spark):
    chosen = random.Random(4)
    rows = [(i, [chosen.randrange(50_257) for _ in range(chosen.randrange(9))]) for i in range(200)]
    rows += [(900, []), (901, None), (902, [50256, 64, 50256]), (903, [-1, 64, 99_999])]
    frame = spark.createDataFrame(rows, "doc_id int, ids array<int>")
    found = {row.doc_id: row.text for row in bpe.decode(frame, PATH).collect()}
    for key, ids in rows:
        assert found[key] == LIBRARY.decode([i for i in ids or [] if 0 <= i < 50_257], skip_special_tokens=False)


def test_bpe_query(spark, documents):
    rows = [(row.doc_id, row.text) for row in documents.collect()]
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = Counter(
        (key, len(ids), digest(",".join(map(str, ids))), digest(LIBRARY.decode(ids, skip_special_tokens=False)))
        for (key, _), ids in zip(rows, library(t for _, t in rows))
    )
    assert Counter(map(tuple, queries.op11_bpe_round_trip(spark, SF_DIR).collect())) == expected


def test_no_documents(no_documents):
    assert bpe.encode(no_documents, PATH).isEmpty()


def test_other_tokenizers_are_refused(tmp_path):
    with open(PATH, encoding="utf-8") as file:
        stored = json.load(file)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": None}):
        path = tmp_path / "changed.json"
        path.write_text(json.dumps(stored | change), encoding="utf-8")
        with pytest.raises(ValueError, match="plain byte-level"):
            bpe.Vocabulary(str(path))

"""Language identification of whole texts, with spans of mixed-language text.

Words are runs of ASCII letters and bytes outside ASCII, lower-cased. A model holds per language the
log probabilities of hashed three-byte runs (a word's edges count as bytes) and the scripts its
words are written in. Each word's script narrows the languages it may belong to; a Viterbi pass over
the words then labels spans, where a change of language costs SWITCH_PENALTY. The document's language
is the one with most bytes; the score is its share, and `known` that of all letters whose script a learned language uses.

Defined results: a text that is null or has no letter is `und` with score 0 and no spans, as is every
text if nothing was learned; letters of a script that no learned language uses give the language
learned from most words, with score 0; ties go to the language first by name; repeated documents are
judged one by one; rows without language or text teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import map_arrow
from tidemark.llm.words import Words, mix, slices, split_words, text_bytes

BUCKET_BITS = 16
#: Runs whose 64-bit codes are held at once.
MIXED_AT_ONCE = 1 << 16
SWITCH_PENALTY = 12.0
#: A language is a candidate for a script if this share of its words is written in it.
SCRIPT_SHARE = 0.005
UNKNOWN = "und"
LETTERS = np.array([chr(c).isalpha() if c < 128 else True for c in range(256)])

# First code point of each range of letters, and the script from there on.
SCRIPTS = ((0x00, 0), (0x370, 1), (0x400, 2), (0x530, 3), (0x590, 4), (0x600, 5), (0x700, 6), (0x900, 7), (0x980, 8),
           (0xE00, 9), (0x10A0, 10), (0x1100, 11), (0x1200, 12), (0x1E00, 0), (0x1F00, 1), (0x2000, 0), (0x3040, 13),
           (0x3400, 14), (0xAC00, 11), (0xF900, 14), (0xFB50, 5), (0xFF00, 0), (0x10000, 15))
SCRIPT_STARTS = np.array([start for start, _ in SCRIPTS])
SCRIPT_NUMBERS = np.array([number for _, number in SCRIPTS])
N_SCRIPTS = int(SCRIPT_NUMBERS.max()) + 1


def letters(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    for low, high, _, _ in slices(column):
        data, offsets = text_bytes(pc.utf8_lower(column.slice(low, high - low).cast(pa.large_string())))
        yield low, high, split_words(data, offsets, LETTERS)


def word_features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the three-byte runs of all words, the first of each word, and each word's script."""
    lengths = (words.end - words.start).astype(np.int32)
    first = np.cumsum(lengths, dtype=np.int32) - lengths
    total = int(lengths.sum())
    place = np.arange(total, dtype=np.int32)
    place -= np.repeat(first - words.start.astype(np.int32), lengths)
    content = words.data[place].astype(np.uint32)
    del place
    before, after = np.zeros(total, np.uint32), np.zeros(total, np.uint32)
    before[1:], after[:-1] = content[:-1], content[1:]
    before[first] = 0
    after[first + lengths - 1] = 0
    before |= content << np.uint32(8)
    before |= after << np.uint32(16)
    buckets = np.empty(total, np.int32)
    for low in range(0, total, MIXED_AT_ONCE):
        part = slice(low, low + MIXED_AT_ONCE)
        buckets[part] = mix(before[part].astype(np.uint64)) >> np.uint64(64 - BUCKET_BITS)
    scripts = np.zeros(total, np.int8)
    for lead, size in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
        at = np.flatnonzero((content >= lead) & (content < lead + (0x20 >> (size - 2))))
        at = at[at + size <= total]
        point = content[at].astype(np.int64) & (0xFF >> (size + 1))
        for j in range(1, size):
            point = point << 6 | content[at + j].astype(np.int64) & 0x3F
        scripts[at] = SCRIPT_NUMBERS[np.searchsorted(SCRIPT_STARTS, point, "right") - 1]
    return buckets, first, np.maximum.reduceat(scripts, first) if total else np.zeros(0, np.int8)


def learned_counts(docs: DataFrame) -> DataFrame:
    """Rows lang, feature, n over every row of `docs` (text, lang): buckets first, then scripts."""
    size = (1 << BUCKET_BITS) + N_SCRIPTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for low, high, words in letters(batch.column("text")):
                names = batch.column("lang").slice(low, high - low).to_pylist()
                buckets, first, scripts = word_features(words)
                of_word = words.rows()
                of_byte = np.repeat(of_word, words.end - words.start)
                for name in set(names):
                    chosen = np.array([n == name for n in names])
                    found = totals.setdefault(name, np.zeros(size, np.int64))
                    found[: 1 << BUCKET_BITS] += np.bincount(buckets[chosen[of_byte]], minlength=1 << BUCKET_BITS)
                    found[1 << BUCKET_BITS :] += np.bincount(scripts[chosen[of_word]], minlength=N_SCRIPTS)
        for name, found in totals.items():
            features = np.flatnonzero(found)
            if len(features):
                lang = pa.array([name] * len(features), pa.string())
                yield pa.RecordBatch.from_pydict({"lang": lang, "feature": features, "n": found[features]})

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    rows = map_arrow(rows, count, "lang string, feature bigint, n bigint")
    return rows.groupBy("lang", "feature").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages by name; log probabilities (bucket, language); candidates (script, language)."""

    languages: list[str]
    log_p: np.ndarray
    candidates: np.ndarray
    usual: int


def learn(docs: DataFrame) -> Model:
    """The model of `docs` (text, lang); its size depends on the number of languages alone."""
    rows = learned_counts(docs).toPandas()
    languages = sorted(rows["lang"].unique())
    counts = np.zeros((len(languages), (1 << BUCKET_BITS) + N_SCRIPTS))
    counts[rows["lang"].map({name: i for i, name in enumerate(languages)}).astype(int), rows["feature"]] = rows["n"]
    runs, scripts = counts[:, : 1 << BUCKET_BITS] + 0.1, counts[:, 1 << BUCKET_BITS :]
    log_p = np.log(runs / runs.sum(axis=1, keepdims=True))
    candidates = scripts >= np.maximum(SCRIPT_SHARE * scripts.sum(axis=1, keepdims=True), 1)
    usual = int(scripts.sum(axis=1).argmax()) if languages else 0
    return Model(languages, np.ascontiguousarray(log_p.T, np.float32), candidates.T, usual)


def word_scores(model: Model, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each word in each language, and whether any language uses its script."""
    buckets, first, scripts = word_features(words)
    if len(first) == 0 or not model.languages:
        return np.zeros((len(first), len(model.languages)), np.float32), np.zeros(len(first), bool)
    columns = [np.add.reduceat(model.log_p[:, i][buckets], first) for i in range(len(model.languages))]
    scores, possible = np.stack(columns, axis=1), model.candidates[scripts]
    known = possible.any(axis=1)
    scores[known[:, None] & ~possible] = -1e6
    scores[~known] = 0
    return scores, known


def best_path(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The language of each word on the best path through its text; all texts are walked in step."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begins, sizes = first[:-1][order], lengths[order]
    active = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")
    value = np.zeros((len(order), scores.shape[1]), np.float32)
    came = np.zeros(scores.shape, np.int16)
    own = np.arange(scores.shape[1], dtype=np.int16)
    for step, n in enumerate(active):
        at = begins[:n] + step
        now = value[:n]
        best = now.argmax(axis=1)
        top = now[np.arange(n), best] - penalty
        change = top[:, None] > now
        came[at] = np.where(change, best[:, None], own)
        value[:n] = np.maximum(now, top[:, None]) + scores[at]
        if step % 64 == 63:
            value[:n] -= value[:n].max(axis=1, keepdims=True)
    path = np.zeros(len(scores), np.int16)
    state = value.argmax(axis=1)
    for step in range(len(active) - 1, -1, -1):
        n = active[step]
        at = begins[:n] + step
        path[at] = state[:n]
        state[:n] = came[at, state[:n]]
    return path


def has_letter(texts: pa.Array, words: Words) -> np.ndarray:
    """Whether each text has a letter; only texts without an ASCII letter are looked at one by one."""
    ascii_letter = np.concatenate([[0], np.cumsum(LETTERS[words.data] & (words.data < 128))])
    found = ascii_letter[words.offsets[1:]] > ascii_letter[words.offsets[:-1]]
    for row in np.flatnonzero(~found & (words.counts > 0)):
        found[row] = any(c.isalpha() for c in texts[int(row)].as_py())
    return found


def identify(
    docs: DataFrame,
    teaching: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    lang_column: str = "lang",
    penalty: float = SWITCH_PENALTY,
) -> DataFrame:
    """Per row of `docs`: id, lang_pred, score, known and spans, by what the rows of `teaching` teach.

    Spans count words (runs of letters) from 0.
    """
    lessons = teaching.select(F.col(text_column).cast("string").alias("text"), F.col(lang_column).alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(learn(lessons))
    span = pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = model.value.languages
        for batch in batches:
            for low, high, words in letters(batch.column("text")):
                rows = np.arange(high - low)
                good = has_letter(batch.column("text").slice(low, high - low), words) & (len(names) > 0)
                scores, known = word_scores(model.value, words)
                path = best_path(scores, words.first, penalty) if names else np.zeros(len(known), np.int16)
                of_word = words.rows()
                sizes = np.where(known, words.end - words.start, 0)
                width = max(len(names), 1)
                share = np.bincount(of_word * width + path, sizes, (high - low) * width).reshape(-1, width)
                total = np.bincount(of_word, words.end - words.start, high - low)
                lang = np.where(share.sum(axis=1) > 0, share.argmax(axis=1), model.value.usual)
                score = np.where(good, share[rows, lang if names else 0] / np.maximum(total, 1), 0.0)
                covered = np.where(good, share.sum(axis=1) / np.maximum(total, 1), 0.0)
                begins = np.flatnonzero((np.diff(path, prepend=-1) != 0) | (np.diff(of_word, prepend=-1) != 0))
                begins = begins[good[of_word[begins]]]
                ends = np.minimum(np.append(begins[1:], len(path)), words.first[1:][of_word[begins]])
                spans = pa.StructArray.from_arrays(
                    [
                        pa.array([names[i] for i in path[begins]], pa.string()),
                        pa.array(begins - words.first[of_word[begins]], pa.int64()),
                        pa.array(ends - begins, pa.int64()),
                    ],
                    fields=list(span),
                )
                places = np.searchsorted(of_word[begins], np.arange(high - low + 1)).astype(np.int32)
                columns = {
                    id_column: batch.column("id").slice(low, high - low),
                    "lang_pred": pa.array([names[i] if g else UNKNOWN for i, g in zip(lang, good)], pa.string()),
                    "score": score,
                    "known": covered,
                    "spans": pa.ListArray.from_arrays(places, spans),
                }
                yield pa.RecordBatch.from_pydict(columns)

    schema = (
        f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, lang_pred string, score double, "
        "known double, spans array<struct<lang: string, first_word: bigint, n_words: bigint>>"
    )
    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return map_arrow(plain, label, schema)

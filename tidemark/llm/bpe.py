"""Byte-level BPE encoding that reuses content-defined chunks, and decoding.

A text is cut where a rolling hash of the last WINDOW bytes says so, so that texts that share a passage share its
chunks wherever it stands. A task encodes each chunk once, with the tokenizers library, while it remembers it
(REMEMBERED_BYTES); copies are looked up by their bytes. A chunk encoded alone may differ from the same bytes
within a text near both of its ends, so each join is repaired: the text from the last word before it that is
certain is encoded again together with the first words behind it, with more of them until the new words and those of the
next chunk agree on a border. From an agreed border on both are the same, as the tokenizer's words depend on what follows
them only; a word is certain if the text that decided it lies within the chunk. So the ids are exactly those of
the whole text, whatever the cuts. Encoded joins are remembered like chunks.

Words of chunks in the Latin scripts are found by the library's own pattern, with character classes asked from the library,
and each distinct one is encoded by it once; chunks with other characters go to the library whole.

Special tokens part a text before anything else, as the library has it. Taken are tokenizers of byte-level words without
normalizer, prefix space or other conditions on special tokens; truncation and padding settings are not used.

Decoding looks up the bytes of all ids of a batch at once; ids outside the vocabulary are left out, and bytes
that are no UTF-8 become U+FFFD.

Defined results: null and empty texts have no ids, and no ids give the empty text; invalid UTF-8 is read as U+FFFD;
repeated rows are encoded each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import map_arrow
from tidemark.llm.words import Numbers, slices

#: Bytes that the rolling hash looks at, bits of it that are zero at a cut, and sizes of chunks in bytes.
WINDOW, CUT_BITS, LEAST, MOST = 16, 9, 128, 4096
#: Words behind a join that are encoded again at first.
HEAD_WORDS = 4
#: Bytes of chunks and joins that a task remembers.
REMEMBERED_BYTES = 8 << 20
#: Chunks that are encoded in one call, and ids that are decoded at once (more only in one row): both take many times
#: their size for a moment.
CALL_CHUNKS, DECODED_IDS = 256, 1 << 17
#: Bytes of distinct words that a task remembers.
WORD_BYTES = 4 << 20
#: Characters below the first are looked at here; in UTF-8 they have no byte above the second.
PLAIN, PLAIN_BYTE = 0x240, 0xC8
#: Fixed value: how byte-level tokenizers find words, with classes of letters, numbers and white space to be filled in.
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
#: A word is certain if so many bytes from its start are there: the longest contraction.
CONTRACTION = 3

_GEAR = np.random.Generator(np.random.PCG64(23)).integers(0, 1 << 63, 256, dtype=np.uint64)


def rolling_hashes(data: np.ndarray) -> np.ndarray:
    """By byte, a hash of the WINDOW bytes that end there (of fewer at the beginning)."""
    hashes, width = _GEAR[data], 1
    while width < WINDOW:
        hashes[width:] += hashes[:-width] << np.uint64(width)
        width *= 2
    return hashes


class Cutter:
    """Cuts stretches of some bytes of UTF-8 into chunks."""

    def __init__(self, data: np.ndarray):
        whole = np.flatnonzero((data & 0xC0) != 0x80)
        places = np.flatnonzero(rolling_hashes(data) >> np.uint64(64 - CUT_BITS) == 0) + 1
        at = np.searchsorted(whole, places)
        #: Cuts go to the next first byte of a character.
        self.cuts = np.unique(whole[at[at < len(whole)]])
        self.whole = whole

    def ends(self, low: int, high: int) -> list[int]:
        """Ends of the chunks of the bytes from `low` to `high`, LEAST to about MOST long."""
        found, at = [], low
        while high - at > LEAST:
            i = np.searchsorted(self.cuts, at + LEAST)
            end = int(self.cuts[i]) if i < len(self.cuts) else high
            if end > at + MOST:
                i = np.searchsorted(self.whole, at + MOST)
                end = int(self.whole[i]) if i < len(self.whole) else high
            if end >= high:
                break
            found.append(end)
            at = end
        return [*found, high] if high > low else []


class Piece:
    """Some text encoded alone: its ids, and where its words start in the ids and in the bytes.

    `tail` is the first word that is not certain, as what follows the text may change it.
    """

    __slots__ = ("ids", "first", "start", "tail", "size")

    def __init__(self, ids: np.ndarray, first: np.ndarray, start: np.ndarray, size: int):
        self.ids, self.first, self.start, self.size = ids, first, start, size
        self.tail = min(len(start) - 1, int(np.searchsorted(start, size - CONTRACTION, "right")))


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


#: Bytes, read as Latin-1, to the characters that stand for them.
BYTE_NAMES = {byte: character for character, byte in byte_characters().items()}


class Vocabulary:
    """A tokenizer file: the library's tokenizer, special tokens, and the bytes of each id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        words = stored["pre_tokenizer"] or {}
        plain = words.get("type") == "ByteLevel" and words.get("use_regex") and not words.get("add_prefix_space")
        conditions = ("single_word", "lstrip", "rstrip", "normalized")
        if not plain or stored["normalizer"] or any(t[c] for t in stored["added_tokens"] for c in conditions):
            raise ValueError(f"{path} is not a plain byte-level tokenizer")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {token["content"]: token["id"] for token in stored["added_tokens"]}
        by_length = sorted(self.special, key=len, reverse=True)
        self.parts = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        characters = byte_characters()
        names = self.tokenizer.get_vocab()
        table = [b""] * (max(names.values()) + 1)
        self.known = np.zeros(len(table), bool)
        for name, number in names.items():
            self.known[number] = True
            table[number] = name.encode() if name in self.special else bytes(characters[c] for c in name)
        self.lengths = np.array([len(content) for content in table], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.content = np.frombuffer(b"".join(table), np.uint8)

        self.words = re.compile(self._word_pattern())

    def _word_pattern(self) -> str:
        """The pattern of words of plain characters, each in the class that the library puts it in."""
        found = {"L": "a", "N": "1", "S": "\n"}
        for character in map(chr, range(PLAIN)):
            for name, other in (("L", "a"), ("N", "1"), ("S", "\n")):
                if len(self.tokenizer.pre_tokenizer.pre_tokenize_str(other + character)) == 1:
                    found[name] += character
        return WORD_PATTERN.format(**{name: re.escape(characters) for name, characters in found.items()})

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        lengths = self.lengths[ids]
        begun = np.cumsum(lengths) - lengths
        return self.content[np.arange(lengths.sum()) + np.repeat(self.starts[ids] - begun, lengths)]


    def texts(self, lists: pa.ListArray) -> pa.Array:
        """The text of each list of ids."""
        lists = lists.fill_null([])
        flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
        known = (flat >= 0) & (flat < len(self.lengths))
        known[known] = self.known[flat[known]]
        ids = flat[known]
        before = np.append(0, np.cumsum(known))[ends]
        places = np.append(0, np.cumsum(self.lengths[ids]))[before]
        parts = [pa.py_buffer(places.astype(np.int64)), pa.py_buffer(self.bytes_of(ids))]
        raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, *parts])
        try:
            return raw.cast(pa.binary()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([value.as_py().decode("utf-8", "replace") for value in raw], pa.string())


_vocabularies: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


class WordIds:
    """The ids of distinct words, each encoded alone."""

    def __init__(self, of: Vocabulary):
        self.of, self.model = of, of.tokenizer.model
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.held = 0
        #: All ids, and by word where its ids start and how many they are, and its bytes.
        self.flat = np.zeros(0, np.int32)
        self.first, self.size, self.bytes = (np.zeros(0, np.int64) for _ in range(3))

    def numbers(self, words: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new, self.number.new = self.number.new, []
        if new:
            contents = [word.encode() for word in new]
            ids = [[t.id for t in self.model.tokenize(c.decode("latin-1").translate(BYTE_NAMES))] for c in contents]
            size, content = np.array([len(i) for i in ids]), np.array([len(c) for c in contents])
            self.first = np.append(self.first, len(self.flat) + np.cumsum(size) - size)
            self.size, self.bytes = np.append(self.size, size), np.append(self.bytes, content)
            self.flat = np.append(self.flat, np.fromiter((i for each in ids for i in each), np.int32, size.sum()))
            self.held += int(content.sum())
        return found

    def pieces(self, texts: list[str]) -> Iterator[Piece]:
        lists = [self.of.words.findall(text) for text in texts]
        ends = np.cumsum([len(words) for words in lists])
        numbers = self.numbers([word for words in lists for word in words])
        size, content = self.size[numbers], self.bytes[numbers]
        first, start = np.cumsum(size) - size, np.cumsum(content) - content
        ids = self.flat[np.repeat(self.first[numbers] - first, size) + np.arange(size.sum())]
        first, start = np.append(first, size.sum()), np.append(start, content.sum())
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            here = first[a:b] - first[a]
            yield Piece(ids[first[a] : first[b]].copy(), here.astype(np.int32), (start[a:b] - start[a]).astype(np.int32), int(start[b] - start[a]))


class Encoder:
    """Encodes whole columns of texts; remembers what it has encoded."""

    def __init__(self, path: str):
        self.of = vocabulary(path)
        self.words = WordIds(self.of)
        self.known: dict[bytes, Piece] = {}
        self.held = 0

    def _learn(self, wanted: set[bytes]) -> None:
        new = [content for content in wanted if content not in self.known]
        plain = [content for content in new if np.frombuffer(content, np.uint8).max() <= PLAIN_BYTE]
        others = list(set(new).difference(plain))
        for contents, pieces in ((plain, self.words.pieces), (others, self._by_library)):
            for low in range(0, len(contents), CALL_CHUNKS):
                part = contents[low : low + CALL_CHUNKS]
                self.known.update(zip(part, pieces([content.decode() for content in part])))
        self.held += sum(map(len, new))

    def _by_library(self, texts: list[str]) -> Iterator[Piece]:
        for encoding in self.of.tokenizer.encode_batch(texts, add_special_tokens=False):
            ids, words = np.array(encoding.ids, np.int32), np.array(encoding.word_ids)
            first = np.flatnonzero(np.append(True, words[1:] != words[:-1])).astype(np.int32)
            lengths = self.of.lengths[ids]
            ends = np.cumsum(lengths)
            yield Piece(ids, first, (ends - lengths)[first].astype(np.int32), int(ends[-1]))

    def _piece(self, content: bytes) -> Piece:
        if content not in self.known:
            self._learn({content})
        return self.known[content]

    def encode(self, texts: pa.Array) -> Iterator[list[np.ndarray]]:
        """The ids of successive texts, some texts at a time."""
        for low, high, data, offsets in slices(texts):
            if self.held > REMEMBERED_BYTES:
                self.known.clear()
                self.held = 0
            if self.words.held > WORD_BYTES:
                self.words.forget()
            content = data.tobytes()
            cutter = Cutter(data)
            rows = [self._stretches(content, a, b, cutter) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            self._learn({chunk for parts in rows for part in parts if isinstance(part, list) for chunk in part})
            joins = (join for parts in rows for part in parts if isinstance(part, list) for join in self._joins(part))
            self._learn(set(joins))
            yield [self._ids(parts) for parts in rows]

    def _stretches(self, content: bytes, low: int, high: int, cutter: Cutter) -> list[list[bytes] | int]:
        """Chunks of the stretches between special tokens, and the ids of these."""
        if self.of.parts is None or not any(token.encode() in content[low:high] for token in self.of.special):
            spans: list[tuple[int, int] | int] = [(low, high)]
        else:
            spans, at = [], low
            for part in self.of.parts.split(content[low:high].decode()):
                size = len(part.encode())
                spans.append(self.of.special[part] if part in self.of.special else (at, at + size))
                at += size
        found: list[list[bytes] | int] = []
        for span in spans:
            if isinstance(span, int):
                found.append(span)
            elif span[1] > span[0]:
                ends = cutter.ends(*span)
                found.append([content[a:b] for a, b in zip([span[0], *ends[:-1]], ends)])
        return found

    def _joins(self, chunks: list[bytes]) -> Iterator[bytes]:
        """What most joins encode again."""
        for left, right in zip(chunks[:-1], chunks[1:]):
            before, behind = self.known[left], self.known[right]
            if before.tail and HEAD_WORDS < len(behind.start):
                yield left[before.start[before.tail] :] + right[: behind.start[HEAD_WORDS]]

    def _ids(self, parts: list[list[bytes] | int]) -> np.ndarray:
        found = [np.zeros(0, np.int32)]
        for part in parts:
            found += [np.array([part], np.int32)] if isinstance(part, int) else self._repaired(part)
        return np.concatenate(found)

    def _repaired(self, chunks: list[bytes]) -> list[np.ndarray]:
        """The ids of successive chunks as one text."""
        found: list[np.ndarray] = []
        # Text before the chunk that is not settled; it begins where a word does.
        open_text = b""
        for i, chunk in enumerate(chunks):
            piece, last = self.known[chunk], i == len(chunks) - 1
            word: int | None = 0
            if open_text:
                if not last and len(piece.start) == 1:
                    open_text += chunk
                    continue
                ids, word = self._settle(open_text, chunk, piece, last)
                if word is None:
                    if last:
                        found.append(ids)
                    open_text += chunk
                    continue
                found.append(ids)
            if last:
                found.append(piece.ids[piece.first[word] :])
            else:
                tail = max(word, piece.tail)
                found.append(piece.ids[piece.first[word] : piece.first[tail]])
                open_text = chunk[piece.start[tail] :]
        return found

    def _settle(self, open_text: bytes, chunk: bytes, piece: Piece, last: bool) -> tuple[np.ndarray, int | None]:
        """The ids up to the first border on which both agree, and the chunk's word that starts there.

        None if there is none in the chunk; then the ids are those of all the text, if it ends here.
        """
        words = HEAD_WORDS
        while True:
            whole = words >= len(piece.start)
            joined = self._piece(open_text + (chunk if whole else chunk[: piece.start[words]]))
            ends_here = whole and last
            borders = joined.start if ends_here else joined.start[: joined.tail + 1]
            borders = borders[np.searchsorted(borders, len(open_text)) :]
            at = np.searchsorted(piece.start, borders - len(open_text))
            agreed = np.flatnonzero(piece.start[np.minimum(at, len(piece.start) - 1)] == borders - len(open_text))
            if len(agreed):
                border = borders[agreed[0]]
                first = joined.first[np.searchsorted(joined.start, border)]
                return joined.ids[:first], int(at[agreed[0]])
            if whole:
                return joined.ids, None
            words *= 2


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows id_column, ids: the token ids of each whole text, without those that mark beginnings and ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            at = 0
            for found in encoder.encode(batch.column("text")):
                ends = np.cumsum([len(ids) for ids in found], dtype=np.int32)
                lists = pa.ListArray.from_arrays(np.append(np.int32(0), ends), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_pydict({"id": batch.column("id").slice(at, len(found)), "ids": lists})
                at += len(found)

    text = F.make_valid_utf8(F.col(text_column).cast("string"))
    plain = docs.select(F.col(id_column).alias("id"), text.alias("text"))
    found = map_arrow(plain, run, f"id {docs.schema[id_column].dataType.simpleString()}, ids array<int>")
    return found.withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str, ids_column: str = "ids") -> DataFrame:
    """Adds `text`, the text of the ids, special tokens included."""
    columns_kept = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = vocabulary(path)
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(ids_column)), 0).to_numpy())
            low = 0
            while low < batch.num_rows:
                before = ends[low - 1] if low else 0
                high = max(int(np.searchsorted(ends, before + DECODED_IDS, "right")), low + 1)
                part = batch.slice(low, high - low)
                columns = {c: part.column(c) for c in columns_kept}
                yield pa.RecordBatch.from_pydict(columns | {"text": of.texts(part.column(ids_column))})
                low = high

    schema = ", ".join(f"`{name}` {kind}" for name, kind in encoded.dtypes)
    return map_arrow(encoded, run, f"{schema}, text string")

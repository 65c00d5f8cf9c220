"""Words of a whole Arrow column of texts at once, as numpy arrays over its UTF-8 bytes.

Null texts count as empty. Texts are cut into slices of about SLICE_BYTES on row borders, so memory
is bounded by the longest single text. Words and runs of words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def byte_table(separators: str) -> np.ndarray:
    """Which bytes belong to a word, by the ASCII characters that do not."""
    table = np.ones(256, bool)
    table[[ord(c) for c in separators]] = False
    return table


WHITE = " " + "".join(map(chr, range(0x09, 0x0E)))
#: Bytes of a word: all but white space; or ASCII letters, digits and everything outside ASCII.
NOT_WHITE = byte_table(WHITE)
ALPHANUMERIC = byte_table("".join(chr(c) for c in range(128) if not chr(c).isalnum()))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Keeps the first n bytes of an eight-byte word.
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the column, and the place where each text starts, with the end of the last."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    _, places, content = filled.buffers()
    if len(filled) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(places, np.int64, len(filled) + 1, filled.offset * 8)
    data = np.frombuffer(content, np.uint8) if content is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of some texts: word w is data[start[w]:end[w]]; text r has words first[r] to first[r + 1]."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def text(self, w: int, n: int = 1) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.start[w : w + n], self.end[w : w + n]))

    def hashes(self) -> np.ndarray:
        """A hash of each word's bytes."""
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each span; spans must not be empty.

    Eight bytes at a time are mixed with their place before they are added up, so that no regular
    arrangement of bytes cancels out, as it does in a polynomial modulo 2 ** 64.
    """
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    lengths = end - start
    blocks = (lengths + 7) >> 3
    begun = np.cumsum(blocks) - blocks
    within = np.arange(blocks.sum()) - np.repeat(begun, blocks)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    wide = np.ndarray(len(data) + 1, np.uint64, padded, strides=(1,))
    content = wide[np.repeat(start, blocks) + (within << 3)]
    last = begun + blocks - 1
    content[last] &= _FIRST_BYTES[lengths - ((blocks - 1) << 3)]
    terms = mix(content ^ ((within + 1).astype(np.uint64) * _MULTIPLIER))
    return mix(np.add.reduceat(terms, begun) ^ (lengths.astype(np.uint64) << np.uint64(40)))


def _blocks(data: np.ndarray, start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes of spans, eight at a time; the last ones of each are padded with zeros."""
    blocks = (lengths + 7) >> 3
    begun = np.cumsum(blocks) - blocks
    within = np.arange(blocks.sum()) - np.repeat(begun, blocks)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    content = np.ndarray(len(data) + 1, np.uint64, padded, strides=(1,))[np.repeat(start, blocks) + (within << 3)]
    content[begun + blocks - 1] &= _FIRST_BYTES[lengths - ((blocks - 1) << 3)]
    return content


def spans_equal(
    data: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray, other_start: np.ndarray, other_end: np.ndarray
) -> bool:
    """Whether each span, none of them empty, has the same bytes as its counterpart."""
    lengths = end - start
    if not np.array_equal(lengths, other_end - other_start):
        return False
    return len(start) == 0 or np.array_equal(_blocks(data, start, lengths), _blocks(other, other_start, lengths))


def split_words(data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray) -> Words:
    inside = word_bytes[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(data):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        starts, ends = offsets[:-1], offsets[1:]
        before[starts[starts < len(data)]] = False
        after[ends[ends > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return Words(data, offsets, start, end, np.searchsorted(start, offsets))


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, rows to, bytes and offsets of successive slices of the column."""
    data, offsets = text_bytes(column)
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + SLICE_BYTES, "right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words that start at each word, over row borders too."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    count = len(hashes) - n + 1
    folded = hashes[:count].copy()
    for j in range(1, n):
        folded *= _MULTIPLIER
        folded += hashes[j : j + count]
    return mix(folded)


def run_starts(words: Words, n: int) -> np.ndarray:
    """Words at which n words of one text start."""
    places = np.arange(len(words.start))
    ends = np.repeat(words.first[1:], words.counts)
    return places[places + n <= ends]


class Numbers(dict):
    """Numbers of texts; one that has none gets the next number and stands in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, text: str) -> int:
        self.new.append(text)
        self[text] = number = len(self)
        return number

"""Licence scan with a generalised suffix automaton over the words of licence templates.

Words are runs of ASCII letters, digits and all bytes outside ASCII, with A-Z lower-cased. Templates are the sections
of whole licence texts, and short notices with their versions (licence_texts.py). A text is
streamed through the automaton, which gives at each word the longest run ending there that stands in
any template (the matching statistics). Runs of MIN_MATCH words or more that cannot be made longer are
chained per template, in the template's order, into spans. A span counts if it covers LABEL_COVERAGE of its
template, or all of it if that has fewer than SHORT words. Spans that count compete for the words they share: the
one that covers most words of its template wins, then the better covered one, and the other keeps its label only if it
has words of its own for most of its length. So the warranty of one licence is not taken for the similar one of another,
and a notice with a version is not taken for that of a shorter one. Base phrases are templates too: a phrase stands
wherever the run reaches back over all its words.

Only words between two neighbours that are neighbours in a template can be part of a run of two or
more, so the automaton steps over those alone; the rest is passed over in bulk.

Phrases and templates have two words or more. Defined results: null, empty and wordless texts have no words, no labels
and score 0; repeated documents are judged one by one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import licence_texts
from tidemark.llm.decontaminate import item_words, pairs
from tidemark.llm.scratch import map_arrow
from tidemark.llm.words import ALPHANUMERIC, LOWER, Words, slices, split_words

MIN_MATCH = 3
LABEL_COVERAGE = 0.75
#: Templates with fewer words must be covered whole.
SHORT = 15
MAX_GAP = 8
#: A span that lost words to others keeps its label if this share of its words is its own.
OWN_SHARE = 0.5

# Phrases and the labels they give.
BASE_PHRASES = (
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
)

TEMPLATES = licence_texts.templates()


class Automaton:
    """Suffix automaton of several word sequences, with where in which template each state ends."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Sequence[tuple[str, str]]):
        split = item_words(pa.array([text for text, _ in (*templates, *phrases)], pa.string()))
        known = sorted({(int(h), w) for words, hashes in split for w, h in zip(words, hashes)})
        self.words = np.array([h for h, _ in known], np.uint64)
        number = {w: i for i, (_, w) in enumerate(known)}
        sequences = [[number[w] for w in words] for words, _ in split]
        joined = [pairs(hashes[:-1], hashes[1:]) for _, hashes in split if len(hashes) > 1]
        self.neighbours = np.unique(np.concatenate(joined)) if joined else np.zeros(0, np.uint64)
        of_phrases = [pairs(hashes[:-1], hashes[1:]) for _, hashes in split[len(templates) :]]
        #: Two words alone are worth a look only if they are in a phrase; runs of templates are longer.
        self.phrase_pairs = np.unique(np.concatenate(of_phrases)) if of_phrases else np.zeros(0, np.uint64)
        self.labels = [label for _, label in templates]
        self.sizes = [len(s) for s in sequences[: len(templates)]]
        self.phrases = [(label, len(s)) for (_, label), s in zip(phrases, sequences[len(templates) :])]
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link = [0], [-1]
        for sequence in sequences:
            state = 0
            for symbol in sequence:
                state = self._extend(state, symbol)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.next]
        self.whole: list[list[int]] = [[] for _ in self.next]
        by_length = sorted(range(1, len(self.next)), key=lambda s: -self.length[s])
        for t, sequence in enumerate(sequences):
            state = 0
            for place, symbol in enumerate(sequence):
                state = self.next[state][symbol]
                if t < len(templates):
                    self.ends[state].append((t, place + 1))
            if t >= len(templates):
                self.whole[state].append(t - len(templates))
        for state in by_length:
            self.ends[self.link[state]].extend(self.ends[state])
        for state in reversed(by_length):
            self.whole[state] = self.whole[state] + self.whole[self.link[state]]

    def _new(self, length: int, link: int, following: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(following)
        return len(self.length) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """A state for the runs to `target` that are as short as those coming from `state`."""
        copy = self._new(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        target = self.next[last].get(symbol)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, symbol, target)
        made, state = self._new(self.length[last] + 1, 0, {}), last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = made
            state = self.link[state]
        if state >= 0:
            target = self.next[state][symbol]
            fits = self.length[target] == self.length[state] + 1
            self.link[made] = target if fits else self._split(state, symbol, target)
        return made

    def statistics(self, symbols: Sequence[int]) -> Iterator[tuple[int, int]]:
        """For each word the state and length of the longest run of the templates that ends there."""
        state = length = 0
        for symbol in symbols:
            while state and symbol not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if symbol in self.next[state]:
                state = self.next[state][symbol]
                length += 1
            yield state, length

    def stretches(self, words: Words, hashes: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """Row, first word and word numbers of the stretches whose neighbours all occur in a template."""
        if len(hashes) < 2 or len(self.neighbours) == 0:
            return
        keys = pairs(hashes[:-1], hashes[1:])
        at = np.minimum(np.searchsorted(self.neighbours, keys), len(self.neighbours) - 1)
        joined = self.neighbours[at] == keys
        rows = words.rows()
        joined &= rows[1:] == rows[:-1]
        alone = joined.copy()
        alone[1:] &= ~joined[:-1]
        alone[:-1] &= ~joined[1:]
        joined[alone] = np.isin(keys[alone], self.phrase_pairs)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], joined.astype(np.int8), [0]])))
        for first, last in zip(edges[::2], edges[1::2]):
            numbers = np.searchsorted(self.words, hashes[first : last + 1])
            yield int(rows[first]), int(first), numbers.tolist()


class Chains:
    """Chains of long matches in one text, at most one open per template."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton
        self.open: dict[int, list[int]] = {}  # template -> first word, end, place in the template, words covered
        self.spans: list[tuple[int, int, int, float]] = []  # first word, template, words, coverage
        self.covered: dict[tuple[int, int, int, float], int] = {}
        self.best = 0.0

    def add(self, first: int, end: int, state: int) -> None:
        """The words [first, end) of the text stand in the templates of `state`."""
        size = end - first
        places: dict[int, list[int]] = {}
        for template, place in self.automaton.ends[state]:
            places.setdefault(template, []).append(place)
        for template, ends in places.items():
            chain = self.open.get(template)
            if chain and first - chain[1] <= MAX_GAP:
                after = [p for p in ends if p > chain[2]]
                if after:
                    gained = min(size, min(after) - chain[2], end - chain[1])
                    if gained > 0:
                        chain[1], chain[2] = end, min(after)
                        chain[3] += gained
                        continue
                if end <= chain[1]:
                    continue
            self.close(template)
            self.open[template] = [first, end, min(ends), size]

    def close(self, template: int) -> None:
        chain = self.open.pop(template, None)
        if chain:
            size = self.automaton.sizes[template]
            coverage = chain[3] / size
            self.best = max(self.best, coverage)
            if coverage >= (LABEL_COVERAGE if size >= SHORT else 1):
                span = (chain[0], template, chain[1] - chain[0], coverage)
                self.spans.append(span)
                self.covered[span] = chain[3]

    def finish(self) -> None:
        """Closes all chains and lets the spans compete; what stays is in order."""
        for template in list(self.open):
            self.close(template)
        won: list[tuple[int, int, int, float]] = []
        for span in sorted(self.spans, key=lambda s: (-self.covered[s], -s[3], s)):
            first, template, n, _ = span
            label = self.automaton.labels[template]
            taken = np.zeros(n, bool)
            for other in won:
                if self.automaton.labels[other[1]] != label:
                    taken[max(other[0] - first, 0) : max(other[0] + other[2] - first, 0)] = True
            if not taken.any() or n - taken.sum() >= OWN_SHARE * n:
                won.append(span)
        self.spans = sorted(won)


def scan_words(automaton: Automaton, words: Words) -> tuple[dict[int, list[tuple[int, int]]], dict[int, Chains]]:
    """Per row the base phrases (first word, phrase), and the chains."""
    base: dict[int, list[tuple[int, int]]] = {}
    chains: dict[int, Chains] = {}
    for row, begin, numbers in automaton.stretches(words, words.hashes()):
        begin -= int(words.first[row])
        before = (0, 0)
        for place, (state, length) in enumerate([*automaton.statistics(numbers), (0, 0)]):
            for phrase in automaton.whole[state] if length else ():
                size = automaton.phrases[phrase][1]
                if size <= length:
                    base.setdefault(row, []).append((begin + place + 1 - size, phrase))
            if length <= before[1] and before[1] >= MIN_MATCH:
                end = begin + place
                chains.setdefault(row, Chains(automaton)).add(end - before[1], end, before[0])
            before = (state, length)
    return base, chains


def scan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = BASE_PHRASES,
) -> DataFrame:
    """Per row of `docs`: id, n_words, base places, labels, score and the template spans."""
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(templates, phrases))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = automaton.value
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                words = split_words(LOWER[data], offsets, ALPHANUMERIC)
                base, chains = scan_words(known, words)
                rows = []
                for row in range(high - low):
                    places = base.get(row, [])
                    found = chains.get(row) or Chains(known)
                    found.finish()
                    base_labels = {known.phrases[p][0] for _, p in places}
                    spans = [
                        {"label": known.labels[t], "first_word": first, "n_words": n, "coverage": share}
                        for first, t, n, share in found.spans
                    ]
                    rows.append(
                        {
                            "n_words": int(words.counts[row]),
                            "n_base": len(places),
                            "first_word": min(places)[0] if places else None,
                            "last_word": max(places)[0] if places else None,
                            "base_labels": ",".join(sorted(base_labels)),
                            "labels": ",".join(sorted(base_labels | {s["label"] for s in spans})),
                            "score": 1.0 if places else found.best,
                            "spans": spans,
                        }
                    )
                result = pa.RecordBatch.from_pylist(rows, RESULT)
                ids = batch.column("id").slice(low, high - low)
                yield pa.RecordBatch.from_arrays([ids, *result.columns], [id_column, *result.schema.names])

    plain = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return map_arrow(plain, label, f"`{id_column}` {docs.schema[id_column].dataType.simpleString()}, {RESULT_DDL}")


SPAN = pa.struct(
    [("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("coverage", pa.float64())]
)
RESULT = pa.schema(
    [
        ("n_words", pa.int64()),
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        ("spans", pa.list_(SPAN)),
    ]
)
RESULT_DDL = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
    "score double, spans array<struct<label: string, first_word: bigint, n_words: bigint, coverage: double>>"
)

"""Plain Python versions of the operators' contracts, and documents with every odd case."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)


def white_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def shingles(text):
    words = white_words((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def groups(rows):
    """Component (smallest id) and set size of (id, text) rows, in order; null ids never name a group."""
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, found in enumerate(sets):
        shared = Counter(j for shingle in found for j in holders.get(shingle, ()))
        for j, n in shared.items():
            if 100 * n >= 75 * (len(found) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for shingle in found:
            holders.setdefault(shingle, []).append(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return [(len(s), least.get(root(i)) if s else rows[i][0]) for i, s in enumerate(sets)]


def links(rows):
    """Number of other rows linked with each of (id, text) rows, in order."""
    sets = [shingles(text) for _, text in rows]
    holders = {}
    for i, found in enumerate(sets):
        for shingle in found:
            holders.setdefault(shingle, []).append(i)
    counts = []
    for i, found in enumerate(sets):
        shared = Counter(j for shingle in found for j in holders[shingle] if j != i)
        counts.append(sum(100 * n >= 75 * (len(found) + len(sets[j]) - n) for j, n in shared.items()))
    return counts


def repeats(rows, length=50):
    """n_bytes, n_removed, n_spans, kept_sha256 of (id, text) rows, in order."""
    first = {}
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1 if key is not None else 0):
            string = data[i : i + length]
            first[string] = min(key, first.get(string, key))
    found = []
    for key, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        end = 0
        for i in range(len(data) - length + 1 if key is not None else 0):
            if first[data[i : i + length]] < key:
                for j in range(max(i, end), i + length):
                    gone[j] = True
                end = i + length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        found.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return found


def hits(text, items, width=10):
    """n_words, n_hit, n_items, items_sha256, contaminated."""
    words = plain_words(text)
    hit, names = set(), set()
    for item, content in items:
        wanted = plain_words(content)
        n = min(width, len(wanted))
        for i in range(len(wanted) - n + 1 if wanted else 0):
            window = wanted[i : i + n]
            for at in range(len(words) - n + 1):
                if words[at] == window[0] and words[at : at + n] == window:
                    hit.update(range(at, at + n))
                    names.add("" if item is None else str(item))
    digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return len(words), len(hit), len(names), digest, bool(hit)


def licence_base(text):
    """n_words, n_base, first_word, last_word, base_labels."""
    words = plain_words(text)
    places, labels = [], set()
    for phrase, label in PHRASES:
        wanted = phrase.split()
        for at in range(len(words) - len(wanted) + 1):
            if words[at : at + len(wanted)] == wanted:
                places.append(at)
                labels.add(label)
    ends = (min(places), max(places)) if places else (None, None)
    return len(words), len(places), *ends, ",".join(sorted(labels))


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = white_words(text)
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if white_words(line):
            dup += line in lines
            lines.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return len(words), sum(map(len, words)), symbols, dup, len(again), failed


def url(text):
    """host, path, rule, ruled."""
    host = path = ""
    if text and "://" in text:
        rest = text.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
    fits = [
        (len(h + p), h + p, kind)
        for kind, h, p in RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def search(documents, items, k=20):
    """(item_id, rank, doc_id, score) of (id, text) documents and items."""
    counts = [Counter(terms(text)) for _, text in documents]
    df = Counter(term for found in counts for term in found)
    n_docs, n_terms = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    found = []
    for item, content in items:
        wanted, scored = Counter(terms(content)), []
        for (key, _), tf in zip(documents, counts):
            m = 100 - 25 + (25 * sum(tf.values()) * n_docs) // max(n_terms, 1)
            score = sum(c * weights[t] * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, c in wanted.items() if tf[t])
            if score > 0:
                scored.append((-score, key is not None, key))
        ranked = sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k]
        found += [(item, rank, key, -score) for rank, (score, _, key) in enumerate(ranked, 1)]
    return found


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """All levels of nodes, and per leaf its steps upwards: the other node of its run, or None, and the node's number."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    paths = []
    for i in range(len(nodes)):
        numbers = [(level, i >> n) for n, level in enumerate(levels[:-1])]
        paths.append([(level[j ^ 1] if j ^ 1 < len(level) else None, j) for level, j in numbers])
    return levels[-1][0], paths


def manifest(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of (doc_id, source, lang, n_chars, text) rows."""
    groups = {}
    for row in rows:
        leaf = h(*map(field, row))
        changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
        claim = h(*map(field, (*row[:3], row[3] + 1, row[4]))) if changed else leaf
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf, claim, row[0]))
    order = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = [tree([leaf for _, _, leaf, _, _ in sorted(groups[lang])]) for lang in order]
    root, tops = tree([subroot for subroot, _ in trees]) if trees else (None, [])
    found = []
    for lang, (subroot, paths), top in zip(order, trees, tops):
        for (_, _, leaf, claim, key), path in zip(sorted(groups[lang]), paths):
            node = claim
            for sibling, number in path + top:
                pair = [node] if sibling is None else [node, sibling]
                node = h(*(reversed(pair) if number & 1 else pair))
            proof = h(*(sibling for sibling, _ in path + top if sibling))
            found.append((key, leaf, subroot, root, proof, node, node == root))
    return found


PASSAGE = "the quick brown fox jumps over the lazy dog while seven wise owls watch from old oak trees at dawn"
#: Words of equal length and letters whose polynomial hashes modulo powers of two are equal.
MORSE = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
BASE = " ".join(f"alpha{i}" for i in range(40))
#: id, text
ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b "),
    (4, "one"),
    (5, "One"),
    (6, "one two three four"),
    (7, PASSAGE),
    (8, PASSAGE),
    (8, PASSAGE),
    (9, PASSAGE.upper()),
    (10, f"prefix {PASSAGE} and more after it"),
    (11, f"{PASSAGE} {PASSAGE}"),
    (12, LONG),
    (13, LONG + " end"),
    (14, BASE),
    (15, BASE + " beta"),
    (16, BASE.replace("alpha20", "gamma")),
    (17, "é" * 60 + " ü" + "漢字 テスト" * 20),
    (18, "x" + "é" * 60 + " ü" + "漢字 テスト" * 20),
    (19, "12345 67890 --- !!!"),
    (20, "Licensed under CC BY-NC 4.0. All rights reserved. all rights reserved"),
    (21, "a\nb c\na\n\nb c\r\nb c"),
    (22, "a b c a b c a b c " * 40),
    (23, "### $$$ ||| <tag> & % *" + " word" * 60),
    (24, "no\x00null\x00words   em"),
    (26, "ab " * 400),
    (27, "zab " * 400),
    (None, PASSAGE + " with no id"),
    (None, None),
    (28, "single" * 5000),
    (29, "q" + "single" * 5000),
    (-5, PASSAGE + " negative"),
    (30, MORSE),
    (31, MORSE.translate(str.maketrans("ab", "ba"))),
    (32, f"{MORSE} {MORSE.translate(str.maketrans('ab', 'ba'))} {MORSE}\n{MORSE}"),
]

"""Nearest terms of words by matching blocks, with bounds over whole arrays of pairs.

``difflib`` measures a pair; what it counts is a common subsequence of both words.  So a
pair above a ratio has ``least_matches`` letters in common, three times that less the
length of both and one pairs of adjacent letters, and a common subsequence of that length.
The first or the second is counted for 64 terms at once, a bit of a number for each; the
third for what is left.  No pair above the ratio misses a bound.
"""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

#: Numbers of 64 terms counted at once, and pairs aligned at once.
COUNTED, PAIRS = 8_192, 50_000
#: Similarity from which two words count as the same.
SAME = 0.99
NTH = 1 << 20


def _letters(words: list[str], size: int) -> np.ndarray:
    return np.array(words, dtype=f"<U{size}").view(np.uint32).reshape(len(words), size)


def _nth(keys: np.ndarray) -> np.ndarray:
    """Each key with how often it stands before in its row, so that a row holds none twice."""
    before = [(keys[:, :i] == keys[:, i, None]).sum(axis=1) for i in range(keys.shape[1])]
    return keys * NTH + np.stack(before, axis=1)


class Slice:
    """Terms by length: sorted, their letters numbered, and which of them hold a letter or
    a pair of letters, a bit for each term."""

    def __init__(self, terms: list[str]) -> None:
        by: dict[int, list[str]] = {}
        for t in sorted(terms):
            by.setdefault(len(t), []).append(t)
        self.alphabet = np.array(sorted({ord(c) for t in terms for c in t}), dtype=np.uint32)
        self.lengths = {}
        for size, names in by.items():
            n = self.numbered(_letters(names, size))
            self.lengths[size] = (names, n, *(self._held(x, len(names)) for x in self.features(n)))

    def numbered(self, letters: np.ndarray) -> np.ndarray:
        """Places in the alphabet; what it does not hold stands behind its end."""
        at = np.searchsorted(self.alphabet, letters)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == letters, at, len(self.alphabet)).astype(np.int64)

    def features(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nth(n), _nth(n[:, :-1] * (len(self.alphabet) + 1) + n[:, 1:])

    @staticmethod
    def _held(features: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
        known, at = np.unique(features, return_inverse=True)
        bits = np.zeros((len(known) + 1, -(-terms // 64) * 64), dtype=bool)  # the last row for features of no term
        bits[at.reshape(features.shape), np.arange(terms)[:, None]] = True
        return known, np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def least_matches(ratio: float, letters: int) -> int:
    """Matching letters that the ratio needs of two words with so many letters."""
    m = max(0, int(ratio * letters / 2) - 1)
    while 2.0 * m / letters < ratio:
        m += 1
    return m


def _at_least(held: np.ndarray, at: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``at``, term) where the term holds ``least`` of the row's features."""
    levels: list[list[np.ndarray]] = [[]]
    digits = []
    for k in range(at.shape[1]):
        levels[0].append(held[at[:, k]])
        level = 0
        while len(levels[level]) == 3:  # full adder: three numbers of one weight to one, and one of twice the weight
            x, y, z = levels[level]
            half = x ^ y
            levels[level] = [half ^ z]
            if level + 1 == len(levels):
                levels.append([])
            levels[level + 1].append((x & y) | (half & z))
            level += 1
    level = 0
    while level < len(levels):
        row = levels[level]
        if len(row) == 2:
            if level + 1 == len(levels):
                levels.append([])
            levels[level + 1].append(row[0] & row[1])
            row = [row[0] ^ row[1]]
        elif len(row) == 3:
            half = row[0] ^ row[1]
            if level + 1 == len(levels):
                levels.append([])
            levels[level + 1].append((row[0] & row[1]) | (half & row[2]))
            row = [half ^ row[2]]
        digits.append(row[0] if row else None)
        level += 1
    if least >= 1 << len(digits):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    enough = np.full((len(at), held.shape[1]), ~np.uint64(0))
    for k, d in enumerate(digits):
        if least >> k & 1:
            enough = enough & d if d is not None else np.zeros_like(enough)
        elif d is not None:
            enough |= d
    i, j = np.nonzero(enough)
    r, bit = np.nonzero(np.unpackbits(enough[i, j].view(np.uint8), bitorder="little").reshape(-1, 64))
    return i[r], j[r] * 64 + bit


def _common(where: np.ndarray, size: int, i: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of the words ``i`` (of up to 64 letters,
    ``where``: their places of each letter as bits) and the terms, bit-parallel."""
    full = np.uint64((1 << size) - 1)
    v = np.full(len(i), full, dtype=np.uint64)
    for k in range(terms.shape[1]):
        u = v & where[i, terms[:, k]]
        v = (v + u) | (v - u)
    return size - np.bitwise_count(v & full).astype(np.int64)


def nearest(sent, min_ratio: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``word, term, r`` for batches of words: the most similar term of the slice."""

    def of_length(words: list[str], size: int, terms: Slice) -> Iterator[tuple[str, str, float]]:
        numbered = terms.numbered(_letters(words, size))
        features = terms.features(numbered)
        found: list[tuple[float, str]] = [(0.0, "")] * len(words)
        floor = np.full(len(words), min_ratio)
        measure = difflib.SequenceMatcher(None)
        for n in sorted(terms.lengths, key=lambda n: abs(n - size)):
            if least_matches(min_ratio, size + n) > min(size, n):
                continue
            names, theirs, *held = terms.lengths[n]
            step = max(1, COUNTED * 64 // len(names))
            for start in range(0, len(words), step):
                block = slice(start, start + step)
                need = np.ceil(floor[block] * (size + n) / 2 - 1e-9).astype(np.int64)
                least = int(need.min())
                if least > min(size, n):
                    continue
                pairs = 3 * least - size - n - 1
                by_pairs = pairs * 3 >= size
                known, bits = held[by_pairs]
                asked = features[by_pairs][block]
                at = np.searchsorted(known, asked)
                at[at == len(known)] = 0
                i, j = _at_least(bits, np.where(known[at] == asked, at, len(known)), pairs if by_pairs else least)
                if not len(i):
                    continue
                if size <= 64:
                    where = np.zeros((len(need), len(terms.alphabet) + 1), dtype=np.uint64)
                    for k in range(size):
                        where[np.arange(len(need)), numbered[block][:, k]] |= np.uint64(1 << k)
                    where[:, -1] = 0
                    common = np.concatenate([_common(where, size, i[p : p + PAIRS], theirs[j[p : p + PAIRS]]) for p in range(0, len(i), PAIRS)])
                else:
                    common = np.full(len(i), min(size, n))
                kept = common >= need[i]
                i, j, common = i[kept], j[kept], common[kept]
                order = np.lexsort((j, -common, i))
                for x, y, c in zip(i[order].tolist(), j[order].tolist(), common[order].tolist(), strict=True):
                    best, name = found[start + x]
                    most = 2.0 * c / (size + n)
                    if most < best or (most == best and names[y] > name):
                        continue
                    measure.set_seqs(words[start + x], names[y])
                    r = measure.ratio()
                    if min_ratio <= r < SAME and (r > best or (r == best and names[y] < name)):
                        found[start + x] = (r, names[y])
                        floor[start + x] = r
        return ((w, t, r) for w, (r, t) in zip(words, found, strict=True) if t)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms = sent.value
        for b in batches:
            by: dict[int, list[str]] = {}
            for w in b["word"] if terms.lengths else []:
                by.setdefault(len(w), []).append(w)
            yield pd.DataFrame([x for size, words in by.items() for x in of_length(words, size, terms)], columns=["word", "term", "r"])

    return run

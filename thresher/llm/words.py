"""Words of whole text columns as byte spans, for operators that look words of
many documents up in a bounded table of their queries' words.

A word here is a maximal run of ASCII letters, digits and non-ASCII code
points, A-Z lower-cased.  In UTF-8 that is a run of bytes, so spans come from
one table lookup per byte."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from thresher.llm.shared import mix64, text_bytes

_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _WORD[_lo:_hi] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_PREFILTER_BITS = 20

#: The same words as a regular expression, for texts that are already lower-cased.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER_TEXT, LOWER_TEXT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes; texts don't join."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begins = np.zeros(len(inside) + 1, bool)
    begins[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | begins[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | begins[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and rows of all words of the texts, in order."""
    starts, ends = runs(_WORD[data], offsets)
    return starts, ends - starts, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(lowered: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word."""
    if not len(starts):
        return np.empty(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), _BASE, np.uint64), dtype=np.uint64)
    letters = lowered[place + np.repeat(starts, lengths)].astype(np.uint64) + np.uint64(1)
    return mix64(np.add.reduceat(letters * powers[place], first) + lengths.astype(np.uint64))


def same_bytes(a: np.ndarray, at_a: np.ndarray, b: np.ndarray, at_b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether a[at_a:at_a + n] and b[at_b:at_b + n] hold the same, per pair (n >= 1)."""
    if not len(lengths):
        return np.empty(0, bool)
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    return np.logical_and.reduceat(a[place + np.repeat(at_a, lengths)] == b[place + np.repeat(at_b, lengths)], first)


class HashTable:
    """Sorted distinct 64-bit keys, with a bit per key's top bits before the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys  # sorted, distinct
        self._shift = np.uint64(64 - _PREFILTER_BITS)
        self._may = np.zeros(1 << _PREFILTER_BITS, bool)
        self._may[keys >> self._shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in `hashes` of the keys, and which key each is."""
        if not len(self.keys):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(self._may[hashes >> self._shift])
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        same = self.keys[key] == hashes[at]
        return at[same], key[same]


class Vocabulary:
    """Distinct words as bytes; a word's id is its place among the sorted hashes.
    Words are compared by their bytes.  (Two listed words of equal hash would
    need a second table; that is refused, so no answer is ever wrong.)"""

    def __init__(self, words: list[str]):
        self.data, offsets = text_bytes(pa.array(words, pa.large_string()))
        lengths = np.diff(offsets)
        hashes = word_hashes(self.data, offsets[:-1], lengths)
        order = np.argsort(hashes, kind="stable")
        self.table = HashTable(hashes[order])
        if len(order) and (np.diff(self.table.keys) == 0).any():
            raise ValueError("two words of the vocabulary share a 64-bit hash")
        self.starts, self.lengths = offsets[:-1][order], lengths[order]
        self.words = [words[i] for i in order]

    def find(self, lowered: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the spans are words of the vocabulary, and their ids."""
        at, word = self.table.find(word_hashes(lowered, starts, lengths))
        same = lengths[at] == self.lengths[word]
        at, word = at[same], word[same]
        same = same_bytes(lowered, starts[at], self.data, self.starts[word], lengths[at])
        return at[same], word[same]

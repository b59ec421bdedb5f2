"""Exact numbers for the words of whole blocks: hashes sort them, their bytes decide."""
from __future__ import annotations

import numpy as np

from barflow.llm.blocks import span_hashes

SMALL = np.arange(256, dtype=np.uint8)
SMALL[65:91] += 32


def equal_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether bytes ``data[starts:ends]`` equal ``other[at:to]``, pair by pair."""
    size = ends - starts
    same = size == to - at
    which = np.flatnonzero(same & (size > 0))
    size = size[which]
    if not len(which):
        return same
    first = np.cumsum(size) - size
    step = np.arange(size.sum()) - np.repeat(first, size)
    differ = data[np.repeat(starts[which], size) + step] != other[np.repeat(at[which], size) + step]
    same[which] = np.add.reduceat(differ, first, dtype=np.int64) == 0
    return same


class Lexicon:
    """Numbers of the words met so far, in the order in which they came. A closed one gives -1 for words it does not hold."""

    def __init__(self, words: list[bytes] = (), closed: bool = False):
        self.words, self.number, self.closed = list(words), {w: i for i, w in enumerate(words)}, closed

    def _add(self, word: bytes) -> int:
        if self.closed:
            return self.number.get(word, -1)
        n = self.number.setdefault(word, len(self.words))
        if n == len(self.words):
            self.words.append(word)
        return n

    def numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
        """Number of each span of ``data`` (lower-cased by the caller, if at all). Spans of equal hashes are compared byte by byte with one of them."""
        if not len(starts):
            return np.zeros(0, np.int64)
        hashes = span_hashes(data, starts, ends) if hashes is None else hashes
        _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        known = np.array([self._add(raw[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist())], np.int64)
        out = known[back]
        shown = first[back]
        for i in np.flatnonzero(~equal_spans(data, starts, ends, data, starts[shown], ends[shown])):
            out[i] = self._add(raw[starts[i]:ends[i]])
        return out

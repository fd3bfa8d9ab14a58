"""A compressed full-text index over a sequence of symbols: Burrows-Wheeler transform, wavelet matrix, backward search.

All searches advance together, one symbol a step, so that numpy does the work.
"""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of symbols sorted by their first `depth` symbols or more (prefix doubling)."""
    n = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order, done = np.argsort(rank, kind="stable"), 1
    while done < depth and n:
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - done)] = rank[done:] + 1
        key = rank * np.int64(n + 1) + after
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank[order] = fresh
        done *= 2
        if fresh[-1] == n - 1:
            break
    return order


class WaveletMatrix:
    """Ranks of symbols 0 .. size - 1 in a sequence, on one packed bit vector for each bit of the symbols."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        n, now = len(symbols), symbols
        self.start = np.zeros(size, dtype=np.int64)
        ends = np.arange(size)
        for shift in range(max(1, (size - 1).bit_length()) - 1, -1, -1):
            bit = (now >> shift & 1).astype(bool)
            words = np.zeros(n // 64 + 1, dtype=np.uint64)
            packed = np.packbits(bit, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])[:-1]
            zeros = n - int(bit.sum())
            self.levels.append((shift, words, before, zeros))
            self.start = self._down(len(self.levels) - 1, ends, self.start)
            now = np.concatenate([now[~bit], now[bit]])

    def _down(self, level: int, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        shift, words, before, zeros = self.levels[level]
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        ones = before[word] + np.bitwise_count(words[word] & below)
        return np.where(symbols >> shift & 1, zeros + ones, at - ones)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each of symbols occurs before the position at."""
        for level in range(len(self.levels)):
            at = self._down(level, symbols, at)
        return at - self.start[symbols]


class FMIndex:
    """Counts, by weight, the places of a sequence that a pattern of up to `depth` symbols starts at.

    Symbol 0 ends pieces of the sequence and the sequence itself; patterns don't have it.
    """

    def __init__(self, symbols: np.ndarray, weights: np.ndarray, depth: int):
        if not len(symbols) or symbols[-1]:
            raise ValueError("the sequence must end with symbol 0")
        self.symbols = symbols.astype(np.int64)
        order = suffix_order(self.symbols, depth)
        size = int(self.symbols.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.symbols, minlength=size))]).astype(np.int64)
        self.tree = WaveletMatrix(self.symbols[order - 1], size)
        self.heavy = np.concatenate([[0], np.cumsum(weights[order])]).astype(np.int64)

    def matching(self, ends: np.ndarray, longest: int, least: int = 2) -> np.ndarray:
        """Matching statistics: for each end, the length up to `longest` of the longest piece of the sequence ending
        there that has weight `least` or more in the index."""
        length = np.zeros(len(ends), dtype=np.int64)
        alive = np.arange(len(ends))
        low, high = np.zeros(len(ends), dtype=np.int64), np.full(len(ends), len(self.symbols), dtype=np.int64)
        for step in range(longest):
            c = self.symbols[ends[alive] - step]
            both = self.tree.rank(np.concatenate([c, c]), np.concatenate([low, high])) + np.concatenate([self.first[c]] * 2)
            low, high = both[: len(c)], both[len(c) :]
            stay = self.heavy[high] - self.heavy[low] >= least
            alive, low, high = alive[stay], low[stay], high[stay]
            length[alive] = step + 1
            if not len(alive):
                break
        return length

"""A compressed full-text index over words: the Burrows-Wheeler transform in a wavelet matrix, for many searches at once.

The words of an index are numbered; the matrix keeps one packed bit a word and
level, with a running count every 64 bits. Suffixes are sorted by their first
``depth`` words, which is enough for patterns up to that length.
"""

from __future__ import annotations

import numpy as np


class FMIndex:
    """Over segments (arrays of 64-bit word hashes), each closed by a mark that no pattern holds."""

    def __init__(self, segments: list[np.ndarray], depth: int):
        self.depth = depth
        flat = np.concatenate(segments)
        known, ids = np.unique(flat, return_inverse=True)
        n = np.array([len(s) for s in segments])
        self.starts = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
        self.text = np.zeros(int((n + 1).sum()), np.int64)
        self.text[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = ids + 1
        self.levels = max(1, int(len(known)).bit_length())
        order = self._sorted()
        self._matrix(self.text[order - 1])
        counts = np.bincount(self.text, minlength=len(known) + 1)
        symbols = np.arange(len(known) + 1)
        below = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.base = below - self._down(symbols, np.zeros(len(symbols), np.int64))

    def _sorted(self) -> np.ndarray:
        """Places in the order of what stands there, by ranks of runs of 1, 2, 4 ... words."""
        rank, n, size = self.text, 1, len(self.text)
        while n < self.depth:
            after = np.zeros(size, np.int64)
            after[:-n] = rank[n:] + 1 if n < size else after[:-n]
            key = rank * (int(rank.max()) + 2) + after
            order = np.argsort(key, kind="stable")
            step = np.empty(size, np.int64)
            step[0] = 0
            step[1:] = key[order][1:] != key[order][:-1]
            new = np.empty(size, np.int64)
            new[order] = np.cumsum(step)
            rank, n = new, 2 * n
            if rank.max() == size - 1:
                break
        return np.argsort(rank, kind="stable")

    def _matrix(self, bwt: np.ndarray) -> None:
        self.words, self.before, self.zeros = [], [], []
        x = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (x >> level) & 1
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
            padded[:len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]]).astype(np.uint32))
            self.zeros.append(int(len(bit) - bit.sum()))
            x = np.concatenate([x[bit == 0], x[bit == 1]])

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where places of the transform lead, level by level, if each holds the symbol asked for there."""
        one = np.uint64(1)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            mask = (one << (at & 63).astype(np.uint64)) - one
            ones = self.before[k][word] + np.bitwise_count(self.words[k][word] & mask).astype(np.int64)
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def longest(self, ends: np.ndarray, least: int, most: int) -> np.ndarray:
        """For places of the text: how many words before each, ``most`` at the most, occur ``least`` times or oftener.

        Backward search of all places together; a place drops out as soon as its words are too rare.
        """
        out = np.zeros(len(ends), np.int64)
        live = np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.text), np.int64)
        for n in range(1, min(most, self.depth) + 1):
            at = ends[live] - n
            c = np.where(at >= 0, self.text[at], 0)
            lo, hi = self.base[c] + self._down(c, lo), self.base[c] + self._down(c, hi)
            fit = (c > 0) & (hi - lo >= least)
            live, lo, hi = live[fit], lo[fit], hi[fit]
            if not len(live):
                break
            out[live] = n
        return out

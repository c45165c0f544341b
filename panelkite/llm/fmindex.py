"""A compressed full-text index over symbol sequences: wavelet matrix of the transform, ranks by bit counts."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank: 64-bit words and the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        padded = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        padded[: len(packed)] = packed
        self.words = padded.view(np.uint64)
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first ``at`` bits."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    def __init__(self, values: np.ndarray, alphabet: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(max(1, int(alphabet - 1).bit_length()) - 1, -1, -1):
            bits = (values >> shift) & 1 == 1
            zeros = int(len(bits) - bits.sum())
            self.levels.append((shift, Bits(bits), zeros))
            values = np.concatenate([values[~bits], values[bits]])
        self.start = np.zeros(alphabet, np.int64)
        if len(values):
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            self.start[values[first]] = first

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol among the first ``at`` values."""
        place = at
        for shift, bits, zeros in self.levels:
            ones = bits.rank(place)
            place = np.where((symbol >> shift) & 1 == 1, zeros + ones, place - ones)
        return place - self.start[symbol]


class FMIndex:
    """Index of texts laid end to end, each closed by the symbol 0; texts hold symbols from 1 on.

    Suffixes are sorted by their first 16 symbols, which is all that a search up to that depth looks at.
    """

    DEPTH = 16

    def __init__(self, text: np.ndarray, window: int):
        if not 8 <= window < self.DEPTH:
            raise ValueError("windows of 8 to 15 symbols are indexed")
        n = len(text)
        self.alphabet = int(text.max(initial=0)) + 1
        order = text.astype(np.int64)
        half = order
        for step in (1, 2, 4, 8):
            if step == 8:
                half = order  # ranks by the first 8 symbols
            ahead = np.zeros(n, np.int64)
            ahead[: n - step] = order[step:] + 1
            order = np.unique(order * (n + self.alphabet + 1) + ahead, return_inverse=True)[1]
        self.suffixes = np.argsort(order, kind="stable")
        counts = np.bincount(text, minlength=self.alphabet)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        self.transform = WaveletMatrix(text[self.suffixes - 1].astype(np.int64), self.alphabet)
        # Suffixes that share their first ``window`` symbols stand together: two overlapping blocks of 8 agree.
        later = np.minimum(self.suffixes + window - 8, n - 1)
        a, b = half[self.suffixes], half[later]
        new = np.ones(n, bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        self.group = np.cumsum(new) - 1
        self.group_start = np.flatnonzero(new)
        self.group_end = np.append(self.group_start[1:], n)
        self.window = window

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the interval of a match with one more symbol before it."""
        base = self.smaller[symbol]
        return base + self.transform.rank(symbol, low), base + self.transform.rank(symbol, high)

    def matches(self, symbols: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Matching statistics of streamed texts, held at ``window`` symbols.

        Texts are given by their end and length in ``symbols`` and read backwards side by side. Returns, step by step,
        (text, window start in symbols, group of equal suffixes) of every window that occurs in the index.
        """
        by_length = np.argsort(-lengths, kind="stable")
        ends, lengths = ends[by_length], lengths[by_length]
        low = np.zeros(len(ends), np.int64)
        high = np.full(len(ends), len(self.suffixes), np.int64)
        depth = np.zeros(len(ends), np.int64)
        out = []
        for step in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths, -step, "left"))  # texts longer than the steps so far
            at = ends[:live] - 1 - step
            new_low, new_high = self.extend(symbols[at], low[:live], high[:live])
            lost = new_low >= new_high  # the match breaks: begin anew before this symbol
            low[:live] = np.where(lost, 0, new_low)
            high[:live] = np.where(lost, len(self.suffixes), new_high)
            depth[:live] = np.where(lost, 0, depth[:live] + 1)
            full = np.flatnonzero(depth[:live] >= self.window)
            if len(full):
                group = self.group[low[full]]
                low[full], high[full] = self.group_start[group], self.group_end[group]
                depth[full] = self.window
                out.append((by_length[full], at[full], group))
        return out

"""A compressed full-text index over sequences of word numbers: suffix order, wavelet matrix, backward search."""
from __future__ import annotations

import numpy as np

#: Suffixes are ordered by this many symbols, which is enough to search patterns of up to as many.
DEPTH = 16


def suffix_order(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Start places ordered by their first ``depth`` symbols (prefix doubling); what follows doesn't matter for shorter patterns."""
    rank = text.astype(np.int64)
    n = len(rank)
    order = np.argsort(rank, kind="stable")
    k = 1
    while k < depth:
        after = np.zeros(n, np.int64)
        after[:n - k] = rank[k:] + 1
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))[:n]
        if n and rank[order[-1]] == n - 1:
            break
        k *= 2
    return order


class WaveletMatrix:
    """Symbols as one packed bit vector per binary digit, each with counts per 64 bits."""

    def __init__(self, symbols: np.ndarray):
        self.n = len(symbols)
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now = symbols.astype(np.uint32)
        for b in range(self.bits - 1, -1, -1):
            one = (now >> np.uint32(b)) & np.uint32(1)
            packed = np.packbits(one.astype(np.uint8), bitorder="little")
            words = np.zeros(self.n // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            self.words.append(words)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]))
            up = one.astype(bool)
            self.zeros.append(self.n - int(up.sum()))
            now = np.concatenate([now[~up], now[up]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the first ``at`` symbols end among the occurrences of ``symbol``; less the value for 0 it is a rank."""
        for level in range(self.bits):
            word = at >> 6
            low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[level][word] + np.bitwise_count(self.words[level][word] & low)
            up = (symbol >> (self.bits - 1 - level)) & 1 == 1
            at = np.where(up, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Backward search over a text of symbols 0 to ``n_symbols - 1``; 0 ends the text and occurs in no pattern."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        self.order = suffix_order(text)
        before = text[self.order - 1]
        self.tree = WaveletMatrix(before)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        every = np.arange(n_symbols)
        self.shift = self.first[:-1] - self.tree.place(every, np.zeros(n_symbols, np.int64))

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffix order that begin with each row of ``patterns`` (at most ``DEPTH`` symbols long), read from right to left.

        Rows that occur nowhere end with an empty range.
        """
        last = patterns[:, -1]
        low, high = self.first[last], self.first[last + 1]
        n = len(patterns)
        for j in range(patterns.shape[1] - 2, -1, -1):
            symbol = patterns[:, j]
            both = self.tree.place(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = both[:n] + self.shift[symbol], both[n:] + self.shift[symbol]
        return low, high

"""An FM-index over integer symbols: suffix order, wavelet-matrix ranks, sampled positions.

Symbol 0 separates sequences; every separator is its own letter, ordered by
place, so no match crosses one and the suffix order is total.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text``, whose last symbol is a separator; only suffixes still tied are sorted again."""
    n = len(text)
    separators = np.flatnonzero(text == 0)
    first = text.astype(np.int64) + len(separators)
    first[separators] = np.arange(len(separators))
    order = np.argsort(first, kind="stable")
    seen = first[order]
    rank = np.empty(n, np.int64)
    heads = np.concatenate([[True], seen[1:] != seen[:-1]])
    rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
    tied = np.flatnonzero(~heads | ~np.append(heads[1:], True))
    depth = 1
    while len(tied):
        suffix = order[tied]
        key = rank[suffix] << 32 | rank[suffix + depth]
        by = np.argsort(key, kind="stable")
        key, suffix = key[by], suffix[by]
        order[tied] = suffix
        heads = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffix] = np.maximum.accumulate(np.where(heads, tied, 0))
        tied = tied[~heads | ~np.append(heads[1:], True)]
        depth *= 2
    return order


class Bits:
    """A bit vector with constant-time ranks: 64-bit words and the counts before them."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[:len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    """Ranks of every symbol of a sequence, one bit vector a level from the highest bit."""

    def __init__(self, sequence: np.ndarray, n_symbols: int):
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for level in reversed(range(self.depth)):
            ones = (sequence >> level) & 1 != 0
            self.levels.append((Bits(ones), len(sequence) - int(np.count_nonzero(ones))))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        self.origin = self._descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in zip(reversed(range(self.depth)), self.levels, strict=True):
            ones = bits.rank(at)
            at = np.where((symbol >> level) & 1 != 0, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._descend(symbol, at) - self.origin[symbol]

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and its occurrences before it."""
        symbol = np.zeros(len(at), np.int64)
        for bits, zeros in self.levels:
            one = bits.get(at)
            ones = bits.rank(at)
            symbol = symbol << 1 | one
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.origin[symbol]


class FMIndex:
    def __init__(self, text: np.ndarray, n_symbols: int):
        """``text`` ends with a separator and has symbols below ``n_symbols``."""
        order = suffix_order(text)
        before = np.concatenate([[0], text[:-1]])  # the first suffix has a separator before it
        bwt = before[order]
        self.below = np.zeros(n_symbols + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=n_symbols), out=self.below[1:])
        self.wavelet = WaveletMatrix(bwt, n_symbols)
        sampled = (order % SAMPLE == 0) | (bwt == 0)  # starts of sequences too: no walk leaves one
        self.marks = Bits(sampled)
        self.samples = order[sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns (rows of a matrix, ``lengths`` symbols each), by backward search."""
        return self.search_spans(patterns.ravel(), np.arange(len(patterns)) * patterns.shape[1], lengths)

    def search_spans(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns that stand in ``symbols`` from ``starts`` on."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.below[-1])
        alive = np.flatnonzero(lengths > 0)
        for step in range(int(lengths.max(initial=0))):
            alive = alive[(lengths[alive] > step) & (low[alive] < high[alive])]
            if not len(alive):
                break
            symbol = symbols[starts[alive] + lengths[alive] - 1 - step].astype(np.int64)
            low[alive] = self.below[symbol] + self.wavelet.rank(symbol, low[alive])
            high[alive] = self.below[symbol] + self.wavelet.rank(symbol, high[alive])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled row."""
        at = rows.copy()
        walked = np.zeros(len(rows), np.int64)
        found = np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = at[open_]
            marked = self.marks.get(here)
            done = open_[marked]
            found[done] = self.samples[self.marks.rank(here[marked])] + walked[done]
            open_, here = open_[~marked], here[~marked]
            if len(open_):
                symbol, rank = self.wavelet.access_rank(here)
                at[open_] = self.below[symbol] + rank
                walked[open_] += 1
        return found

"""A compressed full-text index over word sequences: wavelet matrix and backward search.

The text is a list of records of 64-bit word symbols. Each record ends with its
own separator, smaller than all words, so no match crosses records and the
suffix order is settled by a record's length. The Burrows-Wheeler transform is
held as one packed bit vector per bit of the dense alphabet, with a count every
64 bits; a query touches only those and the C array.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class BitVector:
    """Packed bits with constant-time counts of ones before a position."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = (U64(1) << (at & 63).astype(U64)) - U64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Rank of any symbol of an integer sequence, one bit vector per level."""

    def __init__(self, sequence: np.ndarray, size: int):
        self.levels: list[BitVector] = []
        self.depth = max(1, int(size - 1).bit_length())
        for shift in range(self.depth - 1, -1, -1):
            bits = ((sequence >> shift) & 1).astype(np.uint8)
            self.levels.append(BitVector(bits))
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])
        self.zeros = [len(sequence) - x.ones for x in self.levels]
        self.base = self._descend(np.arange(size), np.zeros(size, np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in zip(range(self.depth - 1, -1, -1), self.levels, self.zeros, strict=True):
            ones = bits.rank(at)
            at = np.where((symbols >> shift) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._descend(symbols, at) - self.base[symbols]


class FMIndex:
    """Index of records; ``depths`` are the match lengths whose blocks are kept."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, threshold: int):
        self.threshold = threshold
        count = len(lengths)
        self.alphabet, dense = np.unique(words, return_inverse=True)
        ends = np.cumsum(lengths + 1)
        self.starts = ends - lengths - 1
        n = int(ends[-1]) if count else 0
        text = np.empty(n, np.int64)
        mark = np.zeros(n, bool)
        mark[ends - 1] = True
        text[mark] = np.arange(count)
        text[~mark] = dense + count
        self.suffixes, equal = self._sort(text, [threshold - 1, threshold])
        symbols = np.where(mark, 0, text - count + 1)
        self.lookup = symbols
        self.bwt = WaveletMatrix(symbols[self.suffixes - 1], len(self.alphabet) + 1)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=len(self.alphabet) + 1))])
        self.blocks = [np.append(np.flatnonzero(~np.append(False, same)), n) for same in equal]

    @staticmethod
    def _sort(text: np.ndarray, depths: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Suffix array, and for each depth whether neighbours share that many symbols."""
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64) if n else text
        kept, length = {1: rank}, 1
        order = np.argsort(rank, kind="stable")
        while n and rank[order].max() < n - 1:
            after = np.full(n, -1, np.int64)
            after[: n - length] = rank[length:] if length < n else []
            key = rank * (n + 1) + after + 1
            order = np.argsort(key, kind="stable")
            fresh = np.append(False, key[order][1:] != key[order][:-1])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            length *= 2
            kept[length] = rank
        out = []
        for depth in depths:
            base = max((x for x in kept if x <= depth), default=1)
            last = kept[base]
            a, b = order[:-1], order[1:]
            shift = depth - base
            inside = np.maximum(a, b) + shift < n
            same = inside & (last[a] == last[b])
            if base * 2 < depth:  # all suffixes already differ within 2*base symbols
                same &= False
            else:
                same[inside] &= last[a[inside] + shift] == last[b[inside] + shift]
            out.append(same)
        return order, out

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the suffix range of the symbol before each match."""
        start = self.less[symbols]
        return start + self.bwt.rank(symbols, low), start + self.bwt.rank(symbols, high)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of equally long patterns of word symbols (rows of a matrix)."""
        at = np.searchsorted(self.alphabet, patterns)
        known = at < len(self.alphabet)
        known[known] = self.alphabet[at[known]] == patterns[known]
        low = np.zeros(len(patterns), np.int64)
        high = np.where(known.all(axis=1), len(self.suffixes), 0)
        for k in range(patterns.shape[1] - 1, -1, -1):
            low, high = self.extend(np.where(known[:, k], at[:, k] + 1, 0), low, high)
            high = np.where(known.all(axis=1), high, low)
        return low, high

    def matching_windows(self, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Streams records through the index, right to left.

        A match that would exceed the threshold is first cut to one word less (the
        enclosing block of that depth), so each further word costs one backward
        step. Gives the text position of every window of ``threshold`` words and
        its suffix range, whose size is the number of occurrences.
        """
        k = self.threshold
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.suffixes), np.int64)
        at, left = starts + lengths, lengths.copy()
        found: list[tuple[np.ndarray, ...]] = []
        step = 0
        while len(at):
            if step >= k:
                block = np.searchsorted(self.blocks[0], low, side="right") - 1
                low, high = self.blocks[0][block], self.blocks[0][block + 1]
            at = at - 1
            low, high = self.extend(self.lookup[at], low, high)
            step += 1
            if step >= k:
                found.append((at, low, high))
            more = left > step
            at, low, high, left = at[more], low[more], high[more], left[more]
        if not found:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def first_of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest text position in each suffix range; ranges are equal or disjoint."""
        if not len(low):
            return np.zeros(0, np.int64)
        lows, back = np.unique(low, return_inverse=True)
        highs = np.empty(len(lows), np.int64)
        highs[back] = high
        pairs = np.stack([lows, highs], axis=1).reshape(-1)
        padded = np.append(self.suffixes, np.iinfo(np.int64).max)
        return np.minimum.reduceat(padded, pairs)[::2][back]

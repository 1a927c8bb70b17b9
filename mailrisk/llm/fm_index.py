"""A compressed full-text index over word sequences: BWT, wavelet matrix, matching statistics.

Everything works on arrays, so that one backward step extends the matches of all streamed
sequences at once.
"""

from __future__ import annotations

import numpy as np


class RankBits:
    """Bits packed into words, with counts before each word: how many ones come before a place."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words)
        self.before = (np.cumsum(counts) - counts).astype(np.int32)
        self.ones = int(counts.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Ranks of symbols in a sequence; one bit row per bit of the alphabet, from the highest."""

    def __init__(self, symbols: np.ndarray, alphabet: int) -> None:
        self.levels, self.rows, self.zeros = max(1, int(alphabet - 1).bit_length()), [], []
        for level in reversed(range(self.levels)):
            bits = (symbols >> level & 1).astype(bool)
            self.rows.append(RankBits(bits))
            self.zeros.append(len(symbols) - self.rows[-1].ones)
            symbols = np.concatenate([symbols[~bits], symbols[bits]])
        # Where each symbol's run begins in the last row: what a rank is counted from.
        self.firsts = np.searchsorted(self._order(symbols), self._order(np.arange(1 << self.levels)))

    def _order(self, symbols: np.ndarray) -> np.ndarray:
        """The last row is sorted by the symbols' bits from the lowest to the highest."""
        out = np.zeros_like(symbols)
        for level in range(self.levels):
            out |= (symbols >> level & 1) << (self.levels - 1 - level)
        return out

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its place."""
        for level, row, zeros in zip(reversed(range(self.levels)), self.rows, self.zeros, strict=True):
            ones = row.rank(at)
            at = np.where(symbols >> level & 1, zeros + ones, at - ones)
        return at - self.firsts[symbols]


class FmIndex:
    """An index over word sequences, each ended by a separator of its own.

    `window` is the length at which matches are reported: beside the index, each place of the
    suffix order knows the run of suffixes that share `window` words, which is the interval
    that a longer match widens to when it loses its last word, and the smallest owner in it.
    """

    def __init__(self, sequences: list[list[bytes]], owners: np.ndarray, window: int) -> None:
        self.window = window
        self.sizes = np.array([len(s) for s in sequences], np.int64)
        words: dict[bytes, int] = {}
        coded = [np.array([words.setdefault(w, len(words) + 1) for w in s], np.int64) for s in sequences]
        self.begins = np.cumsum(self.sizes + 1) - self.sizes - 1
        n = int((self.sizes + 1).sum())
        self.text = np.zeros(n, np.int64)
        for at, codes in zip(self.begins.tolist(), coded, strict=True):
            self.text[at : at + len(codes)] = codes
        order, same = self._suffixes(n)
        self.counts = np.searchsorted(np.sort(self.text), np.arange(len(words) + 2))
        self.bwt = WaveletMatrix(self.text[order - 1], len(words) + 1)
        starts = np.flatnonzero(~same)
        self.run_of = np.cumsum(~same) - 1
        self.run_begin, self.run_end = starts, np.r_[starts[1:], n]
        owner_of = np.repeat(owners, self.sizes + 1)
        self.run_owner = np.minimum.reduceat(owner_of[order], starts)

    def _suffixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffix order by prefix doubling, and which suffixes share `window` words with the one before.

        A separator is smaller than every word and differs from all others, so no match crosses it.
        """
        separators = self.text == 0
        rank = np.where(separators, np.cumsum(separators) - 1, self.text + int(separators.sum()) - 1)
        depth, shared = 1, None
        while True:
            if depth <= self.window < 2 * depth:
                shared = rank  # equal where `depth` words are equal
            following = np.zeros(n, np.int64)
            following[: max(0, n - depth)] = rank[depth:] + 1
            key = rank * (int(rank.max()) + 2) + following
            order = np.argsort(key, kind="stable")
            steps = np.r_[False, key[order][1:] != key[order][:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(steps)
            depth *= 2
            if depth > self.window and rank[order[-1]] == n - 1:
                break
        rest = self.window - (1 << (self.window.bit_length() - 1))
        later = np.minimum(order + rest, n - 1)
        same = np.r_[False, (shared[order][1:] == shared[order][:-1]) & (shared[later][1:] == shared[later][:-1])]
        return order, same

    def matching_statistics(self) -> list[np.ndarray]:
        """For each sequence, the smallest owner of each of its windows.

        All sequences are streamed through the index from their last word to their first. A step
        extends every match by one word to the left; a match longer than the window loses
        its last word, and one of the window's length is reported. As the streamed sequences are
        those of the index, no step fails.
        """
        longest_first = np.argsort(-self.sizes, kind="stable")
        sizes = self.sizes[longest_first]
        at = self.begins[longest_first] + sizes - 1
        low, high = np.zeros(len(sizes), np.int64), np.full(len(sizes), len(self.text), np.int64)
        found = np.zeros(len(self.text), np.int64)
        live = np.searchsorted(-sizes, -np.arange(1, (int(sizes[0]) if len(sizes) else 0) + 1), side="right")
        for step, n in enumerate(live.tolist()):
            symbols = self.text[at[:n]]
            first = self.counts[symbols]
            low[:n] = first + self.bwt.rank(symbols, low[:n])
            high[:n] = first + self.bwt.rank(symbols, high[:n])
            if step + 1 >= self.window:
                run = self.run_of[low[:n]]
                if step + 1 > self.window:
                    low[:n], high[:n] = self.run_begin[run], self.run_end[run]
                found[at[:n]] = self.run_owner[run]
            at[:n] -= 1
        return [found[b : b + max(0, s - self.window + 1)] for b, s in zip(self.begins.tolist(), self.sizes.tolist(), strict=True)]

"""An FM-index over word sequences: a wavelet matrix of the Burrows-Wheeler transform, in packed bits.

``repeats`` is the search that the corpus needs: for every window of the indexed text, the interval of
suffixes that start with it, by backward search word for word, and from the interval the first place
where the window occurs.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes, by prefix doubling; the end of the text is less than any symbol."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        if new[order[-1]] == n - 1 or step >= n:
            return order
        rank, step = new, step * 2


class Bits:
    """A bit vector with rank: packed words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many of the first ``i`` bits are set."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class FMIndex:
    """The index of a text of symbols 0..sigma-1; 0 separates its parts and is never searched for."""

    def __init__(self, text: np.ndarray):
        self.suffixes = suffix_array(text)
        self.sigma = int(text.max()) + 1
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.sigma))))
        level = text[self.suffixes - 1]  # the transform: what stands before each suffix
        self.height = max(1, (self.sigma - 1).bit_length())
        self.levels, self.zeros = [], []
        for shift in range(self.height - 1, -1, -1):
            bit = (level >> shift) & 1
            self.levels.append(Bits(bit))
            self.zeros.append(int((bit == 0).sum()))
            level = np.concatenate((level[bit == 0], level[bit == 1]))
        self.base = self._down(np.arange(self.sigma), np.zeros(self.sigma, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where ``i`` ends on the last level, following the symbol's bits."""
        for shift, bits, zeros in zip(range(self.height - 1, -1, -1), self.levels, self.zeros):
            ones = bits.ones(i)
            i = np.where((symbol >> shift) & 1, zeros + ones, i - ones)
        return i

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix intervals of ``symbol`` followed by what the intervals stand for."""
        both = self._down(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        shift = self.starts[symbol] - self.base[symbol]
        return both[: len(symbol)] + shift, both[len(symbol) :] + shift

    def repeats(self, text: np.ndarray, places: np.ndarray, width: int) -> np.ndarray:
        """For each window of ``width`` symbols at ``places``, the first place of the text where it occurs.

        Intervals shrink as matches grow; a window whose match is down to one suffix, its own, is
        decided before its end.
        """
        first = places.copy()
        open_ = np.arange(len(places))
        symbol = text[places + width - 1]
        low, high = self.starts[symbol], self.starts[symbol + 1]
        for back in range(width - 2, -1, -1):
            more = high - low > 1
            open_, low, high = open_[more], low[more], high[more]
            if not len(open_):
                return first
            low, high = self.extend(text[places[open_] + back], low, high)
        more = high - low > 1
        open_, low, high = open_[more], low[more], high[more]
        if len(open_):
            # Intervals of windows of one width are equal or apart.
            starts, where = np.unique(low, return_inverse=True)
            ends = np.empty_like(starts)
            ends[where] = high
            edges = np.stack((starts, ends), axis=1).ravel()
            least = np.minimum.reduceat(np.append(self.suffixes, len(text)), edges)[::2]
            first[open_] = least[where]
        return first

"""A compressed FM-index over sequences of integers, searched backwards for many patterns at a time."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Symbols level by level, one bit each, highest first; ranks by counting bits of 64-bit words."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.n, self.levels, self.words, self.counts, self.zeros = len(symbols), levels, [], [], []
        s = symbols
        for level in range(levels - 1, -1, -1):
            bit = ((s >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate((bit, np.zeros(-len(bit) % 64 + 64, np.uint8))), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64))).astype(np.int32))
            one = bit.astype(bool)
            self.zeros.append(len(s) - int(one.sum()))
            s = np.concatenate((s[~one], s[one]))

    def places(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the prefix [0, at) of each query ends among its symbol's copies in the last level's order."""
        at = at.astype(np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.words[k][word] & mask)
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling, in which only what is still tied is sorted again. Suffixes must differ before the end of the text or of a unique symbol."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    new = np.ones(n, dtype=bool)
    new[1:] = symbols[order[1:]] != symbols[order[:-1]]
    first = np.flatnonzero(new)
    rank[order] = np.repeat(first, np.diff(np.append(first, n)))  # a suffix's rank is the place of the first with its start
    tied = np.arange(n)  # the places in order that are not settled yet
    step = 1
    while step < 2 * n:
        alone = np.append(new, True)
        tied = tied[~(alone[:-1] & alone[1:])[tied]]
        if not len(tied):
            break
        own = order[tied]
        after = own + step
        key = rank[own] * np.int64(n + 1)
        inside = after < n
        key[inside] += rank[after[inside]] + 1
        by = np.argsort(key)
        key, own = key[by], own[by]
        order[tied] = own
        cut = np.ones(len(tied), dtype=bool)
        cut[1:] = key[1:] != key[:-1]
        new[tied] = cut
        begin = np.flatnonzero(cut)
        rank[own] = np.repeat(tied[begin], np.diff(np.append(begin, len(tied))))
        step *= 2
    return order


class FMIndex:
    """Index of sequences of non-negative integers laid end to end; `ends` has the end of each.

    A separator of its own stands after each sequence, so no match runs over an end. Kept are the wavelet matrix of the
    last column, the first places of the symbols, and, of the suffix array, only the owner of each suffix (`owners`: of
    each value)."""

    def __init__(self, values: np.ndarray, ends: np.ndarray, owners: np.ndarray | None = None):
        self.alphabet, inverse = np.unique(values, return_inverse=True)
        m, n = len(ends), len(values)
        place = np.arange(n) + np.repeat(np.arange(m), np.diff(np.concatenate(([0], ends))))  # of each value in the text
        full = np.full(n + m, -1, dtype=np.int64)
        full[place] = inverse + m
        gaps = np.flatnonzero(full < 0)
        full[gaps] = np.arange(m)
        order = suffix_order(full)
        text = np.maximum(full - m + 1, 0)  # separators are 0
        self.size = n + m
        self.tree = WaveletMatrix(text[order - 1], max(1, int(len(self.alphabet)).bit_length()))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1))))
        symbols = np.arange(len(self.alphabet) + 1)
        self.start = self.tree.places(symbols, np.zeros(len(symbols), np.int64))
        self.owner = None
        if owners is not None:
            of = np.full(n + m, np.iinfo(np.int64).max)
            of[place] = owners
            self.owner = of[order]

    def matching_statistics(self, pattern: np.ndarray, most: int, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each place of a pattern of raw values, the length of its longest match in the index, up to `most`, and the
        suffix interval [low, high) of a match of `most` values (empty where there is none).

        All places move together: a match of length l at i is one of length l - 1 at i + 1, led by the value at i, so each
        step of backward search serves the places before. A place without a match moves no more. Nor does one whose match
        has a single suffix, if the pattern is the index's own text (`own`): it is that of the place, however long."""
        where = np.searchsorted(self.alphabet, pattern)
        where = np.minimum(where, max(0, len(self.alphabet) - 1))
        symbols = np.where(self.alphabet[where] == pattern, where + 1, 0) if len(self.alphabet) else np.zeros(len(pattern), np.int64)
        out = np.zeros(len(pattern), dtype=np.int64)
        low, high = np.zeros(len(pattern) + 1, np.int64), np.full(len(pattern) + 1, self.size, np.int64)
        for length in range(1, most + 1):
            n = len(pattern) - length + 1
            if n <= 0:
                low, high = np.zeros(1, np.int64), np.zeros(1, np.int64)
                break
            if length == 1:
                at = np.arange(n)
            else:
                out[:n][high[:n] - low[:n] == 1] += own
                at = np.flatnonzero(high[:n] - low[:n] > own)
            s = symbols[at]
            base = self.first[s] - self.start[s]
            l = base + self.tree.places(s, low[at + 1])
            h = base + self.tree.places(s, high[at + 1])
            ok = (h > l) & (s > 0)
            low, high = low[: n + 1].copy(), high[: n + 1].copy()
            low[at], high[at] = np.where(ok, l, 0), np.where(ok, h, 0)
            low[n], high[n] = 0, 0
            out[at[ok]] = length
        bounds = np.zeros((2, len(pattern)), dtype=np.int64)
        bounds[0, : len(low) - 1], bounds[1, : len(high) - 1] = low[:-1], high[:-1]
        return out, bounds[0], bounds[1]

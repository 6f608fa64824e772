"""FM-index of a word sequence: suffix order, wavelet matrix of the last column, sampled
positions. Words are numbers from 1; 0 ends a stretch of text, and no search crosses it."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in sorted order. Every 0 counts as a symbol of its own,
    in order of position; the text ends with one. Prefix doubling, where only suffixes that
    are not told apart yet go on."""
    n = len(text)
    ends = text == 0
    first = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + ends.sum())
    order = np.argsort(first, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order], active = _group(first[order], np.zeros(n, np.int64), order)
    step = 1
    while len(active):
        key = rank[active] * n + rank[active + step]
        by = np.argsort(key, kind="stable")
        members = active[by]
        rank[members], active = _group(key[by], rank[members], members)
        step *= 2
    order[rank] = np.arange(n)
    return order


def _group(key: np.ndarray, old: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New ranks of sorted members, those of equal key alike, and the members still tied."""
    at = np.arange(len(key))
    head = np.ones(len(key), bool)
    head[1:] = key[1:] != key[:-1]
    outer = np.ones(len(key), bool)
    outer[1:] = old[1:] != old[:-1]
    start = np.maximum.accumulate(np.where(head, at, 0))
    alone = head & np.append(head[1:], True)
    return old + start - np.maximum.accumulate(np.where(outer, at, 0)), members[~alone]


class BitRank:
    """Bits with constant-time counts of ones before a position."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word, low = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << low) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class FMIndex:
    """``search`` narrows row ranges from the last word of a phrase to its first; ``locate``
    steps from a row to the word before it until a sampled position is met."""

    def __init__(self, text: np.ndarray, sample_every: int = 16):
        order = suffix_order(text)
        last = text[order - 1]
        self.size = len(text)
        symbols = int(text.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.width = max(1, symbols.bit_length())
        self.levels: list[tuple[BitRank, int]] = []
        for bit in reversed(range(self.width)):
            ones = (last >> bit) & 1 == 1
            self.levels.append((BitRank(ones), int(len(ones) - ones.sum())))
            last = np.concatenate([last[~ones], last[ones]])
        self.known = symbols
        self.origin = self._descend(np.arange(symbols), np.zeros(symbols, np.int64))
        # the first word of a stretch is always sampled, so that no walk leaves its stretch
        sampled = (order % sample_every == 0) | (text[order - 1] == 0)
        self.sampled = BitRank(sampled)
        self.positions = order[sampled]

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, (rank, zeros) in zip(reversed(range(self.width)), self.levels, strict=True):
            ones = rank.ones(at)
            at = np.where((symbol >> bit) & 1 == 1, zeros + ones, at - ones)
        return at

    def _step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self._descend(symbol, at) - self.origin[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases of one length as rows of numbers: the rows found, with their range in the
        suffix order, [low, high)."""
        alive = np.flatnonzero((phrases < self.known).all(axis=1))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.size, np.int64)
        for k in reversed(range(phrases.shape[1])):
            symbol = phrases[alive, k]
            low, high = self._step(symbol, low), self._step(symbol, high)
            found = low < high
            alive, low, high = alive[found], low[found], high[found]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows of the suffix order."""
        out = np.empty(len(rows), np.int64)
        waiting, at, steps = np.arange(len(rows)), rows, 0
        while len(waiting):
            known = self.sampled[at]
            out[waiting[known]] = self.positions[self.sampled.ones(at[known])] + steps
            waiting, at = waiting[~known], at[~known]
            symbol, place = np.zeros(len(at), np.int64), at
            for rank, zeros in self.levels:
                one, ones = rank[place], rank.ones(place)
                symbol = symbol * 2 + one
                place = np.where(one, zeros + ones, place - ones)
            at = self.first[symbol] + place - self.origin[symbol]
            steps += 1
        return out

"""A compressed full-text index of many short word sequences: suffix order, wavelet matrix, backward search.

The sequences are joined with a separator after each. The index keeps the Burrows-Wheeler transform of the joined text
as a wavelet matrix of packed bits with a count per 64 bits, so a symbol's rank takes one count per bit of the alphabet,
and for every place of the suffix order the label of its sequence, with minima by blocks. All searches take arrays.
"""

from __future__ import annotations

import numpy as np

#: Places of the suffix order that share one entry of the table of minima.
RUN = 16


def suffix_order(text: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in order, by prefix doubling; 0 is the separator, and separators are ordered by their places."""
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text + ends.sum()).astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        key = rank << 32 | after
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])]) if n else np.zeros(0, np.int64)
        rank[order] = new
        step *= 2
        if not n or new[-1] == n - 1 or step > longest + 1:
            return order


class Bits:
    """A packed bit vector with the number of ones before every word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)]).astype(np.int32)
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class Index:
    """``symbols`` are the sequences' symbols (from 1), ``first`` each one's start, ``labels`` a number of each."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray, labels: np.ndarray):
        sizes = np.diff(first)
        owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.text = np.zeros(len(owner), np.int64)
        self.text[np.arange(len(symbols)) + np.repeat(np.arange(len(sizes)), sizes)] = symbols
        order = suffix_order(self.text, int(sizes.max(initial=0)))
        self.levels = max(1, int(self.text.max(initial=0)).bit_length())
        counts = np.bincount(self.text, minlength=(1 << self.levels) + 1)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        current, self.bits = self.text[order - 1], []
        for level in range(self.levels - 1, -1, -1):
            bit = (current >> level & 1).astype(bool)
            self.bits.append(Bits(bit))
            current = np.concatenate([current[~bit], current[bit]])
        self.start = self._walk(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64))
        self._labels(labels[owner][order])

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, bits in enumerate(self.bits):
            ones = bits.ones(at)
            at = np.where(symbol >> (self.levels - 1 - i) & 1, bits.zeros + ones, at - ones)
        return at

    def before(self, symbol: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that start with a symbol and go on as those of the given ranges."""
        both = self._walk(np.concatenate([symbol, symbol]), np.concatenate([at, end]))
        both += np.tile(self.smaller[symbol] - self.start[symbol], 2)
        return both[: len(at)], both[len(at):]

    def _labels(self, labels: np.ndarray) -> None:
        self.labels = labels.astype(np.int32)
        top = np.iinfo(np.int32).max
        padded = np.full(-(-max(len(labels), 1) // RUN) * RUN, top, np.int32)
        padded[: len(labels)] = labels
        runs = padded.reshape(-1, RUN)
        self.upto = np.minimum.accumulate(runs, axis=1).ravel()
        self.onwards = np.minimum.accumulate(runs[:, ::-1], axis=1)[:, ::-1].ravel()
        self.minima = [runs.min(axis=1)]
        while 2 << len(self.minima) - 1 <= len(runs):
            half = 1 << len(self.minima) - 1
            last = self.minima[-1]
            self.minima.append(np.minimum(last[: len(last) - half], last[half:]))

    def least(self, at: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Smallest label of every (not empty) range of the suffix order."""
        out = np.empty(len(at), np.int32)
        short = end - at <= RUN
        places, ends = at[short], end[short] - 1
        found = self.labels[places]
        for k in range(1, RUN):
            np.minimum(found, self.labels[np.minimum(places + k, ends)], out=found)
        out[short] = found
        places, ends = at[~short], end[~short] - 1
        found = np.minimum(self.onwards[places], self.upto[ends])
        first, last = places // RUN + 1, ends // RUN
        width = np.maximum(last - first, 1)
        level = np.frexp(width.astype(float))[1] - 1
        for k in range(len(self.minima)):
            mine = np.flatnonzero((level == k) & (last > first))
            found[mine] = np.minimum(found[mine], np.minimum(
                self.minima[k][first[mine]], self.minima[k][last[mine] - (1 << k)]))
        out[~short] = found
        return out

    def matching(self, ends: np.ndarray, limit: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of places in the text: how many symbols (``most`` at most) that end at each place also
        occur in a sequence with a label below the place's limit, and the least label of the longest such match."""
        length = np.zeros(len(ends), np.int64)
        least = np.full(len(ends), np.iinfo(np.int32).max, np.int32)
        active = np.arange(len(ends))
        at, end = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.text), np.int64)
        for step in range(1, most + 1):
            place = ends[active] - step
            inside = (place >= 0) & (self.text[np.maximum(place, 0)] > 0)
            active, at, end, place = active[inside], at[inside], end[inside], place[inside]
            at, end = self.before(self.text[place], at, end)
            found = self.least(at, end)
            ok = found < limit[active]
            active, at, end = active[ok], at[ok], end[ok]
            if not len(active):
                break
            length[active], least[active] = step, found[ok]
        return length, least

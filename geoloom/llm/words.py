"""Words of many texts at once, as hashes, on the UTF-8 bytes of an Arrow column.

All separators are ASCII bytes, so cutting bytes is the same as cutting characters. A word's hash is a polynomial of
its bytes modulo 2**64 (differences of one running sum, shifted back to the word's start), mixed at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes whose running sums are held at once; a single longer word is hashed alone.
PIECE = 1 << 18
_RNG = np.random.default_rng(20_240_229)
#: Values of bytes as they are, and with A-Z counting as a-z.
CASED = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = CASED[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POWERS: dict[int, np.ndarray] = {}

#: Word separators: space and \\x09 to \\x0D.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Separators for runs of letters (ASCII letters and everything beyond ASCII).
NOT_LETTERS = np.ones(256, bool)
NOT_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False
#: Separators for runs of ASCII marks.
NOT_MARKS = np.ones(256, bool)
NOT_MARKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits (one-to-one)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        have = np.full(n, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= PIECE + 1:
            _POWERS[int(base)] = have
    return have[:n]


def utf8(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and where each text starts (one more entry at the end); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[starts[0]: starts[-1]], starts - starts[0]


def word_spans(data: np.ndarray, starts: np.ndarray, separators: np.ndarray = SPACES):
    """Byte spans of all words, and each text's first word (one more entry at the end)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~separators[data]
    first = np.zeros(len(data) + 1, bool)
    first[starts] = True
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2] | first[1:-1]
    ends = inside[:-1] & (~inside[1:] | first[1:])
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return begins, ends, np.searchsorted(begins, starts)


def hash_spans(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """64-bit hashes of byte spans in ascending order, A-Z counting as a-z unless other ``values`` are given."""
    out = np.empty(len(begins), np.uint64)
    i = 0
    while i < len(begins):
        j = max(i + 1, int(np.searchsorted(ends, begins[i] + PIECE, "right")))
        lo, hi = int(begins[i]), int(ends[j - 1])
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(values[data[lo:hi]] * _powers(_BASE, max(hi - lo, 1))[: hi - lo], out=sums[1:])
        at = begins[i:j] - lo
        out[i:j] = (sums[ends[i:j] - lo] - sums[at]) * _powers(_INVERSE, hi - lo + 1)[at]
        i = j
    return mix(out)


def run_hashes(words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of runs of hashed words, of any lengths and places."""
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(_BASE, max(len(words), 1))[: len(words)], out=sums[1:])
    inverse = _powers(_INVERSE, len(words) + 1)
    return mix((sums[ends] - sums[begins]) * inverse[begins] + mix((ends - begins).astype(np.uint64)))


def byte_run_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of every run of ``width`` bytes, A-Z counting as a-z."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(_BASE, max(n, 1))[:n], out=sums[1:])
    return mix((sums[width:] - sums[: n + 1 - width]) * _powers(_INVERSE, n + 1)[: n + 1 - width])


def word_hashes(texts, separators: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and each text's first word (one more entry at the end)."""
    data, starts = utf8(texts)
    begins, ends, first = word_spans(data, starts, separators)
    return hash_spans(data, begins, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's runs of ``size`` words (a shorter text is one run), and each text's first run."""
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    n = np.diff(first)
    marks = mix(np.arange(size + 1, dtype=np.uint64) + _BASE)  # tells runs of different lengths apart
    runs = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    first_run = np.concatenate([[0], np.cumsum(runs)])
    at = np.repeat(first[:-1] - first_run[:-1], runs) + np.arange(first_run[-1])
    whole = words[: max(0, len(words) - size + 1)] * factors[0]
    for k in range(1, size):
        whole += words[k: len(words) - size + 1 + k] * factors[k]
    total = np.empty(len(at), np.uint64)
    full = np.repeat(n >= size, runs)
    total[full] = whole[at[full]] + marks[size]
    for text in np.flatnonzero((n > 0) & (n < size)):
        part = words[first[text]: first[text + 1]]
        total[first_run[text]: first_run[text] + 1] = (part * factors[: len(part)]).sum(dtype=np.uint64, keepdims=True) + marks[len(part)]
    return mix(total), first_run

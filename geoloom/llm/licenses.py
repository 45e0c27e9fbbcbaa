"""License scans: winnowed fingerprints of templates pick candidates, and banded alignment reports coverage and spans.

A document holds a template of n words where a run of its words is within ``EDITS`` * n word edits (changed, missing or
added words) of it, so at least 1 - ``EDITS`` of the template's words are matched in order.

1. Templates and documents are cut into words (lower-cased letters and digits). So few edits leave a run of
   ``intact_run(n)`` template words untouched in every match. Hashes of some fewer words run over both sides, and of
   every ``window`` neighbouring ones the smallest is a fingerprint (winnowing), such that a run of that length always
   holds one. An inverted index of the templates' fingerprints with template and place thus finds every match; without a
   common fingerprint there is none.
2. Hits of one template are put on diagonals; neighbouring hits of nearby diagonals make one candidate region.
3. The template is aligned to the region by edit distance over words, in the band around the hits' diagonals that so few
   edits can reach, free at the region's ends. The report has the words of the template that are matched in order,
   their share, and the span.

Documents are handled where they lie, in batches, without shuffle or join; the templates are a short list and are sent
with the tasks. The work for a text grows with its words and its hits.

Defined cases: null and empty texts match nothing; repeated rows are each reported; a text may hold a template several
times and several templates in one place, all are reported; matches of one template that overlap are reported once, the
closest (then first) one; empty tables give empty tables. The result column replaces one of its name; all others stay.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.tables import lean
from geoloom.llm.words import hash_spans, mix, utf8, word_spans

#: Edits per word of a template, and words that templates must have.
EDITS, MIN_WORDS = 0.2, 4
MAX_TEMPLATE_WORDS = 100_000
#: Separators: all bytes but ASCII letters and digits and those beyond ASCII.
MARKS = np.ones(256, bool)
MARKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_PIECE = 1 << 22


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        total = mix(total + words[k: len(words) - size + 1 + k])
    return total


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest hash (the last of equals) of every window; all places of fewer hashes than a window."""
    if len(hashes) <= window:
        return np.arange(len(hashes))
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - views[:, ::-1].argmin(axis=1))


def intact_run(words: int) -> int:
    """Words in a row that every match of a template keeps: the edits cut what is left into one part more than them."""
    edits = int(EDITS * words)
    return -(-(words - edits) // (edits + 1))


def fingerprint_form(words: int) -> tuple[int, int]:
    """(words of a gram, window) such that a template's intact run always holds a winnowed gram."""
    run = intact_run(words)
    return (run - 1, 2) if run > 2 else (run, 1)


def align(template: np.ndarray, words: np.ndarray, low: int, high: int) -> list[tuple[int, int, int, int]]:
    """Runs of words closest to the whole template: (distance, matched words, first word, word after the last) for each
    end of a run, in a band of diagonals (place in words minus place in the template) from ``low`` to ``high``."""
    step, most, far = 1 << 40, 1 << 17, 1 << 60  # distance, most - matches and start in one number
    n = len(words)
    j = np.arange(n + 1)
    row = np.full(n + 1, far)
    a, b = max(0, low), min(n, high) + 1
    if a >= b:
        return []
    row[a:b] = (most << 22) + j[a:b]
    for i, t in enumerate(template, 1):
        before, (a, b) = row, (max(0, low + i), min(n, high + i) + 1)
        row = np.full(n + 1, far)
        if a >= b:
            return []
        new = before[a:b] + step
        left = max(a, 1)
        new[left - a:] = np.minimum(new[left - a:], before[left - 1: b - 1] + np.where(words[left - 1: b - 1] == t, -(1 << 22), step))
        row[a:b] = np.minimum.accumulate(new - j[a:b] * step) + j[a:b] * step
    return [(v >> 40, most - (v >> 22 & (1 << 18) - 1), v & (1 << 22) - 1, int(e)) for e, v in zip(j, row.tolist()) if v < far]


class Templates:
    """Fingerprints of all templates, by their form."""

    def __init__(self, templates: list[tuple[str, np.ndarray]]):
        self.names = [n for n, _ in templates]
        self.words = [w for _, w in templates]
        self.edits = [int(EDITS * len(w)) for w in self.words]
        by_form: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for i, words in enumerate(self.words):
            size, window = form = fingerprint_form(len(words))
            hashes = grams(words, size)
            by_form.setdefault(form, []).extend((int(hashes[at]), i, int(at)) for at in winnow(hashes, window))
        self.index = []
        for form, entries in by_form.items():
            entries.sort()
            self.index.append((*form, np.array([h for h, _, _ in entries], np.uint64), np.array([e[1:] for e in entries])))

    def hits(self, words: np.ndarray) -> np.ndarray:
        """(template, diagonal) of all fingerprints of a document that the index holds, in order."""
        found = [np.zeros((0, 2), np.int64)]
        for size, window, keys, entries in self.index:
            hashes = grams(words, size)
            at = winnow(hashes, window)
            lo, hi = np.searchsorted(keys, hashes[at]), np.searchsorted(keys, hashes[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.stack([entries[which, 0], np.repeat(at, n) - entries[which, 1]], 1))
        return np.unique(np.concatenate(found), axis=0)

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(template, first word, word after the last, matched words, distance), by place."""
        hits, kept, i = self.hits(words), [], 0
        while i < len(hits):
            template = int(hits[i, 0])
            near: list[tuple[int, int, int, int]] = []
            while i < len(hits) and hits[i, 0] == template:
                edits, n, j = self.edits[template], len(self.words[template]), i + 1
                while j < len(hits) and hits[j, 0] == template and hits[j, 1] <= hits[j - 1, 1] + 2 * edits:
                    j += 1
                lowest, highest = int(hits[i, 1]) - edits, int(hits[j - 1, 1]) + edits
                lo, hi = max(0, lowest), min(len(words), highest + n + edits)
                near += [(d, lo + start, lo + end, m) for d, m, start, end in align(
                    self.words[template], words[lo:hi], lowest - lo, highest - lo) if d <= edits]
                i = j
            starts: list[int] = []
            taken: list[tuple[int, int]] = []
            for distance, start, end, matched in sorted(near, key=lambda x: (x[0], -x[3], x[1], x[2])):
                at = bisect(starts, start)
                if (not at or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                    starts.insert(at, start)
                    taken.insert(at, (start, end))
                    kept.append((template, start, end, matched, distance))
        return sorted(kept, key=lambda k: (k[1], k[0]))


def template_words(text: str) -> np.ndarray:
    data, starts = utf8(pa.array([text]))
    begins, ends, _ = word_spans(data, starts, MARKS)
    return hash_spans(data, begins, ends)


def add_licenses(docs: DataFrame, templates: dict[str, str], text: str = "text", out: str = "licenses") -> DataFrame:
    """Adds the templates that every text holds: array<struct<license, matched_words, coverage, distance, first_byte,
    end_byte>>, the span in bytes of the text's UTF-8 form."""
    listed = [(name, template_words(body)) for name, body in sorted(templates.items())]
    if sum(len(w) for _, w in listed) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"Templates of more than {MAX_TEMPLATE_WORDS} words.")
    for name, words in listed:
        if len(words) < MIN_WORDS:
            raise ValueError(f"Template {name} has fewer than {MIN_WORDS} words.")

    @lean
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        held = Templates(listed)
        for batch in batches:
            found: list[list[dict]] = []
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch), 0).to_numpy(zero_copy_only=False))
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(sizes, (int(sizes[lo - 1]) if lo else 0) + _PIECE, "right")))
                data, starts = utf8(batch.slice(lo, hi - lo))
                begins, ends, first = word_spans(data, starts, MARKS)
                hashes = hash_spans(data, begins, ends)
                for i in range(hi - lo):
                    a, b = first[i], first[i + 1]
                    found.append([{
                        "license": held.names[t], "matched_words": m, "coverage": m / len(held.words[t]), "distance": d,
                        "first_byte": int(begins[a + s] - starts[i]), "end_byte": int(ends[a + e - 1] - starts[i])}
                        for t, s, e, m, d in held.matches(hashes[a:b])])
                lo = hi
            yield pa.array(found, _FOUND)

    apply = F.arrow_udf(run, "array<struct<license:string,matched_words:int,coverage:double,distance:int,"
                             "first_byte:bigint,end_byte:bigint>>")
    return docs.withColumn(out, apply(F.col(f"`{text}`").cast("string")))


_FOUND = pa.list_(pa.struct([
    ("license", pa.string()), ("matched_words", pa.int32()), ("coverage", pa.float64()), ("distance", pa.int32()),
    ("first_byte", pa.int64()), ("end_byte", pa.int64())]))

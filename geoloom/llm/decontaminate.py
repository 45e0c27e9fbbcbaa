"""Benchmark decontamination by CGK embeddings and repeated bit sampling.

A document leaks an item when some run of its words is within an edit distance (in words, A-Z as a-z) of a fifth of the
item's words. Windows of the items' sizes are compared as follows.

1. The CGK embedding walks over a window and writes the word it stands on at every step; at each step a random bit,
   drawn from the step and the word, says whether to go on. Windows at small edit distance give embeddings at small
   Hamming distance, since the walks fall into step again after each edit.
2. Bit sampling keeps a few random steps of the embedding as a key. Several embeddings with several samples each bring
   the share of leaks with an equal key to ``RECALL`` at the largest distance; exact passages always have one.
3. Every window with an equal key is verified exactly by bit-parallel edit distance, which also gives the span.

Fixed numbers of steps get too sparse for long items, so an item of twice ``PART`` words or more is cut into equal parts
of at least ``PART`` words, each searched like an item. One of them has no more than its share of the edits, and the
item is verified as a whole wherever one of its parts has a key. No window is thus longer than parts can be, and the
share of leaks found does not fall with the length of the item.

Parts are grouped by length, the window of a group being its smallest length. Before a window is embedded it must hold
enough words of the group's parts for the distance to be possible at all; that test loses nothing. Documents are
handled where they lie, in batches: no shuffle, no join. Only the items are broadcast; their size is checked.

Items of fewer than ``MIN_WORDS`` words, of which no edit is allowed, are searched exactly where the caller asks for it
(``least_words``), and so are all of fewer than ``EXACT_BELOW`` words: every place of a text is compared with them by
hashes of their first and last bytes, blanks counting as one space. They must stand between blanks, but on a side where
the item begins or ends with a script that is written without blanks (Chinese, Japanese, Thai, Lao, Khmer, Burmese), they
may lie anywhere in a longer run; the reported words are those that the passage touches.

Defined cases: null or empty texts leak nothing; items that are null or hold no word cannot be searched, and items of
fewer than ``least_words`` words are not, as any text might hold them by chance; repeated items are reported each; each document reports an item
once, at its closest (then first) passage. Repeated rows are judged each. Empty tables work. The result column
replaces one of its name, all others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from geoloom.llm.tables import lean
from geoloom.llm.words import byte_run_hashes, mix, word_hashes

#: Edits allowed per word of an item, and words that an item must have.
EDITS, MIN_WORDS = 0.2, 5
#: Items of fewer words are searched exactly as well.
EXACT_BELOW = 8
#: Share of leaks at the largest distance that are to be found (see the test that measures it).
RECALL = 0.95
EMBEDDINGS, SAMPLES, STEPS_KEPT = 6, 6, 3
#: Least words of the parts that long items are cut into.
PART = 20
#: Lengths of windows grow by this factor from group to group.
GROUP_GROWTH = 1.25
#: Bytes of items that are broadcast at once; more items are searched in parts of that size.
MAX_ITEM_BYTES = 64 << 20
#: Texts of an Arrow batch that are handled at once, in bytes (a longer text alone).
PIECE = 1 << 22
#: Letters and marks of scripts that are written without blanks.
BLANKLESS = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u31ff\u3400-\u9fff\uf900-\ufaff"
                       "\ufe30-\ufe4f\uff00-\uffef\U00020000-\U0003ffff]")
#: What stands between words.
BLANKS = " \t\n\r\v\f"
#: Places of a text that are compared with short items at once.
PLACES = 1 << 18
_PAD = np.uint64(0x5BF03635F0A31E29)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TABLE = 20


def distance_masks(item: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, word in enumerate(item):
        masks[word] = masks.get(word, 0) | 1 << i
    return masks


def _run(masks: dict[int, int], size: int, words: list[int], free_start: bool) -> Iterator[int]:
    """Edit distances between the item and the words up to each place (from the first, or from any one)."""
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    for word in words:
        equal = masks.get(word, 0)
        across = (((equal & plus) + plus) ^ plus) | equal | minus
        up, down = (minus | ~(across | plus)) & full, plus & across
        score += bool(up & top) - bool(down & top)
        up = up << 1 | (not free_start)
        down = down << 1
        vertical = equal | minus
        plus, minus = (down | ~(vertical | up)) & full, up & vertical & full
        yield score


def closest(item: list[int], words: list[int]) -> tuple[int, int, int]:
    """Smallest edit distance of an item to a run of words, with the first such run's start and end."""
    best, end = len(item), 0
    for i, score in enumerate(_run(distance_masks(item), len(item), words, True), 1):
        if score < best:
            best, end = score, i
    start = end
    for i, score in enumerate(_run(distance_masks(item[::-1]), len(item), words[:end][::-1], False), 1):
        if score == best:
            start = end - i
            break
    return best, start, end


class Group:
    """Parts whose windows have one size."""

    def __init__(self, size: int, members: list[int], items: list[np.ndarray], edits: list[int]):
        self.size, self.members, self.edits = size, np.array(members), max(edits[i] for i in members)
        self.vocabulary = np.zeros(1 << _TABLE, bool)
        for i in members:
            self.vocabulary[items[i] >> np.uint64(64 - _TABLE)] = True
        starts = np.cumsum([0, *[len(items[i]) for i in members]])
        words = np.concatenate([items[i] for i in members])
        self.keys = []
        for e in range(EMBEDDINGS):
            keys = self.embed(words, starts[:-1], np.minimum(starts[:-1] + size, starts[1:]), e)
            order = [np.argsort(k, kind="stable") for k in keys]
            self.keys.append([(k[o], self.members[o]) for k, o in zip(keys, order)])

    def embed(self, words: np.ndarray, at: np.ndarray, end: np.ndarray, e: int) -> list[np.ndarray]:
        """Keys of windows under all samples of an embedding."""
        rng = np.random.default_rng([e, self.size])
        steps = 2 * self.size
        kept = np.array([rng.choice(steps, STEPS_KEPT, replace=False) for _ in range(SAMPLES)])
        salts = rng.integers(0, 2**63, 1 + steps // 64, dtype=np.uint64)
        keys = [np.zeros(len(at), np.uint64) for _ in range(SAMPLES)]
        at = at.copy()
        for step in range(int(kept.max()) + 1):
            inside = at < end
            word = np.where(inside, words[np.minimum(at, len(words) - 1)], _PAD)
            for m in np.flatnonzero((kept == step).any(axis=1)):
                keys[m] = (keys[m] + word) * _ODD + np.uint64(step)
            bits = (word ^ salts[step // 64]) * _ODD
            at += inside & ((bits >> np.uint64(step % 64)) ^ (bits >> np.uint64(37))).astype(np.int64) & 1 == 1
        return [mix(k) for k in keys]


class Index:
    def __init__(self, items: list[np.ndarray]):
        self.items, self.edits = items, [int(EDITS * len(x)) for x in items]
        sizes = [MIN_WORDS]
        while sizes[-1] < max(map(len, items), default=0):
            sizes.append(max(sizes[-1] + 1, int(sizes[-1] * GROUP_GROWTH)))
        # Per part: its words, item, place in the item, and the share of the edits that one part at least keeps to.
        parts, of, offsets, shares = [], [], [], []
        for i, item in enumerate(items):
            if len(item) >= MIN_WORDS:
                n = max(1, len(item) // PART)
                cuts = [len(item) * k // n for k in range(n + 1)]
                parts += [item[lo:hi] for lo, hi in zip(cuts, cuts[1:])]
                of, offsets, shares = of + [i] * n, offsets + cuts[:-1], shares + [self.edits[i] // n] * n
        self.part_item, self.part_offset = np.array(of, np.int64), np.array(offsets, np.int64)
        grouped: dict[int, list[int]] = {}
        for k, part in enumerate(parts):
            grouped.setdefault(max(s for s in sizes if s <= len(part)), []).append(k)
        self.groups = [Group(s, m, parts, shares) for s, m in sorted(grouped.items())]
        self.lists = [x.tolist() for x in items]

    def candidates(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(text, item, place in ``words`` that the item then starts near) of all parts with an equal key."""
        doc_end = np.repeat(first[1:], np.diff(first))
        found = [np.zeros((0, 2), np.int64)]
        slot = (words >> np.uint64(64 - _TABLE)).astype(np.int64)
        for group in self.groups:
            known = np.concatenate([[0], np.cumsum(group.vocabulary[slot])])
            at = np.arange(len(words))
            end = np.minimum(at + group.size, doc_end)
            at = np.flatnonzero(known[end] - known[:-1] >= group.size - group.edits)
            if not len(at):
                continue
            for e in range(EMBEDDINGS):
                for keys, (sorted_keys, members) in zip(group.embed(words, at, end[at], e), group.keys[e]):
                    lo, hi = np.searchsorted(sorted_keys, keys), np.searchsorted(sorted_keys, keys, "right")
                    hit = np.flatnonzero(hi > lo)
                    n = (hi - lo)[hit]
                    which = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    found.append(np.stack([np.repeat(at[hit], n), members[which]], axis=1))
        at, part = np.unique(np.concatenate(found), axis=0).T
        doc = np.searchsorted(first, at, "right") - 1
        return np.unique(np.stack([doc, self.part_item[part], at - self.part_offset[part]], axis=1), axis=0)

    def leaks(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, distance, first word, word after the last) of all verified leaks."""
        found = self.candidates(words, first)  # by text, item and place
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        i = 0
        while i < len(found):
            doc, item, at = (int(x) for x in found[i])
            reach, j = len(self.lists[item]) + 2 * self.edits[item], i + 1
            while j < len(found) and found[j, 1] == item and found[j, 0] == doc and found[j, 2] <= found[j - 1, 2] + reach:
                j += 1
            lo = max(int(first[doc]), at - self.edits[item])
            hi = min(int(first[doc + 1]), int(found[j - 1, 2]) + reach)
            distance, start, end = closest(self.lists[item], words[lo:hi].tolist())
            if distance <= self.edits[item]:
                place = distance, lo + start - int(first[doc]), lo + end - int(first[doc])
                best[doc, item] = min(best.get((doc, item), place), place)
            i = j
        return [(*key, *place) for key, place in sorted(best.items())]


def plain(text: str) -> bytes:
    """A text's words with one space between them, A-Z as a-z."""
    return b" ".join(text.encode("utf-8", "replace").lower().split())


class Exact:
    """Items that are searched as they are: (number, text) each."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, plain(text)) for i, text in items]
        inner = [text.strip(BLANKS) for _, text in items]
        free = [(bool(BLANKLESS.match(t[0])), bool(BLANKLESS.match(t[-1]))) for t in inner]
        # Per power of two: items whose first and last so many bytes overlap or meet, ordered by the first ones' hash.
        self.levels = []
        for width in sorted({1 << len(x).bit_length() - 1 for _, x in self.items}):
            members = [k for k, (_, x) in enumerate(self.items) if width <= len(x) < 2 * width]
            ends = [byte_run_hashes(np.frombuffer(self.items[k][1], np.uint8), width)[[0, -1]] for k in members]
            order = np.argsort(np.array([e[0] for e in ends], np.uint64), kind="stable")
            members = np.array(members)[order]
            head, tail = np.array(ends, np.uint64)[order].T
            self.levels.append((width, members, head, tail, np.array([len(self.items[k][1]) for k in members]),
                                np.array([free[k] for k in members])))

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, 0, first word, word after the last) of the first passage of every item that a text holds."""
        parts = [plain(t or "") for t in texts]
        starts = np.cumsum([0, *[len(p) + 1 for p in parts]])
        joined = np.frombuffer(b" ".join(parts) + b" " * 2, np.uint8)
        first: dict[tuple[int, int], int] = {}
        for width, members, head, tail, sizes, free in self.levels:
            for begin in range(0, len(joined) - 1, PLACES):
                piece = joined[begin: begin + PLACES + 2 * width]
                if len(piece) < width:
                    break
                hashes = byte_run_hashes(piece, width)
                lo, hi = np.searchsorted(head, hashes[:PLACES]), np.searchsorted(head, hashes[:PLACES], "right")
                at, n = np.flatnonzero(hi > lo), (hi - lo)[hi > lo]
                which = np.repeat(lo[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(at, n)
                inside = at + sizes[which] < len(piece)
                at, which = at[inside], which[inside]
                end = at + sizes[which]
                before = joined[begin + at - 1]
                doc = np.searchsorted(starts, begin + at, "right") - 1
                ok = hashes[end - width] == tail[which]
                ok &= free[which, 0] | (begin + at == 0) | (before == 32)
                ok &= free[which, 1] | (piece[end] == 32)
                ok &= begin + end < starts[np.minimum(doc + 1, len(parts))]
                for d, place, k in zip(doc[ok].tolist(), (begin + at[ok]).tolist(), members[which[ok]].tolist()):
                    first.setdefault((d, k), place)
        found = []
        for (d, k), place in first.items():
            i, item = self.items[k]
            word = parts[d].count(b" ", 0, place - int(starts[d]))
            found.append((d, i, 0, word, word + item.count(b" ") + 1))
        return found


def add_leaks(docs: DataFrame, items: DataFrame, text: str = "text", out: str = "leaks", item_key: str = "item_id",
              item_text: str = "text", least_words: int = MIN_WORDS) -> DataFrame:
    """Adds the leaked items of every document as array<struct<item_id, distance, first_word, end_word>>. Items of
    ``least_words`` to ``MIN_WORDS`` - 1 words are searched exactly."""
    rows = items.select(F.col(f"`{item_key}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("text")).where(
        "text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    parts = max(1, -(-size // MAX_ITEM_BYTES))
    part = F.pmod(F.xxhash64("id", "text"), F.lit(parts))
    found = [_search(docs, rows.where(part == k), least_words)(F.col(f"`{text}`").cast("string")) for k in range(parts)]
    return docs.withColumn(out, found[0] if parts == 1 else F.array_sort(F.concat(*found)))


def _search(docs: DataFrame, rows: DataFrame, least_words: int):
    """Function from texts to the leaks of some items."""
    held = rows.toArrow()
    words, first = word_hashes(held["text"])
    ids = held["id"].to_pylist()
    short = [(i, held["text"][i].as_py()) for i in np.flatnonzero(
        (np.diff(first) >= max(1, least_words)) & (np.diff(first) < EXACT_BELOW)).tolist()]
    # An item that is too short for the caller has no words to search for.
    shared = docs.sparkSession.sparkContext.broadcast(
        ([words[lo:hi] if hi - lo >= least_words else words[:0] for lo, hi in zip(first[:-1], first[1:])], short))

    @lean
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index, exact = Index(shared.value[0]), Exact(shared.value[1])
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(len(batch))]
            sizes = np.array([0 if t is None else t for t in pa.compute.binary_length(batch).to_pylist()])
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(np.cumsum(sizes[lo:]), PIECE, "right")) + lo)
                part = batch.slice(lo, hi - lo)
                leaks = index.leaks(*word_hashes(part))
                if exact.items:
                    best = {}
                    for doc, item, *place in sorted(leaks + exact.leaks(part.to_pylist())):
                        best.setdefault((doc, item), place)
                    leaks = [(*key, *place) for key, place in best.items()]
                for doc, item, distance, start, end in leaks:
                    found[lo + doc].append({"item_id": ids[item], "distance": distance, "first_word": start,
                                            "end_word": end})
                lo = hi
            yield pa.array(found, _LEAKS)

    return F.arrow_udf(run, "array<struct<item_id:bigint,distance:int,first_word:bigint,end_word:bigint>>")


_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("first_word", pa.int64()),
                             ("end_word", pa.int64())]))

"""Byte-level BPE encoding and decoding with a rank queue over a hierarchical bitmap.

A text is cut by a pattern; each match is merged on its own. The queue holds, per merge rank, a bucket of positions in
a linked list of parts; a hierarchy of 64-bit words marks the non-empty buckets, so find-first-set gives the next rank
in a few steps however long the match is. Positions whose pair has changed since they were queued are stale and
skipped. A match of n bytes takes O(n log n) time and O(n) memory.

Matches repeat, so their ids are kept in a table of bounded size per worker, and the new short matches of many texts
go through one queue together: matches do not touch each other, so the smallest rank of all is the smallest of each
match that holds it, and a bucket's first position of every match is merged in one numpy step. Long matches have a
queue to themselves.

Defined cases: a null text encodes to no ids, as an empty one does; null ids decode to no bytes; a null inside ids
is no id and raises an error, as does an id outside the vocabulary. The result column replaces a column of its name,
all other columns stay, and empty tables give empty tables.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from geoloom.llm.tables import hand_back, once

#: Ranks that a vocabulary may hold: what is sent to the executors is bounded by it.
MAX_RANKS = 1 << 20
#: Matches whose ids a worker keeps; longer matches (in bytes) have a queue to themselves and are not kept.
KEPT, SHORT = 1 << 18, 256
#: Characters of texts whose matches are held at once (a longer text alone).
PIECE = 1 << 21


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file with one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"More than {MAX_RANKS} ranks.")
    return ranks


class RankQueue:
    """Buckets per rank below a hierarchy of 64-bit words that marks those in use."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list] = {}
        self.levels = [[0] * ((ranks + 63) // 64 or 1)]
        while len(self.levels[-1]) > 1:
            self.levels.append([0] * ((len(self.levels[-1]) + 63) // 64))

    def bucket(self, rank: int) -> list:
        """The bucket of a rank, marked as in use."""
        bucket = self.buckets.get(rank)
        if bucket is None:
            bucket = self.buckets[rank] = []
            for level in self.levels:
                word, bit = rank >> 6, 1 << (rank & 63)
                marked = level[word]
                level[word] = marked | bit
                if marked:
                    break
                rank = word
        return bucket

    def first(self) -> int | None:
        """The smallest rank in use."""
        at = 0
        for level in reversed(self.levels):
            word = level[at]
            if not word:
                return None
            at = (at << 6) | ((word & -word).bit_length() - 1)
        return at

    def drop(self, rank: int) -> None:
        del self.buckets[rank]
        for level in self.levels:
            word = rank >> 6
            level[word] &= ~(1 << (rank & 63))
            if level[word]:
                return
            rank = word


def merge(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Ids of one match: the pair of lowest rank, leftmost first, is merged until no pair has a rank."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    pair: list[int | None] = [ranks.get(piece[i: i + 2]) for i in range(n - 1)] + [None]
    for i, rank in enumerate(pair):
        if rank is not None:
            heappush(queue.bucket(rank), i)
    while (rank := queue.first()) is not None:
        bucket = queue.buckets[rank]
        i = heappop(bucket)
        if not bucket:
            queue.drop(rank)
        if pair[i] != rank:
            continue
        gone = after[i]
        end = after[i] = after[gone]
        pair[gone] = None
        if end < n:
            before[end] = i
        pair[i] = ranks.get(piece[i: after[end]]) if end < n else None
        if pair[i] is not None:
            heappush(queue.bucket(pair[i]), i)
        left = before[i]
        if left >= 0:
            pair[left] = ranks.get(piece[left:end])
            if pair[left] is not None:
                heappush(queue.bucket(pair[left]), left)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i: after[i]]])
        i = after[i]
    return out


class PairRanks:
    """Rank of the joined bytes of two ids, or -1, for arrays of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = max(ranks.values(), default=0) + 1
        found = {(ranks[token[:cut]] * self.size + ranks[token[cut:]]): rank for token, rank in ranks.items()
                 for cut in range(1, len(token)) if token[:cut] in ranks and token[cut:] in ranks}
        self.keys = np.array(sorted(found), np.int64)
        self.ranks = np.array([found[k] for k in self.keys.tolist()] + [-1], np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], -1) if len(self.keys) else np.full(len(key), -1)


def merge_many(pieces: list[bytes], ranks: dict[bytes, int], pairs: PairRanks, queue: RankQueue) -> list[bytes]:
    """``merge`` for many matches that are no tokens themselves, through one queue; ids as packed 32-bit numbers."""
    lengths = np.array([len(p) for p in pieces])
    first = np.concatenate([[0], np.cumsum(lengths)])
    n = int(first[-1])
    piece = np.repeat(np.arange(len(pieces)), lengths)
    single = np.array([ranks.get(bytes([b]), -1) for b in range(256)])
    ids = single[np.frombuffer(b"".join(pieces), np.uint8)]
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[first[1:] - 1] = -1
    before[first[:-1]] = -1
    pair = np.full(n, -1)

    def queued(at: np.ndarray, rank: np.ndarray) -> None:
        """Sets the pairs at some positions and adds these to the buckets of their ranks."""
        pair[at] = rank
        at, rank = at[rank >= 0], rank[rank >= 0]
        if len(at) > 1:
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, lo, hi in zip(rank[[0, *cuts]].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(at)]):
                queue.bucket(r).append(at[lo:hi])
        elif len(at):
            queue.bucket(int(rank[0])).append(at)

    at = np.flatnonzero(after >= 0)
    queued(at, pairs(ids[at], ids[after[at]]))
    while (rank := queue.first()) is not None:
        at = queue.buckets[rank]
        at = np.sort(np.concatenate(at)) if len(at) > 1 else at[0]
        queue.drop(rank)
        at = at[pair[at] == rank]
        if len(at) > 1:
            leads = np.ones(len(at), bool)
            leads[1:] = piece[at[1:]] != piece[at[:-1]]
            if not leads.all():
                queue.bucket(rank).append(at[~leads])
                at = at[leads]
        if not len(at):
            continue
        gone = after[at]
        end = after[gone]
        after[at], ids[at], ids[gone], pair[gone], pair[at] = end, rank, -1, -1, -1
        on = end >= 0
        before[end[on]] = at[on]
        left = before[at]
        left = left[left >= 0]
        start = np.concatenate([left, at[on]])
        queued(start, pairs(ids[start], ids[after[start]]))
    live = np.flatnonzero(ids >= 0)
    ends = (4 * np.searchsorted(live, first)).tolist()
    flat = ids[live].astype(np.int32).tobytes()
    return [flat[lo:hi] for lo, hi in zip(ends[:-1], ends[1:])]


class Encoder:
    """Texts to ids, with a table from match to ids that is emptied when full."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.pairs, self.queue = PairRanks(ranks), RankQueue(max(ranks.values(), default=0) + 1)
        self.kept: dict[str, bytes] = {}

    def _learn(self, matches: set[str]) -> dict[str, bytes]:
        """Packed ids of all matches: the kept table, or a copy with the long matches."""
        if len(self.kept) + len(matches) > KEPT:
            self.kept = {}
        short, long = [], {}
        for match in matches - self.kept.keys():
            piece = match.encode()
            if piece in self.ranks:
                self.kept[match] = np.int32(self.ranks[piece]).tobytes()
            elif len(piece) > SHORT:
                long[match] = np.array(merge(piece, self.ranks, self.queue), np.int32).tobytes()
            else:
                short.append((match, piece))
        if short:
            names, pieces = zip(*short)
            self.kept.update(zip(names, merge_many(list(pieces), self.ranks, self.pairs, self.queue)))
        return {**self.kept, **long} if long else self.kept

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Packed ids of every text; the matches of some texts are held at once."""
        waiting, size = [], 0
        for text in texts:
            if waiting and size + len(text) > PIECE:
                yield from self._encode(waiting)
                waiting, size = [], 0
            waiting.append(self.find(text))
            size += len(text)
        yield from self._encode(waiting)

    def _encode(self, cut: list[list[str]]) -> Iterator[bytes]:
        known = self._learn(set().union(*cut))
        for matches in cut:
            yield b"".join(map(known.__getitem__, matches))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(next(self.encode_all([text])), np.int32)


def _packed(batch: pa.Array, encoder: Encoder) -> pa.Array:
    """Ids of a batch of texts as lists."""
    found = list(encoder.encode_all(t.as_py() or "" for t in batch))
    ends = np.cumsum([0, *map(len, found)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), np.int32)))


def _bytes(batch: pa.Array, tokens: dict[int, bytes]) -> pa.Array:
    """Bytes of a batch of lists of ids."""
    return pa.array((b"".join(map(tokens.__getitem__, x.values.to_numpy(zero_copy_only=False).tolist()))
                     if x.is_valid else b"" for x in batch), pa.binary())


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of a text column as array<int>."""
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = once(shared, lambda value: Encoder(*value))
        for batch in batches:
            yield _packed(batch, encoder)

    return df.withColumn(ids, F.arrow_udf(run, "array<int>")(F.col(f"`{text}`").cast("string")))


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Adds the bytes that ids stand for, as binary."""
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = {rank: token for token, rank in shared.value.items()}
        for batch in batches:
            yield _bytes(batch, tokens)

    return df.withColumn(data, F.arrow_udf(run, "binary")(F.col(f"`{ids}`")))


def round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids",
               data: str = "decoded") -> DataFrame:
    """``encode`` and then ``decode`` of its ids in one pass of the workers, where both are wanted."""
    shared = df.sparkSession.sparkContext.broadcast((ranks, pattern))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = once(shared, lambda value: Encoder(*value))
        tokens = {rank: token for token, rank in encoder.ranks.items()}
        try:
            for batch in batches:
                found = _packed(batch, encoder)
                yield pa.StructArray.from_arrays([found, _bytes(found, tokens)], ["ids", "data"])
        finally:
            hand_back()  # the encoder stays for the next task

    apply = F.arrow_udf(run, "struct<ids:array<int>,data:binary>")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in (ids, data)]
    both = df.select(F.struct(*kept).alias("kept"), apply(F.col(f"`{text}`").cast("string")).alias("found"))
    return both.select("kept.*", F.col("found.ids").alias(ids), F.col("found.data").alias(data))


def ids_text(ids: Column) -> Column:
    """Decimal ids joined by one space."""
    return F.array_join(ids.cast("array<string>"), " ")

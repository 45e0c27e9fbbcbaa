"""Removal of word sequences that earlier documents hold as well, by FM-indexes over shards of the text.

A document is streamed as overlapping segments: neighbouring windows of ``window`` words whose least hashed run of
``GRAM`` words (the minimizer) is the same one lie in one segment, of at most 2 * window - GRAM words. A segment goes to
the shard of its minimizer, so all places of one word sequence meet in one shard, wherever they lie, and a word is sent
about three times. In a shard,

1. segments whose minimizer occurs in one document only are left out: nothing else can hold their windows;
2. each distinct segment is indexed once, with the smallest document that holds it: suffix order, wavelet matrix of the
   Burrows-Wheeler transform, minima of documents over the suffix order (``fmindex``);
3. every segment is searched backward from each of its ends. The matching statistics say how many words up to there also
   occur in a smaller document; where they reach ``window``, the words of that window are to be removed.

Hot content: a segment that a piece of input holds several times is sent once, with the smallest of its documents; the
others are decided where they lie, as they have a smaller document beside them. So a passage in a third of all
documents reaches its shard once per piece. A first pass adds up what each group of minimizers (a bucket) would send;
the windows of overfull ones are dealt one by one, by the hash of the whole window, so a frequent minimizer with ever
different surroundings fills no shard. The table of overfull buckets has at most 4 * ``BUCKETS`` rows per shard.
Shards are made for about ``SHARD_BYTES`` of text each. Words and sequences are compared by 64-bit hashes.

Spans go back to their rows by document and hash of the text, in one join, for which texts travel compressed.

Defined cases: a null text has no words, an empty one neither; texts of fewer words than a window keep everything; rows
without a document id neither lose words nor make others lose any; of rows with one id none is smaller than the others,
so they keep what only they share, and each is judged on its own text. Repeats within one document are kept. Repeated
rows are answered each. Empty tables give empty tables. Columns named like the results are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.llm.fmindex import Index
from geoloom.llm.tables import lean
from geoloom.llm.words import CASED, hash_spans, mix, run_hashes, utf8, word_spans

WINDOW, GRAM = 13, 3
#: Text of a piece of input that is cut at once, in bytes (a longer text alone), and text per shard.
PIECE, SHARD_BYTES = 6 << 20, 1 << 23
#: Buckets per shard; a bucket is overfull when it alone would fill a quarter of a shard.
BUCKETS = 16
#: Words sent per word of text, about, and bytes of a word.
SENT, WORD_BYTES = 3, 6
SPANS = "array<struct<first_word:int,end_word:int>>"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ROW = "shard int, size int, packed binary, id long, text_hash long, first_word int, end_word int"


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    factors = mix(np.arange(1, size + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
    out = words[: len(words) - size + 1] * factors[0]
    for k in range(1, size):
        out += words[k: len(words) - size + 1 + k] * factors[k]
    return mix(out)


def segments(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end word, hash of the minimizer) of all segments of texts that start at ``first``."""
    gram = min(GRAM, window)
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = _grams(words, gram)
    n = len(words) - window + 1
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, window - gram + 1):
        better = grams[k: k + n] < best
        best[better], at[better] = grams[k: k + n][better], k
    at += np.arange(n)
    inside = np.flatnonzero(np.arange(n) + window <= np.repeat(first[1:], np.diff(first))[:n])
    fresh = np.ones(len(inside), bool)
    fresh[1:] = (np.diff(inside) > 1) | (at[inside[1:]] != at[inside[:-1]])
    begin = np.flatnonzero(fresh)
    last = np.append(begin[1:], len(inside))[: len(begin)] - 1
    return inside[begin], inside[last] + window, best[inside[begin]]


class Piece:
    """Some texts with their segments; equal ones are kept where their smallest document is."""

    def __init__(self, texts: pa.Array, ids: pa.Array, window: int):
        self.window, self.data = window, None
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        data, starts = utf8(texts)
        self.data = data.tobytes()
        self.begins, self.ends, self.first = word_spans(data, starts)
        self.words = hash_spans(data, self.begins, self.ends, CASED)
        begin, end, minimizer = segments(self.words, self.first, window)
        text = np.searchsorted(self.first, begin, "right") - 1
        keep = self.known[text]
        #: (text, first word, end word) of segments that a smaller document beside them holds.
        self.repeated: list[np.ndarray] = []
        self.begin, self.end, self.text, self.minimizer = self._smallest(begin[keep], end[keep], text[keep], minimizer[keep])

    def _smallest(self, begin, end, text, minimizer):
        content, ids = run_hashes(self.words, begin, end), self.ids[text]
        order = np.lexsort((ids, content))
        fresh = np.ones(len(order), bool)
        fresh[1:] = content[order[1:]] != content[order[:-1]]
        least = ids[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        again = order[ids[order] > least]
        if len(again):
            self.repeated.append(np.stack([text[again], begin[again], end[again]]))
        kept = order[ids[order] == least]
        return begin[kept], end[kept], text[kept], minimizer[kept]

    def deal_windows(self, overfull: np.ndarray) -> np.ndarray:
        """Cuts the segments marked by ``overfull`` into windows; says of every segment whether it is one of these."""
        begin, end, text, minimizer = [x[overfull] for x in (self.begin, self.end, self.text, self.minimizer)]
        n = end - begin - self.window + 1
        at = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        cut = self._smallest(at, at + self.window, np.repeat(text, n), run_hashes(self.words, at, at + self.window))
        whole = [x[~overfull] for x in (self.begin, self.end, self.text, self.minimizer)]
        self.begin, self.end, self.text, self.minimizer = [np.concatenate(x) for x in zip(whole, cut)]
        return np.arange(len(self.begin)) >= len(whole[0])


def pieces(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[tuple[Piece, np.ndarray]]:
    """Pieces of batches (id, text, hash of the text), with the hashes."""
    for batch in batches:
        upto = np.cumsum(pa.compute.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(upto):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + PIECE, "right")))
            part = batch.slice(lo, hi - lo)
            yield Piece(part.column(1), part.column(0), window), part.column(2).to_numpy(zero_copy_only=False)
            lo = hi


def pack(p: Piece, hashes: np.ndarray, chosen: np.ndarray) -> tuple[int, bytes]:
    """(plain size, compressed) segments with their minimizer, size, first word, document and text hash."""
    text, begin = p.text[chosen], p.begin[chosen]
    from_byte, to_byte = p.begins[begin], p.ends[p.end[chosen] - 1]
    plain = b"".join([
        np.int64(len(chosen)).tobytes(), (p.minimizer[chosen] >> np.uint64(32)).astype(np.uint32).tobytes(),
        (to_byte - from_byte).astype(np.uint32).tobytes(), (begin - p.first[text]).astype(np.int32).tobytes(),
        p.ids[text].tobytes(), hashes[text].astype(np.int64).tobytes(),
        *[p.data[a:b] for a, b in zip(from_byte.tolist(), to_byte.tolist())]])
    return len(plain), pa.Codec("zstd", 3).compress(plain, asbytes=True)


_COLUMNS = (np.uint32, np.uint32, np.int32, np.int64, np.int64)


def unpack(size: int, packed: bytes) -> tuple[list[np.ndarray], bytes]:
    """The columns that ``pack`` has written, and the texts as they follow each other."""
    plain = pa.Codec("zstd").decompress(packed, size, asbytes=True)
    n, out, at = int(np.frombuffer(plain, np.int64, 1)[0]), [], 8
    for kind in _COLUMNS:
        out.append(np.frombuffer(plain, kind, n, at).copy())
        at += n * np.dtype(kind).itemsize
    return out, plain[at:]


def _runs(owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of consecutive places of one owner begin and end, by index."""
    fresh = np.ones(len(at), bool)
    fresh[1:] = (np.diff(at) != 1) | (owner[1:] != owner[:-1])
    begin = np.flatnonzero(fresh)
    return begin, np.append(begin[1:], len(at))[: len(begin)] - 1


def search_shard(packed: list[tuple[int, bytes]], window: int) -> list[np.ndarray]:
    """(document, text hash, first word, end word) of what a shard's segments share with smaller documents."""
    # The texts are unpacked again, one part at a time, once it is known which segments stay.
    parts = [unpack(*p)[0] for p in packed]
    minimizer, size, start, ids, hashes = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 5
    order = np.argsort(minimizer, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(minimizer[order]) != 0])) if len(order) else order
    group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    shared = np.minimum.reduceat(ids[order], first) < np.maximum.reduceat(ids[order], first) if len(order) else order
    kept = np.zeros(len(order), bool)
    kept[order] = shared[group] if len(order) else False
    if not kept.any():
        return [np.zeros(0, np.int64)] * 4
    texts, at = [], 0
    for p, (_, sizes, *_) in zip(packed, parts):
        raw, upto, mine = unpack(*p)[1], np.concatenate([[0], np.cumsum(sizes.astype(np.int64))]), np.flatnonzero(kept[at: at + len(sizes)])
        texts += [raw[a:b] for a, b in zip(upto[mine].tolist(), upto[mine + 1].tolist())]
        at += len(sizes)
    data = np.frombuffer(b"".join(texts), np.uint8)
    del texts, parts, order, group, minimizer
    begins, ends, first = word_spans(data, np.concatenate([[0], np.cumsum(size[kept].astype(np.int64))]))
    words = hash_spans(data, begins, ends, CASED)
    start, ids, hashes = start[kept], ids[kept], hashes[kept]
    # Distinct segments, each with its smallest and largest document by rank.
    known, label = np.unique(ids, return_inverse=True)
    _, sample, content = np.unique(run_hashes(words, first[:-1], first[1:]), return_index=True, return_inverse=True)
    least, most = np.full(len(sample), len(known)), np.zeros(len(sample), np.int64)
    np.minimum.at(least, content, label)
    np.maximum.at(most, content, label)
    lengths = np.diff(first)[sample]
    at = np.repeat(first[:-1][sample], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    _, symbols = np.unique(words[at], return_inverse=True)
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    del data, begins, ends, words, at
    index = Index(symbols + 1, bounds, least)
    n = lengths - window + 1
    offset = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    place = bounds[owner] + owner + np.arange(len(owner)) - offset[owner] + window  # one separator per segment before
    length, found = index.matching(place, most[owner], window)
    found = np.where(length == window, found, len(known))
    # Every segment that was sent, with its windows.
    n = n[content]
    sent = np.repeat(np.arange(len(content)), n)
    which = np.arange(len(sent)) - np.repeat(np.cumsum(n) - n, n)
    gone = np.flatnonzero(found[offset[content[sent]] + which] < label[sent])
    sent, which = sent[gone], which[gone]
    begin, last = _runs(sent, which)
    sent = sent[begin]
    return [ids[sent], hashes[sent], start[sent] + which[begin], start[sent] + which[last] + window]


def _size(spark: SparkSession, docs: DataFrame) -> int:
    """Shards for the text of ``docs``."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // SHARD_BYTES))


def _overfull(docs: DataFrame, shards: int, window: int) -> np.ndarray:
    """Buckets of minimizers that would fill a quarter of a shard alone."""
    buckets = shards * BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, _ in pieces(batches, window):
            bucket, place = np.unique(p.minimizer % np.uint64(buckets), return_inverse=True)
            words = np.bincount(place, weights=p.end - p.begin, minlength=len(bucket))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(words.astype(np.int64))], ["bucket", "words"])

    full = SENT * SHARD_BYTES / WORD_BYTES / 4
    rows = docs.mapInArrow(run, "bucket long, words long").groupBy("bucket").agg(F.sum("words").alias("words")).where(
        F.col("words") > full).select("bucket").toArrow()
    return np.sort(rows["bucket"].to_numpy().astype(np.uint64))


def repeated_spans(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text_hash, spans) of all texts with words that a smaller document's window covers; spans in any order."""
    value = F.col(f"`{text}`").cast("string")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), value.alias("text"), F.xxhash64(value).alias("text_hash"))
    shards = _size(docs.sparkSession, rows)
    shared = docs.sparkSession.sparkContext.broadcast(_overfull(rows, shards, window))

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        overfull = shared.value
        for number, (p, hashes) in enumerate(pieces(batches, window)):
            bucket = p.minimizer % np.uint64(shards * BUCKETS)
            single = p.deal_windows(np.isin(bucket, overfull))
            shard = np.where(single, p.minimizer % np.uint64(shards), p.minimizer % np.uint64(shards * BUCKETS) // np.uint64(BUCKETS))
            order = np.argsort(shard, kind="stable")
            begin = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) != 0])) if len(order) else order
            sent = [pack(p, hashes, order[a:b]) for a, b in zip(begin, np.append(begin[1:], len(order)))]
            names = shard[order[begin]].astype(np.int32)
            nothing = [pa.nulls(len(sent), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([
                pa.array(names), pa.array([s for s, _ in sent], pa.int32()), pa.array([b for _, b in sent], pa.binary()), *nothing], _NAMES)
            for where, begin, end in p.repeated:
                n, base = len(where), p.first[where]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, (int(p.ids[0]) + number) % shards, np.int32)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                    pa.array(p.ids[where]), pa.array(hashes[where]), pa.array((begin - base).astype(np.int32)),
                    pa.array((end - base).astype(np.int32))], _NAMES)

    def search(table: pa.Table) -> pa.Table:
        sent = pa.compute.is_valid(table["packed"])
        packed = table.filter(sent).select(["size", "packed"])
        passed = table.filter(pa.compute.invert(sent)).select(_NAMES[3:])
        found = search_shard(list(zip(packed["size"].to_pylist(), packed["packed"].to_pylist())), window)
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.concat_tables([passed, pa.table([pa.array(c).cast(t) for c, t in zip(found, types)], names=_NAMES[3:])])

    spans = rows.mapInArrow(cut, _ROW).groupBy("shard").applyInArrow(search, "id long, text_hash long, first_word int, end_word int")
    # Spans of repeated rows are equal, so a set holds no more than one text's.
    return spans.groupBy("id", "text_hash").agg(F.collect_set(F.struct("first_word", "end_word")).alias("spans"))


_NAMES = ["shard", "size", "packed", "id", "text_hash", "first_word", "end_word"]


def without_words(text: bytes | None, spans: list[dict] | None) -> tuple[int, int, bytes, list[dict]]:
    """(words, words in spans, the other words with a space between, spans joined and in order)."""
    words = (text or b"").split()
    joined: list[dict] = []
    for s in sorted(spans or (), key=lambda s: (s["first_word"], s["end_word"])):
        if joined and s["first_word"] <= joined[-1]["end_word"]:
            joined[-1]["end_word"] = max(joined[-1]["end_word"], s["end_word"])
        else:
            joined.append(dict(s))
    kept, at, gone = [], 0, 0
    for s in joined:
        kept += words[at: s["first_word"]]
        at, gone = s["end_word"], gone + s["end_word"] - s["first_word"]
    return len(words), gone, b" ".join(kept + words[at:]), joined


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds ``n_words``, ``n_removed``, ``kept`` (the text without repeats) and ``removed`` (spans of words) to all rows."""
    given = docs.drop("n_words", "n_removed", "kept", "removed")
    spans = repeated_spans(given, window, key, text).select(
        F.col("id").alias("_id"), F.col("text_hash").alias("_text_hash"), F.col("spans").alias("_spans"))

    def shrink(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            plain = [None if t is None else t.encode() for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([
                pa.array([len(p or b"") for p in plain], pa.int32()),
                pa.array([p and pa.Codec("zstd", 3).compress(p, asbytes=True) for p in plain], pa.binary())], ["size", "data"])

    @lean
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            rows = [without_words(t["data"] and pa.Codec("zstd").decompress(t["data"], t["size"], asbytes=True), s)
                    for t, s in zip(texts.to_pylist(), found.to_pylist())]
            n, gone, kept, joined = zip(*rows) if rows else ([], [], [], [])
            yield pa.StructArray.from_arrays([
                pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                pa.array(joined, _SPANS)], ["n_words", "n_removed", "kept", "removed"])

    apply = F.arrow_udf(run, f"struct<n_words:bigint,n_removed:bigint,kept:string,removed:{SPANS}>")
    value = F.col(f"`{text}`").cast("string")
    packed = given.withColumns({"_hash": F.xxhash64(value), "_text": F.arrow_udf(shrink, "struct<size:int,data:binary>")(value)})
    joined = packed.join(spans.hint("shuffle_hash"), (F.col(f"`{key}`").cast("long") == F.col("_id")) & (F.col("_hash") == F.col("_text_hash")), "left")
    return joined.withColumn("_found", apply("_text", "_spans")).select(
        *[F.col(f"`{c}`") for c in given.columns], *[F.col(f"_found.{c}") for c in ("n_words", "n_removed", "kept", "removed")])


_SPANS = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32())]))

"""N-gram Jaccard join: documents whose sets of five-word shingles overlap by 80 percent of their union, and their
groups.

1. One pass over the texts gives every document's set size and digest (equal sets are one node from here on, so exact
   copies cost nothing more) and counts all shingles by hash bucket. The counts, whose number is bounded, give each
   bucket a frequency level, so tokens can be put in a global order with rare ones first.
2. A second pass indexes the signatures of each set's extended prefix: single rare tokens and combinations of two
   frequent ones (see ``signatures``). Signatures held by one node are dropped; their number tells how many tokens a
   node shares with nobody, which bounds its overlap with any other.
3. In each signature's group all nodes are compared with the node that has least tokens of its own. Sets are fetched
   for these pairs only and compared exactly. Links are joined to components.
4. Pairs of one group that lie in different components, and whose overlap could still suffice by both nodes' own
   tokens and their overlap with the group's first node, are compared exactly as well. So no link between different
   components is missed, and pairs inside a component are never enumerated.

A group's pairs are formed by row blocks in numpy; shared signatures are kept by buckets of bounded expected size. The
rows of one signature (24 bytes a node) must fit a task. Nothing of the documents reaches the driver but counts and the
bounded table of levels.

Defined cases: texts that are null or hold no word have an empty set and link with nothing; shorter texts than five
words are one shingle; documents whose key is null have no component and link with nothing; repeated rows are one node
and each get the component. Empty tables give empty tables; other columns of the documents are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from geoloom.llm.components import components
from geoloom.llm.signatures import PAIRED_FROM, PERCENT, digests, distinct_sets, signatures
from geoloom.llm.tables import lean, small_batches, stored, text_pieces
from geoloom.llm.words import shingle_hashes, word_hashes

SHINGLE = 5
#: Bytes of text per hash bucket of the frequency table, and bounds of its size as powers of two (one byte each).
BYTES_PER_BUCKET, TABLE_BITS = 64, (16, 26)
BLOCK_BITS = 16
#: Expected signatures per bucket of the index.
BUCKET_ROWS = 1_000_000
#: Keys of fetched documents are broadcast up to this number, and joined by a shuffle beyond it.
BROADCAST_KEYS = 2_000_000
#: Texts of an Arrow batch that are handled at once, in bytes (a longer text alone).
PIECE = 1 << 22
#: Pairs of rows of groups that are compared at once (a row with more partners alone).
ROWS_AT_ONCE = 1 << 19


def pieces(batch: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """A text column in parts of bounded size, each with the number of its first row."""
    return text_pieces(batch, PIECE)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, ascending, and each text's first (one more entry at the end)."""
    return distinct_sets(*shingle_hashes(*word_hashes(texts), SHINGLE))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sizes_and_counts(docs: DataFrame, bits: int) -> DataFrame:
    """Per document (kind 0) key, node and size; per task (kind 1) the bucket counts in compressed blocks."""
    blocks = 1 << (bits - BLOCK_BITS)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            for lo, part in pieces(batch.column(1)):
                values, first = shingle_sets(part)
                at, n = np.unique((values >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
                counts[at] += np.minimum(n, np.iinfo(np.uint16).max - counts[at]).astype(np.uint16)
                rows = len(part)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(rows, np.int32)), batch.column(0).slice(lo, rows), _signed(digests(values, first)),
                    pa.array(np.diff(first)), pa.nulls(rows, pa.binary())], _PASS)
        found = [(b, counts[b << BLOCK_BITS: (b + 1) << BLOCK_BITS]) for b in range(blocks)]
        found = [(b, c.tobytes()) for b, c in found if c.any()]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.ones(len(found), np.int32)), pa.array([b for b, _ in found], pa.int64()),
            pa.nulls(len(found), pa.int64()), pa.nulls(len(found), pa.int64()),
            pa.array([pa.compress(c, codec="zstd", asbytes=True) for _, c in found], pa.binary())], _PASS)

    return docs.mapInArrow(run, "kind int, key long, node long, size long, counts binary")


_PASS = ["kind", "key", "node", "size", "counts"]


def levels(counts: DataFrame, bits: int) -> np.ndarray:
    """Frequency level (twice the base-2 logarithm of the count) of every hash bucket."""
    size = 1 << BLOCK_BITS

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for c in batch.column(1).to_pylist():
                total += np.frombuffer(pa.decompress(c, 2 * size, codec="zstd", asbytes=True), np.uint16)
        level = np.floor(2 * np.log2(np.maximum(total, 1))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([
            pa.array([key[0].as_py()]), pa.array([int(total.sum())]),
            pa.array([pa.compress(level.tobytes(), codec="zstd", asbytes=True)], pa.binary())], ["block", "n", "level"])

    held = counts.select(F.col("key").alias("block"), "counts").groupBy("block").applyInArrow(
        add, "block long, n long, level binary").toArrow()
    out = np.zeros(1 << bits, np.uint8)
    for block, level in zip(held["block"].to_pylist(), held["level"].to_pylist()):
        out[block << BLOCK_BITS: (block + 1) << BLOCK_BITS] = np.frombuffer(
            pa.decompress(level, size, codec="zstd", asbytes=True), np.uint8)
    return out


def frequent_level(total: int, bits: int) -> int:
    """Level from which tokens are paired: well above the count that buckets have by chance."""
    return int(np.ceil(2 * np.log2(4 * total / (1 << bits) + 32)))


def index(docs: DataFrame, table: np.ndarray, frequent: int, buckets: int) -> DataFrame:
    """Shared signatures (kind 1: sig, node, and in ``n`` what it is, see ``signatures``) and nodes (kind 0: node, size
    in ``n``, and in ``more`` the numbers of single tokens of both prefixes and where these end)."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in pieces(batch.column(0)):
                values, first = shingle_sets(part)
                node, size = digests(values, first), np.diff(first)
                _, lead = np.unique(node, return_index=True)
                once = np.zeros(len(node), bool)
                once[lead] = True
                sig, owner, what, ends = signatures(values, first, shared.value, frequent)
                keep = once[owner]
                sig, owner, what = sig[keep], owner[keep], what[keep]
                bucket = (sig >> np.uint64(32)).astype(np.int64) * buckets >> 32
                # The two low bits say what the signature is.
                low = (sig & np.uint64(0xFFFFFFFC)).astype(np.uint32) | what.astype(np.uint32)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = [(b, low[o].tobytes(), node[owner[o]].tobytes()) for b in range(buckets)
                        if len(o := order[cuts[b]: cuts[b + 1]])]
                singles = [np.bincount(owner[what == w], minlength=len(node)) for w in (1, 2)]
                at = np.flatnonzero(once & (size > 0))
                rows.append((-1 - int(node[at[0]] % np.uint64(buckets)) if len(at) else -1,
                             np.stack([size[at], *[x[at] for x in singles], *ends[at].T], 1).tobytes(), node[at].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(
                    zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "sigs", "nodes"])

    def group(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = key[0].as_py()
        sigs, nodes = [], []
        for batch in batches:
            sigs += batch.column(1).to_pylist()
            nodes += batch.column(2).to_pylist()
        node = np.frombuffer(b"".join(nodes), np.uint64)
        if bucket < 0:
            more = np.frombuffer(b"".join(sigs), np.int64).reshape(-1, 5)
            yield _rows(0, np.zeros(len(node), np.int64), node, more[:, 0].copy(), more[:, 1:])
            return
        low = np.frombuffer(b"".join(sigs), np.uint32)
        # Sorted by signature, then node; which of a repeated pair stays does not matter.
        order = np.lexsort((node, low & np.uint32(0xFFFFFFFC)))
        low, node = low[order], node[order]
        sig = (low >> np.uint32(2)).astype(np.int64)
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node, what = sig[new], node[new], (low[new] & np.uint32(3)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, int)
        held = np.diff(np.append(start, len(sig)))
        keep = np.repeat(held > 1, held)
        yield _rows(1, (np.int64(bucket) << 30) + sig[keep], node[keep], what[keep], np.zeros((keep.sum(), 0), np.int64))

    return docs.mapInArrow(run, "bucket int, sigs binary, nodes binary").groupBy("bucket").applyInArrow(
        group, "kind int, sig long, node long, n long, more array<long>")


def _rows(kind: int, sig, node, n, more) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(more) + 1, dtype=np.int32) * more.shape[1]), pa.array(more.ravel()))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(node), kind, np.int32)), pa.array(sig), _signed(np.ascontiguousarray(node)), pa.array(n), lists],
        ["kind", "sig", "node", "n", "more"])


def size_level(size: Column) -> Column:
    return F.length(F.bin(size)).cast("long") - 1


def at_level(node: Column, level: Column) -> Column:
    """Where a node's prefix at a size level ends and how many tokens are left but its lone ones, else null."""
    own, low = (F.struct(node[f"{p}ends"].alias("ends"), node[f"{p}free"].alias("free")) for p in ("", "low_"))
    return F.when(node["level"] == level, own).when(node["low_level"] == level, low)


def could_link(x: Column, y: Column) -> Column:
    """Whether two nodes (structs as in ``about``) can reach the threshold. Of two sets that are indexed at the
    smaller one's size level, the one whose prefix ends first shares none of its lone prefix tokens with the other."""
    level = F.least(x["level"], y["level"])
    a, b = at_level(x, level), at_level(y, level)
    bound = F.when(a["ends"] <= b["ends"], a["free"]).otherwise(b["free"])
    bound = F.least(x["size"], y["size"], F.when(a.isNotNull() & b.isNotNull(), bound))
    return bound * (100 + PERCENT) >= PERCENT * (x["size"] + y["size"])


def overlaps(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) of nodes with the sizes of their sets and of their intersection, by fetching the sets of one
    document per node. ``docs`` has key and text, ``nodes`` node and key."""
    asked = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    keys = stored(nodes.join(asked, "node").select("key", "node"), "keys")
    wanted = keys.select("key").distinct()
    wanted = F.broadcast(wanted) if keys.count() <= BROADCAST_KEYS else wanted

    @lean
    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in pieces(batch.column(0)):
                values, first = shingle_sets(part)
                data, at = values.tobytes(), (8 * first).tolist()
                yield pa.RecordBatch.from_arrays([
                    _signed(digests(values, first)), pa.array([data[i:j] for i, j in zip(at[:-1], at[1:])], pa.binary())],
                    ["node", "tokens"])

    fetched = docs.join(wanted, "key", "left_semi").select("text").mapInArrow(fetch, "node long, tokens binary")
    fetched = fetched.join(F.broadcast(asked) if keys.count() <= BROADCAST_KEYS else asked, "node", "left_semi")
    with small_batches(docs.sparkSession):
        sets = stored(fetched.groupBy("node").agg(F.first("tokens").alias("tokens")), "sets")

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in (2, 3)]
            found = [(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))) for x, y in zip(*both)]
            n = np.array(found, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, n.T.copy())],
                                             ["a", "b", "size_a", "size_b", "overlap"])

    left, right = (sets.select(F.col("node").alias(c), F.col("tokens").alias(f"tokens_{c}")) for c in "ab")
    return pairs.join(right, "b").join(left, "a").select("a", "b", "tokens_a", "tokens_b").mapInArrow(
        compare, "a long, b long, size_a long, size_b long, overlap long")


def links_of(compared: DataFrame) -> DataFrame:
    return compared.where(100 * F.col("overlap") >= PERCENT * (F.col("size_a") + F.col("size_b") - F.col("overlap")))


def cross_pairs(rows: DataFrame, frequent: int) -> DataFrame:
    """Pairs of nodes of one group that are in different components and could still link. ``rows`` has sig, x and lead
    (structs as in ``about``), root, and the overlap of x with the lead (null if they were not compared)."""
    names = ("node", "size", "level", "low_level", "ends", "low_ends", "free", "low_free")

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        order = np.argsort(table["sig"].to_numpy(), kind="stable")
        sig, root = (table[c].to_numpy()[order] for c in ("sig", "root"))
        overlap = table["overlap"].fill_null(-1).to_numpy()[order]
        x_of, lead_of = (dict(zip(names, (pa.compute.struct_field(table[c], n).to_numpy()[order] for n in names)))
                         for c in ("x", "lead"))
        size, node, level = x_of["size"], x_of["node"], x_of["level"]
        held, found = np.diff(np.append(np.flatnonzero(np.append(True, sig[1:] != sig[:-1])), len(sig))), []
        group_rows = np.repeat(held, held)
        first = np.repeat(np.cumsum(held) - held, held)
        done = np.cumsum(group_rows)

        def entry(of: dict, at: np.ndarray, wanted: np.ndarray):
            """Whether the nodes are indexed at the level, where their prefixes end, and their tokens but lone ones."""
            own = of["level"][at] == wanted
            return (own | (of["low_level"][at] == wanted), np.where(own, of["ends"][at], of["low_ends"][at]),
                    np.where(own, of["free"][at], of["low_free"][at]))

        i = 0
        while i < len(sig):
            j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + ROWS_AT_ONCE, "right")))
            n = group_rows[i:j]
            x = np.repeat(np.arange(i, j), n)
            y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + first[x]
            near = (x < y) & (root[x] != root[y]) & (
                np.minimum(size[x], size[y]) * 100 >= PERCENT * np.maximum(size[x], size[y]))
            x, y = x[near], y[near]
            at = np.minimum(level[x], level[y])
            (has_x, end_x, free_x), (has_y, end_y, free_y) = entry(x_of, x, at), entry(x_of, y, at)
            swap = end_x > end_y
            x, y = np.where(swap, y, x), np.where(swap, x, y)  # the prefix of x ends first
            both, free, end = has_x & has_y, np.where(swap, free_y, free_x), np.minimum(end_x, end_y)
            # Where frequent tokens are paired, lone tokens are rare ones, so a prefix that reaches frequent tokens would
            # hold any lone token of the other node.
            rare_only = at >= PAIRED_FROM
            free_later = np.where(swap, free_x, free_y)
            wide = both & rare_only & (end >> 56 >= frequent)
            bound = np.where(both, free, np.minimum(size[x], size[y]))
            bound = np.where(wide, np.minimum(bound, free_later), bound)
            # By the overlaps with the lead: what both share with it, and what else they may share. The lone tokens of
            # x are not among the latter, nor in the lead, if its prefix ends later still.
            has_lead, end_lead, _ = entry(lead_of, x, at)
            apart = has_lead & rare_only & (end_lead >> 56 >= frequent)
            lone_x = np.where(both & has_lead & (apart | (end <= end_lead)) & (node[x] != lead_of["node"][x]), size[x] - free, 0)
            lone_y = np.where(wide & apart & (node[y] != lead_of["node"][y]), size[y] - free_later, 0)
            closer = np.minimum(overlap[x], overlap[y]) + np.minimum(
                size[x] - overlap[x] - lone_x, size[y] - overlap[y] - lone_y)
            known = (overlap[x] >= 0) & (overlap[y] >= 0)
            bound = np.where(known, np.minimum(bound, closer), bound)
            ok = bound * (100 + PERCENT) >= PERCENT * (size[x] + size[y])
            found.append(np.unique(np.sort(np.stack([node[x[ok]], node[y[ok]]], 1), axis=1), axis=0))
            i = j
        pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    return rows.select(F.shiftright("sig", 30).alias("bucket"), "sig", "x", "lead", "root", "overlap").groupBy(
        "bucket").applyInArrow(run, "a long, b long").distinct()


def _known(pairs: DataFrame, about: DataFrame) -> DataFrame:
    """Adds what is known of the nodes in the columns node and lead, as x and lead_x."""
    return pairs.join(about, "node").join(about.select(F.col("node").alias("lead"), F.col("x").alias("lead_x")), "lead")


def similar_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_shingles, component_id (the smallest key of its group), and n_links, the links
    found from its set to other sets (the ones that were needed to find the groups)."""
    given = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    total = given.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(total, 1) / BYTES_PER_BUCKET)), *TABLE_BITS))
    with small_batches(docs.sparkSession):
        passed = stored(sizes_and_counts(given, bits), "passed")
    sizes = passed.where("kind = 0").select("key", "node", "size")
    linkable = sizes.where("key IS NOT NULL AND size > 0")
    nodes = stored(linkable.groupBy("node").agg(F.min("key").alias("key")), "nodes")
    table = levels(passed.where("kind = 1"), bits)
    tokens = linkable.agg(F.sum("size")).collect()[0][0] or 0
    buckets = max(1, -(-tokens // (3 * BUCKET_ROWS)))
    frequent = frequent_level(tokens, bits)
    with small_batches(docs.sparkSession):
        indexed = stored(index(given.where("key IS NOT NULL").select("text"), table, frequent, buckets), "index")
    rows = indexed.where("kind = 1")
    shared = rows.groupBy("node").agg(F.count_if(F.col("n") == 1).alias("shared"), F.count_if(F.col("n") == 2).alias("low_shared"))
    about = indexed.where("kind = 0").groupBy("node").agg(F.max("n").alias("size"), F.max("more").alias("more")).join(
        shared, "node")
    one_level = F.col("level") == F.col("low_level")
    about = about.withColumn("level", size_level(F.col("size"))).withColumn(
        "low_level", size_level(F.expr(f"(size * {PERCENT} + 99) div 100"))).select("node", F.struct(
            "node", "size", "level", "low_level", F.col("more")[2].alias("ends"), F.col("more")[3].alias("low_ends"),
            (F.col("size") - F.col("more")[0] + F.col("shared")).alias("free"),
            F.when(one_level, F.col("size") - F.col("more")[0] + F.col("shared")).otherwise(
                F.col("size") - F.col("more")[1] + F.col("low_shared")).alias("low_free")).alias("x"))
    # Each group's first node is the one with the smallest share of lone tokens. Rows keep no more than the two nodes;
    # what is known of these is joined where a pair is tested.
    about = stored(about, "about")
    ranked = rows.select("sig", "node").join(about.select("node", F.struct(
        -F.col("x.free") / F.col("x.size"), "node").alias("rank")), "node")
    lead = ranked.groupBy("sig").agg(F.min_by("node", "rank").alias("lead"))
    rows = stored(ranked.select("sig", "node").join(lead, "sig"), "groups")
    first = _known(rows.where("node <> lead").select("node", "lead").distinct(), about).where(could_link(F.col("x"), F.col("lead_x")))
    compared = stored(overlaps(given, nodes, stored(first.select(
        F.col("lead").alias("a"), F.col("node").alias("b")), "pairs")), "compared")
    roots = components(links_of(compared).select("a", "b"))
    rooted = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    live = rooted.join(split.select("sig"), "sig", "left_semi").withColumn("a", F.col("lead")).join(
        compared.select("a", F.col("b").alias("node"), "overlap"), ["a", "node"], "left")
    live = _known(live, about).select("sig", "x", F.col("lead_x").alias("lead"), "root", F.when(
        F.col("a") == F.col("node"), F.col("x.size")).otherwise(F.col("overlap")).alias("overlap"))
    both_ways = compared.select("a", "b").unionByName(compared.select(F.col("b").alias("a"), F.col("a").alias("b")))
    further = stored(overlaps(given, nodes, stored(cross_pairs(live, frequent).join(
        both_ways, ["a", "b"], "left_anti"), "pairs")), "compared")
    links = links_of(compared.unionByName(further)).select("a", "b")
    roots = components(links)
    smallest = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = smallest.select("node", "root").join(
        smallest.groupBy("root").agg(F.min("key").alias("component")), "root").select("node", "component")
    ends = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    known = smallest.join(ends, "node", "left")
    return sizes.join(known, "node", "left").select(
        F.col("key").alias(key), F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.when(F.col("key").isNotNull(), F.col("component"))).otherwise(F.col("key")).alias(
            "component_id"), F.when(F.col("key").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))

"""Merkle trees over the rows of a table, with one multiproof per block of leaves.

Rows of a group, in order, are the leaves of the group's tree: every run of ``FAN`` nodes of a level (the last one
shorter) hashes to a node of the next level until one is left. The roots of the groups, in order, are the leaves of a
tree above. Digests are lowercase hex SHA-256 over hex text.

1. Leaves are stored in ranges by group and order; every ``BLOCK`` of consecutive leaves is one unit of work, whatever
   groups it holds, so a hot group lies in many blocks and small groups share one.
2. A block hashes all subtrees that it holds completely and gives the largest of them. Only the few nodes whose runs
   lie across blocks are put together by grouping, level by level.
3. Octopus multiproof: from the places of its leaves alone a block computes the least set of nodes that the proofs of
   all its leaves need and that it cannot derive: at most ``FAN`` - 1 on either side of every level. They are fetched
   by one join, shared inner nodes are derived from them, and every leaf's own proof is written out locally.

A proof has one entry per level from leaf to root: the run's digests to the left and to the right of the path. No step
holds more than a block or one level of its edges; the number of levels is all that the driver reads.

Defined cases: null values have their own mark in a leaf's text, and null groups and keys are values like any other,
ordered first; rows that agree in group and order are ordered by their digest, so repeated rows have adjacent
leaves, of which each keeps its own proof; empty texts have length 0; a tree of one leaf is that leaf and its proof is
empty. Empty tables give empty trees. Columns named like a result's are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from geoloom.llm.tables import stored

FAN = 16
#: Consecutive leaves of one unit of work, as a power of two.
BLOCK_BITS = 12
#: Leaves of a stored range, about.
RANGE_ROWS = 1 << 18
PATH = "array<struct<left:string,right:string>>"
_PLACE_BITS = 33
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(*values: Column) -> Column:
    """Digest of a row by its values, in order."""
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, level: F.sha2(F.concat(level["left"], node, level["right"]), 256))


def proof_text(proof: Column) -> Column:
    """All digests of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda level: F.concat(level["left"], level["right"])), "")


def _node(run: list[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


def _runs(nodes: list[str], lo: int, first: int, last: int) -> list[str]:
    """Nodes above the runs ``first`` to ``last`` - 1, of nodes that start at place ``lo``."""
    return [_node(nodes[j * FAN - lo: (j + 1) * FAN - lo]) for j in range(first, last)]


def largest_subtrees(nodes: list[str], lo: int, total: int) -> Iterator[tuple[int, int, str]]:
    """(level, place, digest) of the largest subtrees over leaves ``lo`` onwards of a tree of ``total`` leaves."""
    level = 0
    while True:
        hi = lo + len(nodes)
        first, last = -(-lo // FAN), hi // FAN if hi < total else -(-total // FAN)
        if total == 1 or first >= last:
            yield from ((level, lo + i, x) for i, x in enumerate(nodes))
            return
        yield from ((level, i, nodes[i - lo]) for i in range(lo, min(first * FAN, hi)))
        yield from ((level, i, nodes[i - lo]) for i in range(last * FAN, hi))
        nodes, lo, total, level = _runs(nodes, lo, first, last), first, -(-total // FAN), level + 1


def missing_nodes(lo: int, hi: int, total: int) -> Iterator[tuple[int, int]]:
    """(level, place) of the nodes that the proofs of leaves ``lo`` to ``hi`` - 1 need beyond these leaves."""
    level = 0
    while total > 1:
        left, right = lo // FAN * FAN, min(-(-hi // FAN) * FAN, total)
        yield from ((level, i) for i in [*range(left, lo), *range(hi, right)])
        lo, hi, total, level = left // FAN, -(-right // FAN), -(-total // FAN), level + 1


def proofs(leaves: list[str], lo: int, total: int, fetched: dict[tuple[int, int], str], above: list) -> list[list[dict]]:
    """Proofs of the leaves from place ``lo`` on, each followed by the group's own proof ``above``."""
    levels = []  # per level: its first known place and the known nodes
    nodes, level = leaves, 0
    while total > 1:
        hi = lo + len(nodes)
        left, right = lo // FAN * FAN, min(-(-hi // FAN) * FAN, total)
        nodes = [fetched[level, i] for i in range(left, lo)] + nodes + [fetched[level, i] for i in range(hi, right)]
        levels.append((lo, hi, left, nodes))
        nodes, lo, total, level = _runs(nodes, left, left // FAN, -(-right // FAN)), left // FAN, -(-total // FAN), level + 1
    known: list[list[dict]] = [above]  # the proofs of the nodes of the level above
    base = 0
    for lo, hi, left, nodes in reversed(levels):
        up, known, up_base = known, [], base
        for i in range(lo, hi):
            run = i // FAN * FAN - left
            entry = {"left": "".join(nodes[run: i - left]), "right": "".join(nodes[i - left + 1: run + FAN])}
            known.append([entry, *up[i // FAN - up_base]])
        base = lo
    return known if levels else [above] * len(leaves)


@dataclass(frozen=True)
class Forest:
    """One tree per group. ``leaves``: all columns, ``_group``, ``_id``; ``segments``: the places of a block's leaves
    in a group's tree (_block, _group, _first, _rows, _lo, _total); ``nodes``: what multiproofs can ask for."""

    leaves: DataFrame
    segments: DataFrame
    nodes: DataFrame

    def roots(self) -> DataFrame:
        """(_group, _total, digest) of every tree."""
        return self.nodes.where("_top = level").select("_group", "_total", "digest")


def _block() -> Column:
    return F.shiftright("_id", BLOCK_BITS)


def plant(rows: DataFrame, group: str | None, order: list[str], digest: str = "leaf") -> Forest:
    """Builds the trees of ``rows``, whose column ``digest`` holds each one's digest."""
    key = F.lit(0) if group is None else F.col(f"`{group}`")
    held = stored(rows.withColumn("_group", F.struct(key.alias("value"))), "rows")
    by = ["_group", *[f"`{c}`" for c in order], f"`{digest}`"]
    ranges = max(1, -(-held.count() // RANGE_ROWS))
    dealt = held.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(ranges, *by, "_row")
    leaves = stored(dealt.sortWithinPartitions(*by, "_row").drop("_row").withColumn(
        "_id", F.monotonically_increasing_id()), "leaves")
    segments = stored(_segments(leaves), "segments")
    frontier = stored(leaves.select(_block().alias("_block"), "_id", F.col(f"`{digest}`").alias("digest")).groupBy("_block").cogroup(
        segments.groupBy("_block")).applyInArrow(_subtrees, "_block long, _first int, level int, place long, digest string"), "frontier")
    frontier = frontier.join(segments.select("_block", "_first", "_group", "_total"), ["_block", "_first"]).select(
        "_group", "_total", "level", "place", "digest")
    return Forest(leaves, segments, _with_joined(frontier, segments))


def _segments(leaves: DataFrame) -> DataFrame:
    """Places of every block's leaves, counted by stored range first, so that no window holds all blocks of a group
    but those of one range."""
    sizes = leaves.groupBy(_block().alias("_block"), "_group").agg(
        F.min(F.col("_id").bitwiseAND((1 << BLOCK_BITS) - 1)).cast("int").alias("_first"), F.count("*").alias("_rows"))
    sizes = sizes.withColumn("_range", F.shiftright("_block", _PLACE_BITS - BLOCK_BITS))
    ranges = sizes.groupBy("_range", "_group").agg(F.sum("_rows").alias("_sum"))
    along = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_range", "_group", F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_before"),
                           F.sum("_sum").over(Window.partitionBy("_group")).alias("_total"))
    within = Window.partitionBy("_range", "_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.join(ranges, ["_range", "_group"]).select(
        "_block", "_group", "_first", "_rows", "_total",
        (F.col("_before") + F.coalesce(F.sum("_rows").over(within), F.lit(0))).alias("_lo"))


def _by_place(table: pa.Table) -> tuple[np.ndarray, list[str], np.ndarray]:
    """(order of the leaves, digests in order, place within the block in order)."""
    ids = table["_id"].to_numpy()
    order = np.argsort(ids)
    return order, table["digest"].take(order).to_pylist(), ids[order] & ((1 << BLOCK_BITS) - 1)


def _subtrees(leaves: pa.Table, segments: pa.Table) -> pa.Table:
    _, digests, _ = _by_place(leaves)
    out: list[tuple] = []
    for s in segments.to_pylist():
        nodes = digests[s["_first"]: s["_first"] + s["_rows"]]
        out += [(s["_block"], s["_first"], *node) for node in largest_subtrees(nodes, s["_lo"], s["_total"])]
    columns = list(zip(*out)) or [[]] * 5
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(["_block", "_first", "level", "place", "digest"], columns, types)})


def _with_joined(frontier: DataFrame, segments: DataFrame) -> DataFrame:
    """The blocks' nodes and those above runs that lie across blocks; ``_top`` is the level of a tree's root."""
    most = segments.agg(F.max("_total")).first()[0] or 1
    widths = [FAN ** k for k in range(40) if k == 0 or FAN ** (k - 1) < most]

    def width(level: int) -> Column:
        return F.ceil(F.col("_total") / F.lit(widths[level]))

    top = sum((F.when(F.col("_total") > w, 1).otherwise(0) for w in widths), F.lit(0))
    known = [frontier]
    for level in range(len(widths) - 1):
        here = [t.where((F.col("level") == level) & (width(level) > 1)) for t in (frontier, *known[1:][-1:])]
        runs = (here[0] if len(here) == 1 else here[0].unionByName(here[1])).groupBy(
            "_group", "_total", F.floor(F.col("place") / FAN).alias("place")).agg(
            F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("run"))
        known.append(stored(runs.select("_group", "_total", F.lit(level + 1).alias("level"), "place", F.sha2(
            F.array_join("run.digest", ""), 256).alias("digest")), "nodes"))
    nodes = known[0]
    for more in known[1:]:
        nodes = nodes.unionByName(more)
    return nodes.withColumn("_top", top)


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, out = batch.to_pydict(), []
        for i, (lo, n, total) in enumerate(zip(rows["_lo"], rows["_rows"], rows["_total"])):
            out += [(i, *node) for node in missing_nodes(lo, lo + n, total)]
        at, level, place = zip(*out) if out else ([], [], [])
        kept = batch.select(["_block", "_first", "_group"]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(level, pa.int32()), pa.array(place, pa.int64())],
                                         ["_block", "_first", "_group", "level", "place"])


def prove(forest: Forest, above: DataFrame | None = None, digest: str = "leaf", out: str = "proof") -> DataFrame:
    """Adds every leaf's proof. ``above`` (_group, path) continues the proofs of a group beyond its root."""
    segments = forest.segments
    kind = segments.schema["_group"].dataType.simpleString()
    asked = segments.select("_block", "_first", "_group", "_rows", "_lo", "_total").mapInArrow(
        _requests, f"_block long, _first int, _group {kind}, level int, place long")
    fetched = asked.join(forest.nodes.select("_group", "level", "place", "digest"), ["_group", "level", "place"]).groupBy(
        "_block", "_first").agg(F.collect_list(F.struct("level", "place", "digest")).alias("fetched"))
    held = segments.join(fetched, ["_block", "_first"], "left")
    held = held.withColumn("path", F.array().cast(PATH)) if above is None else held.join(above, "_group", "left")
    held = held.select("_block", "_first", "_rows", "_lo", "_total", "fetched", "path")
    kept = [f for f in forest.leaves.schema.fields if f.name not in ("_id", "_group", out)]
    rows = forest.leaves.select(_block().alias("_block"), "_id", F.col(f"`{digest}`").alias("digest"),
                                F.struct(*[F.col(f"`{f.name}`") for f in kept]).alias("kept"))
    schema = rows.schema["kept"].dataType.simpleString()

    def expand(leaves: pa.Table, segments: pa.Table) -> pa.Table:
        order, digests, _ = _by_place(leaves)
        found: list = [None] * len(digests)
        for s in segments.to_pylist():
            first, n = s["_first"], s["_rows"]
            nodes = {(x["level"], x["place"]): x["digest"] for x in s["fetched"] or ()}
            found[first: first + n] = proofs(digests[first: first + n], s["_lo"], s["_total"], nodes, s["path"] or [])
        return pa.table({"kept": leaves["kept"].take(order), "proof": pa.array(found, _PATH)})

    proven = rows.groupBy("_block").cogroup(held.groupBy("_block")).applyInArrow(expand, f"kept {schema}, proof {PATH}")
    return proven.select("kept.*", F.col("proof").alias(out))


def manifest(rows: DataFrame, group: str, order: list[str], digest: str = "leaf") -> DataFrame:
    """Adds ``subroot`` (of the row's group), ``root`` and ``proof`` (from the row's leaf to the root)."""
    trees = plant(rows.drop("subroot", "root", "proof"), group, order, digest)
    roots = trees.roots().select(F.col("_group.value").alias("value"), F.col("digest").alias("leaf"))
    top = plant(roots, None, ["value"])
    root = top.roots().select(F.col("digest").alias("root"))
    paths = stored(prove(top).select(F.struct("value").alias("_group"), F.col("proof").alias("path")), "paths")
    # One row, or none for an empty table.
    proven = prove(trees, paths, digest).withColumn("root", root.scalar())
    return proven.withColumn("subroot", fold(F.col(f"`{digest}`"), F.slice(
        "proof", 1, F.size("proof") - F.lit(_height(top)))))


def _height(forest: Forest) -> int:
    """Levels of proofs in a forest of one tree."""
    return forest.nodes.agg(F.max("_top")).first()[0] or 0

"""The Merkle manifest against trees that are built leaf by leaf, over blocks of few leaves."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from geoloom.llm import merkle
from geoloom.llm.merkle import fold, manifest, proof_text, row_digest
from geoloom.llm.merkle_query import op13_merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(leaves):
    """Root, and every leaf's proof as (left, right) per level."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i: i + 16]) for i in range(0, len(levels[-1]), 16)])
    proofs = []
    for i in range(len(leaves)):
        proof, at = [], i
        for level in levels[:-1]:
            run = at // 16 * 16
            proof.append(("".join(level[run:at]), "".join(level[at + 1: run + 16])))
            at //= 16
        proofs.append(proof)
    return levels[-1][0], proofs


def expected(rows):
    """(doc_id, leaf, subroot, root, proof digest, folded root, verified) of all rows, sorted."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row[0], row[1], row[2], row[3], row[4]), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in order}
    root, tops = tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops):
        for (_, _, own, row), proof in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            node = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])
                node = leaf(row[0], row[1], row[2], row[3], text)
            for left, right in proof + top:
                node = digest(left, node, right)
            whole = digest("".join(a + b for a, b in proof + top))
            out.append((row[0], own, trees[s][0], root, whole, node, node == root))
    return sorted(out, key=str)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_BITS", 3)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 40)


def run(spark, tmp_path, rows, schema=SCHEMA):
    path = str(tmp_path / "t")
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/documents.parquet")
    return sorted([tuple(r) for r in op13_merkle(spark, path).collect()], key=str)


def test_trees_over_many_blocks(spark, tmp_path, small_blocks):
    rows = [(i * 7 % 701, f"s{i % 3 % 2}", "en", i, f"Text {i} É") for i in range(701)]
    rows += [(1000 + i, f"one{i}", None, None, None) for i in range(20)]
    assert run(spark, tmp_path, rows) == expected(rows)


def test_nulls_ties_repeated_and_long_rows(spark, tmp_path, small_blocks):
    rows = [(None, None, None, None, None)] * 3 + [(5, None, "en", 1, ""), (5, None, "en", 1, "A"), (5, "", "en", 1, "A b")]
    rows += [(9, "hot", "de", 2, "Same TEXT")] * 40 + [(10, "hot", "de", -2, "LONG word " * 30_000)]
    got = run(spark, tmp_path, rows)
    assert got == expected(rows) and len(got) == len(rows)
    assert [r[-1] for r in got if r[0] is None] == [True] * 3


def test_single_and_empty(spark, tmp_path):
    rows = [(3, "s", "en", 1, "lower only")]
    assert run(spark, tmp_path, rows) == expected(rows)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert op13_merkle(spark, f"{tmp_path}/e").collect() == []


def test_fetched_nodes_are_few(spark, small_blocks):
    """A block asks for no node that it can derive, and for at most 15 on either side of a level."""
    for total in (1, 16, 17, 300, 5000):
        for lo in range(0, total, 37):
            hi = min(lo + 37, total)
            asked = list(merkle.missing_nodes(lo, hi, total))
            assert len(asked) == len(set(asked)) and len(asked) <= 30 * 4
            assert all(not (lo <= p * 16 ** k and min((p + 1) * 16 ** k, total) <= hi) for k, p in asked)


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(i, "a", f"x{i}", "old") for i in range(40)], "k long, g string, proof string, root string")
    out = manifest(rows.withColumn("leaf", row_digest(F.col("k"))), "g", ["k"])
    assert sorted(out.columns) == ["g", "k", "leaf", "proof", "root", "subroot"]
    assert out.where(fold(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 40
    assert out.where(F.length(proof_text(F.col("proof"))) == 64 * 15 + 64 * 2).count() == 32

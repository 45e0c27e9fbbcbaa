"""Registered query of the Merkle manifest, with the SQL that builds the same trees level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.llm.merkle import fold, manifest, proof_text, row_digest
from geoloom.llm.tables import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and what the proof makes of the leaf after tampering."""
    docs = table(spark, sf_dir, "documents")
    given = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaves = docs.select("doc_id", "source", row_digest(*given, F.col("text")).alias("leaf"), F.when(
        tampered, row_digest(*given, F.translate("text", UPPER, LOWER))).alias("changed"))
    folded = fold(F.coalesce("changed", "leaf"), F.col("proof"))
    return manifest(leaves, "source", ["doc_id"]).select(
        "doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("proof")), 256).alias("proof_sha256"),
        folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


def _digest(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _levels(name: str, group: str, deep: int) -> str:
    """Levels 0 to ``deep`` of the trees of ``<name>0`` ({group}, i, d), each with its runs."""
    out = []
    for k in range(deep):
        here = f"{name}{k}"
        out.append(f"""{here}_runs AS (SELECT {group}, i // 16 AS r, list(d ORDER BY i) AS ds, any_value(n) AS n
  FROM (SELECT *, count(*) OVER (PARTITION BY {group}) AS n FROM {here}) GROUP BY {group}, i // 16),
{name}{k + 1} AS (SELECT {group}, r AS i, CASE WHEN n > 1 THEN sha256(array_to_string(ds, '')) ELSE ds[1] END AS d
  FROM {here}_runs)""")
    return ",\n".join(out)


def _climb(start: str, name: str, group: str, deep: int) -> str:
    """Proof and folded digest of the rows of ``start`` (.., {group}, i, proof, cur) along the trees."""
    out, before = [], start
    for k in range(deep):
        out.append(f"""{start}_{k} AS (SELECT c.* EXCLUDE (i, proof, cur), c.i // 16 AS i,
  proof || array_to_string(list_filter(ds, lambda x, j: j <> c.i % 16 + 1), '') AS proof,
  CASE WHEN n > 1 THEN sha256(array_to_string(list_transform(ds, lambda x, j: CASE WHEN j = c.i % 16 + 1 THEN cur ELSE x END), ''))
    ELSE cur END AS cur
  FROM {before} AS c JOIN {name}{k}_runs AS t ON t.{group} IS NOT DISTINCT FROM c.{group} AND t.r = c.i // 16)""")
        before = f"{start}_{k}"
    return ",\n".join(out)


#: Levels that the SQL follows: enough for 16^7 rows of one source and 16^4 sources.
DEEP, WIDE = 7, 4
_CRC = "list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: " + \
    "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384)))"

SQL = {"op13_merkle": f"""
WITH given AS MATERIALIZED (
  SELECT doc_id, source, {_digest('text')} AS leaf, xor({_CRC}, 4294967295) % 5 = 0 AS tampered,
    {_digest(f"translate(text, '{UPPER}', '{LOWER}')")} AS changed FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM given),
t0 AS (SELECT source, i, leaf AS d FROM placed),
{_levels('t', 'source', DEEP)},
subroots AS MATERIALIZED (SELECT source, d, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS i FROM t{DEEP}),
u0 AS (SELECT 0 AS one, i, d FROM subroots),
{_levels('u', 'one', WIDE)},
low AS (SELECT doc_id, source, leaf, i, '' AS proof, CASE WHEN tampered THEN changed ELSE leaf END AS cur FROM placed),
{_climb('low', 't', 'source', DEEP)},
high AS (SELECT c.* EXCLUDE (i), s.i, 0 AS one, s.d AS subroot FROM low_{DEEP - 1} AS c
  JOIN subroots AS s ON s.source IS NOT DISTINCT FROM c.source),
{_climb('high', 'u', 'one', WIDE)}
SELECT doc_id, leaf, subroot, (SELECT d FROM u{WIDE}) AS root, sha256(proof) AS proof_sha256, cur AS folded_root,
  cur = (SELECT d FROM u{WIDE}) AS verified
FROM high_{WIDE - 1}"""}
QUERIES = {"op13_merkle": op13_merkle}

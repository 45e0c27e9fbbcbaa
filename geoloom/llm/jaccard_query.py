"""Registered query of the Jaccard join, with the SQL that gives the same rows by comparing all sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm.jaccard import similar_groups
from geoloom.llm.tables import table


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the size of its shingle set and its component."""
    groups = similar_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", "n_shingles", "component_id")


QUERIES = {"op3_jaccard": op3_jaccard}
SQL = {"op3_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM tokens AS a JOIN tokens AS b ON a.t = b.t AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT node, y FROM reach JOIN ways ON seen = x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(seen) FROM reach WHERE node = doc_id) AS component_id
FROM sets"""}

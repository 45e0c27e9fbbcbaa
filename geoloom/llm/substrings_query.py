"""Registered query of the removal of repeated word sequences, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.llm.substrings import remove_repeats
from geoloom.llm.tables import table


def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, those removed, and a digest of the rest."""
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op11_substrings": op11_substrings}
SQL = {"op11_substrings": r"""
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(
    regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS MATERIALIZED (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM texts)),
firsts AS (SELECT s, min(doc_id) AS d FROM windows GROUP BY s),
gone AS (
  SELECT r, list(DISTINCT p) AS ps
  FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM windows JOIN firsts USING (s) WHERE d < doc_id) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(ps, i), false)), ' ')) AS kept_sha256
FROM texts LEFT JOIN gone USING (r)"""}

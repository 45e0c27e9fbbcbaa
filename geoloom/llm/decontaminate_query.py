"""Registered query of benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.llm.decontaminate import add_leaks
from geoloom.llm.tables import table


def op7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds within the allowed edit distance (short ones exactly), with its span
    in words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = add_leaks(docs, table(spark, sf_dir, "benchmark"), least_words=1)
    # An inner inline would have the search run once more for its own filter.
    return found.select("doc_id", F.inline_outer("leaks")).where("distance IS NOT NULL")


QUERIES = {"op7_leaks": op7_leaks}
SQL: dict[str, str] = {}

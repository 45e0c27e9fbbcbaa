"""Registered query of the nearest neighbour search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.llm.neighbours import search
from geoloom.llm.tables import table


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products found for every vector whose id is divisible by 20 (the stated query set)."""
    base = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(base, base.where(F.col("vec_id") % 20 == 0), 20)


QUERIES = {"op4_neighbours": op4_neighbours}
SQL: dict[str, str] = {}

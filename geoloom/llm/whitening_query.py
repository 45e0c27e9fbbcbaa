"""Registered query of the whitening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.llm.tables import table
from geoloom.llm.whitening import whiten

COMPONENTS = 4


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector along the four first components, a row for each."""
    base = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return whiten(base, COMPONENTS).select(
        "vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "whitened",
        F.get("explained", F.col("at")).alias("explained"), "identity_error")


QUERIES = {"op12_whitening": op12_whitening}
SQL: dict[str, str] = {}

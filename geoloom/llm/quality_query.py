"""Registered query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geoloom.llm.quality import grade_texts, learn
from geoloom.llm.tables import table

#: Documents go unless they more likely than not reach this grade.
GOOD, SURE = 2, 0.5


def rating() -> Column:
    """0 for a document rated as poor, 1 for a sound one with toxic language, 2 for a sound and clean one."""
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2)


def graded(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    model = learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), rating())
    return grade_texts(docs, model, GOOD)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade, probability of a sound and clean document, and the selection, for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return graded(docs, spark, sf_dir).select(
        "doc_id", "expected_grade", "tail_probability", (F.col("tail_probability") >= SURE).alias("keep"))


QUERIES = {"op8_quality": op8_quality}
SQL: dict[str, str] = {}

"""Registered query of language identification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geoloom.llm.langid import learn, predict
from geoloom.llm.tables import table


def held_out(doc_id: Column) -> Column:
    """The fold that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from the documents outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    names, log_probs = learn(docs.where(~held_out(F.col("doc_id"))).select("lang", "text"))
    asked = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predict(asked, names, log_probs).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op9_langid": op9_langid}
SQL: dict[str, str] = {}

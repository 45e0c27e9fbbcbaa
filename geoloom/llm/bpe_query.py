"""Registered query of BPE encoding and decoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.llm.bpe import ids_text, load_ranks, round_trip
from geoloom.llm.tables import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, and its ids decoded again."""
    ranks = load_ranks(public_tokenizers.path(VOCABULARY))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = round_trip(docs, ranks, public_tokenizers.PATTERN)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(ids_text(F.col("ids")), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op1_bpe": op1_bpe}
SQL: dict[str, str] = {}

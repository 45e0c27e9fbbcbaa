"""Digests of files, directories and table rows. Spark's readers skip empty files, so these do not count them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Limits for a published directory.
MAX_ASSET_BYTES = 25 * 1024 * 1024
MAX_ASSETS = 1000


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 per file. A file is one row, so each must stay under 2 GB."""
    return _files(spark, path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def digest_mismatches(digests: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (file_name, sha256) rows whose file is absent or has another digest."""
    found = digests.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("sha256").alias("actual"))
    return expected.join(found, "file_name", "left").where(~F.col("sha256").eqNullSafe(F.col("actual")))


def directory_fingerprint(spark: SparkSession, path: str, root: str | None = None) -> DataFrame:
    """One row: file count, total bytes, oversized files, limits kept, and a fingerprint.

    Each file gives the SHA-256 of its path below ``root`` and its content digest; their 32-bit words are
    summed over all files and hashed. The sum does not depend on order, so no list of files is gathered.
    """
    base = (root or path).rstrip("/")
    names = F.regexp_replace("path", r"\A[a-z0-9]+:/+", "/")
    relative = F.substr(names, F.lit(len(_plain(base)) + 2))
    each = _files(spark, path).select(
        "length", F.sha2(F.concat(relative, F.lit("\0"), F.sha2("content", 256)), 256).alias("digest")
    )
    total = each.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"),
        F.count_if(F.col("length") > MAX_ASSET_BYTES).alias("oversized"), *_word_sums(),
    )
    return total.select(
        "files", "total_bytes", "oversized",
        ((F.col("oversized") == 0) & (F.col("files") <= MAX_ASSETS)).alias("within_limits"),
        F.sha2(F.concat_ws(":", "files", *[f"w{i}" for i in range(8)]), 256).alias("fingerprint"),
    )


def _word_sums() -> list:
    """Sums of the eight 32-bit words of a hexadecimal ``digest``; they do not depend on the order of rows."""
    return [F.sum(F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("bigint")).alias(f"w{i}") for i in range(8)]


def row_digests(df: DataFrame, key: str, content: str) -> DataFrame:
    """Bytes and SHA-256 of a text or binary column per row; null where it is null."""
    column = F.col(f"`{content}`").cast("binary")
    return df.select(F.col(f"`{key}`"), F.octet_length(column).cast("bigint").alias("length"),
                     F.sha2(column, 256).alias("sha256"))


def table_fingerprint(df: DataFrame, name: str, content: str) -> DataFrame:
    """One row for a table of named contents: rows, bytes, and a fingerprint like that of a directory."""
    named, held = (F.coalesce(F.col(f"`{c}`").cast("binary"), F.lit(b"")) for c in (name, content))
    each = df.select(F.octet_length(held).alias("length"), F.sha2(
        F.concat(named, F.lit(b"\0"), F.sha2(held, 256).cast("binary")), 256).alias("digest"))
    total = each.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"),
                     *_word_sums())
    return total.select("files", "total_bytes", F.sha2(
        F.concat_ws(":", "files", *[f"w{i}" for i in range(8)]), 256).alias("fingerprint"))


def _plain(path: str) -> str:
    return path.split(":", 1)[1] if path.startswith("file:") else path

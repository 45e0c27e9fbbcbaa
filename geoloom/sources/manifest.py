"""Catalog metadata as tables, and the audit of its links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.functions.urls import clean_link, is_public_https

MANIFEST_SCHEMA = """
relation string, rowCount bigint, title string, description string, image string, organization string,
sourceUrl string, downloadUrl string, license string, licenseUrl string, retrieved string, sha256 string,
notes string, methodology string, caveats string, snapshotId string,
sources array<struct<id: string, title: string, url: string>>
"""


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Catalog entries of a JSON array file, one row per relation."""
    return spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=True)


def manifest_sources(manifest: DataFrame) -> DataFrame:
    """The nested sources, one row each; a relation without any keeps one row of nulls."""
    return manifest.select("relation", F.explode_outer("sources").alias("s")).select(
        "relation", F.col("s.id").alias("source_id"), F.col("s.title").alias("source_title"),
        F.col("s.url").alias("source_url"),
    )


def latest_retrieval(manifest: DataFrame) -> DataFrame:
    """Latest retrieval date of the catalog, which dates a snapshot reproducibly."""
    return manifest.agg(F.max(F.when(F.col("retrieved") != "", F.col("retrieved"))).alias("snapshot_date"))


def audit_sources(df: DataFrame, url: str) -> DataFrame:
    """Adds whether each address may be loaded, and the link to show for it."""
    return df.withColumn("loadable", is_public_https(F.col(url))).withColumn("link", clean_link(F.col(url)))

"""Registered query of main text extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm.html import extract_text
from geoloom.llm.tables import table


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", "n_chars")


QUERIES = {"op10_html": op10_html}
SQL: dict[str, str] = {}

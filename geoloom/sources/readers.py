"""Readers for CSV, Parquet and inline records."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MAX_RECORDS = 500
MICROSECOND_PATTERN = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
#: Cells may be quoted, and a quote inside a quoted cell is doubled.
CSV_FORM = {"header": True, "quote": '"', "escape": '"'}


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header. Types are inferred, at the cost of one more pass, only without a schema. With
    ``multi_line`` cells may hold line breaks; files are then not split."""
    reader = spark.read.options(**CSV_FORM, multiLine=multi_line)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_csv_text(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """CSV with a header and every column as text."""
    return spark.read.options(**CSV_FORM, multiLine=multi_line).csv(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet with the schema of its footers."""
    return spark.read.parquet(path)


def read_ndjson(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One JSON record per line."""
    reader = spark.read.option("timestampNTZFormat", MICROSECOND_PATTERN)
    return reader.schema(schema).json(path) if schema else reader.json(path)


def from_records(
    spark: SparkSession, records: list[dict], schema: T.StructType | str | None = None,
    timestamps: list[str] | None = None,
) -> DataFrame:
    """1 to 500 inline records, with columns in order of first appearance; ``timestamps`` names ISO text columns."""
    if not isinstance(records, list) or not 1 <= len(records) <= MAX_RECORDS:
        raise ValueError(f"Inline datasets need 1 to {MAX_RECORDS} records.")
    if not all(isinstance(r, dict) for r in records):
        raise ValueError("Each inline record must be an object.")
    text = F.lit(json.dumps(records, default=str))
    one = spark.range(1)
    if schema is None:
        array = one.select(F.schema_of_json(text).alias("s")).first()["s"]
    else:
        ddl = schema if isinstance(schema, str) else schema.simpleString()
        array = f"array<{ddl}>" if ddl.lower().startswith("struct<") else f"array<struct<{ddl}>>"
    df = one.select(F.inline(F.from_json(text, array)))
    names = list(dict.fromkeys(name for record in records for name in record))
    df = df.select(*[F.col(f"`{n}`") for n in names if n in df.columns])
    for name in timestamps or []:
        df = df.withColumn(name, F.to_timestamp_ntz(F.col(f"`{name}`")))
    return df


def file_bytes(spark: SparkSession, path: str) -> int:
    """Total size of the files at a path, without reading their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("length").agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def format_of(path: str, declared: str | None = None) -> str:
    """``parquet`` or ``csv``: as declared, else by the suffix before any query string."""
    if declared is not None:
        if declared not in ("csv", "parquet"):
            raise ValueError("format must be csv or parquet.")
        return declared
    return "parquet" if path.lower().split("?")[0].endswith(".parquet") else "csv"

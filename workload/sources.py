"""Sources, typed views, link audit, roles, digests (S, I, V2, V5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from geoloom.functions.roles import ROLE_CANDIDATES, roles_of_tables
from geoloom.functions.text import clean_name, float_key_text, short_text
from geoloom.functions.times import days_after
from geoloom.session import scratch_path
from geoloom.sources.catalog import typed_time
from geoloom.plans.workspace import compact_values
from geoloom.sources.digest import row_digests, table_fingerprint
from geoloom.sources.manifest import audit_sources
from geoloom.sources.readers import MICROSECOND_PATTERN, from_records, read_csv, read_ndjson, read_parquet
from workload.base import TABLES, table, workspace


def csv_source(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    path = scratch_path(spark, "csv")
    df.write.option("header", True).csv(path)
    return read_csv(spark, path, df.schema)


def ndjson_source(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    path = scratch_path(spark, "ndjson")
    df.write.option("timestampNTZFormat", MICROSECOND_PATTERN).json(path)
    return read_ndjson(spark, path, df.schema)


def inline_records(spark, sf_dir):
    """The totals of every nation, handed over as records, beside the nations that they name."""
    totals = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("customers"), F.max("c_acctbal").alias("largest")).orderBy("c_nationkey")
    records = [{**r.asDict(), "noted": f"2024-01-{1 + r.c_nationkey % 28:02d}T00:00:00", "tags": ["a", str(r.c_nationkey)]}
               for r in totals.collect()]  # one record per nation
    given = from_records(spark, records, timestamps=["noted"])
    return given.join(table(spark, sf_dir, "nation"), given.c_nationkey == F.col("n_nationkey")).select(
        "n_name", "customers", "largest", "noted", F.element_at("tags", 2).alias("tag"))


def load_dataset(spark, sf_dir):
    ws = workspace(spark, sf_dir)
    info = ws.load_dataset("Loaded Customers.parquet", path=f"{sf_dir}/customer.parquet")
    return ws.catalog.frame(info.relation)


def epoch_days(spark, sf_dir):
    days = F.col("l_partkey") / 4
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", days_after("1979-01-01", days).alias("observed_at")
    )


def key_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", float_key_text(F.col("o_orderkey") * 1000000 + (F.col("o_orderkey") % 8) / 8).alias("id")
    )


def text_time(spark, sf_dir):
    return typed_time(table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("iso_time")), "iso_time")


def replaced_column(spark, sf_dir):
    return typed_time(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("string")), "ts")


def _addresses(spark, sf_dir):
    """The pages' addresses, and for each page one whose host is a number derived from its id."""
    pages = table(spark, sf_dir, "pages")
    number = F.pmod(F.col("page_id") * 67280421 + 167772000, F.lit(4294967296))
    octets = [F.shiftright(number, 24 - 8 * i).bitwiseAND(F.lit(255)) for i in range(4)]
    octal = F.concat_ws(".", F.concat(F.lit("0"), F.conv(octets[0].cast("string"), 10, 8)), *[o.cast("string") for o in octets[1:]])
    host = F.when(F.col("page_id") % 3 == 0, number.cast("string")).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit("0x"), F.lower(F.hex(number)))).otherwise(octal)
    numbers = pages.select("page_id", F.concat(F.lit("https://"), host, F.lit("/")).alias("url"))
    return pages.select("page_id", "url").unionByName(numbers)


def source_audit(spark, sf_dir):
    return audit_sources(_addresses(spark, sf_dir), "url")


def link_audit_hosts(spark, sf_dir):
    audited = audit_sources(_addresses(spark, sf_dir), "url")
    return audited.groupBy("loadable", F.col("link").isNotNull().alias("linked")).agg(F.count(F.lit(1)).alias("pages"))


def row_counts(spark, sf_dir):
    parts = [table(spark, sf_dir, t).agg(F.lit(t).alias("relation"), F.count(F.lit(1)).alias("rows")) for t in TABLES]
    return reduce(DataFrame.unionByName, parts)


def inspected(spark, sf_dir):
    return workspace(spark, sf_dir).relation_sizes()


def word_roles(spark, sf_dir):
    """Each document as a table whose columns are its distinct words."""
    words = F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z_]+")))
    columns = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("table_name"), words.alias("column_name"))
    return roles_of_tables(columns)


def short_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", short_text(F.col("text")).alias("text"))


def short_arrays(spark, sf_dir):
    cut = compact_values(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return cut.select("vec_id", F.size("embedding").cast("bigint").alias("items"),
                      F.get("embedding", 7).cast("double").alias("last_item"))


def clean_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", clean_name(F.col("url")).alias("relation"))


QUERIES = {
    "S1_csv_source": csv_source,
    "S2_parquet_source": lambda spark, sf_dir: read_parquet(spark, f"{sf_dir}/part.parquet"),
    "S3_ndjson_source": ndjson_source,
    "S3_inline_records": inline_records,
    "S4_load_dataset": load_dataset,
    "S6a_key_text": key_text,
    "S6b_epoch_days": epoch_days,
    "S6c_text_time": text_time,
    "S6d_replaced_column": replaced_column,
    "S8_source_audit": source_audit,
    "S9_link_summary": link_audit_hosts,
    "I1_inspect_relations": inspected,
    "I3_roles_of_tables": word_roles,
    "I4_short_text": short_texts,
    "I4_short_arrays": short_arrays,
    "A4_row_counts": row_counts,
    "G13_clean_name": clean_names,
    "V2_row_digests": lambda spark, sf_dir: row_digests(table(spark, sf_dir, "pages"), "page_id", "html"),
    "V5_table_fingerprint": lambda spark, sf_dir: table_fingerprint(table(spark, sf_dir, "pages"), "url", "html"),
}

_PUBLIC = r"""
  SELECT page_id, url, coalesce(regexp_matches(url, '^https://[^/@]+(/|$)')
      AND NOT regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/:]+)', 1)),
        '^(localhost|10\.\d+\.\d+\.\d+|127\.\d+\.\d+\.\d+|169\.254\.\d+\.\d+|192\.168\.\d+\.\d+|172\.(1[6-9]|2[0-9]|3[01])\.\d+\.\d+)$|\.local$'),
      false) AS loadable,
    CASE WHEN regexp_matches(url, '^https?://[^/@]+(/|$)') THEN url END AS link
  FROM pages
  UNION ALL
  SELECT page_id, 'https://' || CASE page_id % 3 WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN '0x' || lower(to_hex(n))
      ELSE '0' || CASE WHEN n >> 30 > 0 THEN CAST(n >> 30 AS VARCHAR) || CAST((n >> 27) & 7 AS VARCHAR) || CAST((n >> 24) & 7 AS VARCHAR)
        WHEN n >> 27 > 0 THEN CAST(n >> 27 AS VARCHAR) || CAST((n >> 24) & 7 AS VARCHAR) ELSE CAST(n >> 24 AS VARCHAR) END
        || '.' || CAST((n >> 16) & 255 AS VARCHAR) || '.' || CAST((n >> 8) & 255 AS VARCHAR) || '.' || CAST(n & 255 AS VARCHAR)
      END || '/' AS url,
    NOT (n >> 24 IN (10, 127) OR n >> 16 IN (43518, 49320) OR n >> 20 = 2753) AS loadable, url AS link
  FROM (SELECT page_id, (page_id * 67280421 + 167772000) % 4294967296 AS n FROM pages)"""

_ROLE_ROWS = ", ".join(
    f"('{role}', '{name}', {i})" for role, names in ROLE_CANDIDATES.items() for i, name in enumerate(names)
)

SQL = {
    "S1_csv_source": "SELECT * FROM orders",
    "S2_parquet_source": "SELECT * FROM part",
    "S3_ndjson_source": "SELECT * FROM events",
    "S3_inline_records": """SELECT n_name, count(*) AS customers, max(c_acctbal) AS largest,
        TIMESTAMP '2024-01-01' + (n_nationkey % 28) * INTERVAL 1 DAY AS noted, CAST(n_nationkey AS VARCHAR) AS tag
        FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, n_nationkey""",
    "S4_load_dataset": "SELECT * FROM customer",
    "S6a_key_text": """SELECT o_orderkey,
        CAST(o_orderkey * 1000000 + (o_orderkey % 8) / 8e0 AS VARCHAR) AS id FROM orders""",
    "S6b_epoch_days": """SELECT l_orderkey, l_linenumber,
        TIMESTAMP '1979-01-01' + (l_partkey / 4e0) * INTERVAL 1 DAY AS observed_at FROM lineitem""",
    "S6c_text_time": """SELECT o_orderkey, CAST(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP) AS iso_time FROM orders""",
    "S6d_replaced_column": "SELECT * EXCLUDE (ts), CAST(CAST(ts AS VARCHAR) AS TIMESTAMP) AS ts FROM events",
    "S8_source_audit": _PUBLIC,
    "S9_link_summary": f"""SELECT loadable, link IS NOT NULL AS linked, count(*) AS pages
        FROM ({_PUBLIC}) AS audited GROUP BY 1, 2""",
    "I1_inspect_relations": " UNION ALL ".join(
        f"SELECT '{t}' AS relation, (SELECT count(*) FROM {t}) AS rows, "
        f"(SELECT count(*) FROM (DESCRIBE {t})) AS columns" for t in TABLES),
    "I3_roles_of_tables": f"""WITH words AS (
          SELECT DISTINCT doc_id AS table_name, unnest(regexp_split_to_array(lower(text), '[^a-z_]+')) AS column_name
          FROM documents),
        candidates AS (SELECT * FROM (VALUES {_ROLE_ROWS}) AS c(role, candidate, rank))
        SELECT table_name, role, arg_min(column_name, rank) AS column_name
        FROM words JOIN candidates ON column_name = candidate GROUP BY table_name, role""",
    "I4_short_text": """SELECT doc_id,
        CASE WHEN length(text) > 100 THEN substr(text, 1, 97) || '…' ELSE text END AS text FROM documents""",
    "I4_short_arrays": """SELECT vec_id, len(embedding[1:8]) AS items, CAST(embedding[8] AS DOUBLE) AS last_item
        FROM embeddings""",
    "A4_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS relation, count(*) AS rows FROM {t}" for t in TABLES),
    "V2_row_digests": "SELECT page_id, CAST(strlen(html) AS BIGINT) AS length, sha256(html) AS sha256 FROM pages",
    "V5_table_fingerprint": "WITH each AS (SELECT strlen(html) AS length, sha256(url || chr(0) || sha256(html)) AS digest "
    "FROM pages), sums AS (SELECT count(*) AS files, CAST(sum(length) AS BIGINT) AS total_bytes, concat_ws(':', count(*), "
    + ", ".join(f"sum(CAST('0x' || substr(digest, {1 + 8 * i}, 8) AS BIGINT))" for i in range(8))
    + ") AS whole FROM each) SELECT files, total_bytes, sha256(whole) AS fingerprint FROM sums",
    "G13_clean_name": r"""WITH stems AS (
          SELECT page_id, trim(regexp_replace(regexp_replace(lower(url), '\.[^.]+$', ''), '[^a-z0-9_]+', '_', 'g'), '_')
            AS body FROM pages)
        SELECT page_id, substr(CASE WHEN regexp_matches(body, '^[a-z_]') THEN body ELSE 'data_' || body END, 1, 48)
          AS relation FROM stems""",
}

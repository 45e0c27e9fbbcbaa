"""Registered query of the URL filter, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoloom.llm.tables import table
from geoloom.llm.urls import Rule, filter_urls

RULES = [Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"),
         Rule("org", "/fr/", "allow")]


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against the rules and, where none fits, against the list of URLs that were seen with a referral mark
    (a ``ref`` parameter): every page with the same canonical URL is blocked, marked or not."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    marked = table(spark, sf_dir, "pages").select("url").where(F.col("url").rlike(r"^[^#]*[?&]ref="))
    return filter_urls(pages, marked, RULES).select("page_id", "host", "path", "rule", "verdict", "listed")


QUERIES = {"op5_urls": op5_urls}
SQL = {"op5_urls": r"""
WITH cut AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '://[^?#]*\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$'))) AS params
  FROM pages),
named AS (
  SELECT *, regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)?$', '') AS short,
    regexp_replace(path, '/+$', '') AS stem FROM cut),
canon AS (
  SELECT *, CASE WHEN short <> '' THEN short || stem
    || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS key FROM named),
listed AS (SELECT DISTINCT key FROM canon WHERE key IS NOT NULL AND regexp_matches(url, '^[^#]*[?&]ref=')),
rules(rule_host, rule_path, rule_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, url, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
    max_by(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM (SELECT DISTINCT page_id, url, host, path FROM canon) AS c JOIN rules
    ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path)
  GROUP BY page_id, url)
SELECT c.page_id, c.host, c.path, f.rule, l.key IS NOT NULL AS listed,
  coalesce(f.rule_verdict, CASE WHEN l.key IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM canon AS c LEFT JOIN listed AS l ON c.key = l.key
LEFT JOIN fits AS f ON f.page_id IS NOT DISTINCT FROM c.page_id AND f.url IS NOT DISTINCT FROM c.url"""}

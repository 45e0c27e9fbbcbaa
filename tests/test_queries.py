"""Every registered query against its comparison SQL at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as registry
from check_queries import compare
from tests.conftest import SF_DIR
from workload.base import TABLES


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_DIR}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query(spark, con, name):
    outcome = compare(spark, con, SF_DIR, name, registry.queries()[name], registry.oracle_sql().get(name))
    assert outcome.startswith(("ok", "rows")), outcome


def test_entry(spark):
    assert registry.entry(spark).count() > 0


def test_registry_is_consistent():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_stored_results_are_whole(spark):
    """At sf0.01 lineitem has 60,000 rows, more than any bound that this query once had."""
    rows = registry.queries()["Q3_truncation"](spark, "/root/testdata/sf0.01").collect()
    assert {r["title"]: (r["row_count"], r["truncated"]) for r in rows}["lineitem"] == (60_000, False)
    assert "least" not in registry.oracle_sql()["Q3_truncation"]

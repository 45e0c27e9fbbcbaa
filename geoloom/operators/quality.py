"""Data checks that report every rule as a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Lowest or exact coverage of the bundled relations.
COVERAGE_RULES = [
    ("drifter_rows", ">=", 2000), ("storm_rows", ">=", 15000), ("countries", "=", 241),
    ("earthquakes", ">=", 14000), ("first_earthquake_year", "=", 1900), ("tsunami_events", ">=", 3000),
    ("tsunami_runups", ">=", 35000), ("tornadoes", ">=", 60000), ("rivers", ">=", 100),
    ("chain_brands", "=", 8), ("parks_landmarks", ">=", 1000),
]


def table_metrics(df: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Aggregates of one table, computed in one pass, as (metric, value) rows."""
    row = df.agg(*[value.cast("bigint").alias(name) for name, value in metrics.items()])
    return row.unpivot([], list(metrics), "metric", "value")


def coverage_metrics(relations: dict[str, DataFrame]) -> DataFrame:
    """The metrics behind :data:`COVERAGE_RULES`."""
    rows = F.count(F.lit(1))
    parts = [
        table_metrics(relations["drifter_loopers"], {"drifter_rows": rows}),
        table_metrics(relations["atlantic_storms"], {"storm_rows": rows}),
        table_metrics(relations["country_boundaries"], {"countries": rows}),
        table_metrics(relations["earthquakes"], {"earthquakes": rows, "first_earthquake_year": F.min("year")}),
        table_metrics(relations["tsunami_events"], {"tsunami_events": rows}),
        table_metrics(relations["tsunami_runups"], {"tsunami_runups": rows}),
        table_metrics(relations["us_tornado_tracks"], {"tornadoes": F.count_distinct("tornado_id")}),
        table_metrics(relations["major_rivers"], {"rivers": F.count_distinct("name")}),
        table_metrics(relations["global_chains"], {"chain_locations": rows, "chain_brands": F.count_distinct("brand")}),
        table_metrics(relations["theme_parks_landmarks"], {"parks_landmarks": rows}),
    ]
    return reduce(DataFrame.unionByName, parts)


def check_rules(metrics: DataFrame, rules: list[tuple[str, str, int]]) -> DataFrame:
    """One row per rule with the metric's value and whether it passed; an absent metric fails."""
    wanted = metrics.sparkSession.createDataFrame(rules, "metric string, op string, expected bigint")
    passed = (
        F.when(F.col("op") == "=", F.col("value") == F.col("expected"))
        .when(F.col("op") == ">=", F.col("value") >= F.col("expected"))
        .when(F.col("op") == "<=", F.col("value") <= F.col("expected"))
    )
    # The rule list is written by hand, so its size is known.
    return F.broadcast(wanted).join(metrics, "metric", "left").select(
        "metric", "op", "expected", "value", F.coalesce(passed, F.lit(False)).alias("passed")
    )


def count_mismatches(catalog: DataFrame, counted: DataFrame) -> DataFrame:
    """Catalog entries whose stated row count differs from the counted one."""
    return catalog.select("relation", "rowCount").join(counted, "relation").where(
        ~F.col("rowCount").eqNullSafe(F.col("rows"))
    )


def missing_metadata(catalog: DataFrame, required: list[str]) -> DataFrame:
    """Catalog entries with a blank required field: (relation, missing)."""
    blank = F.filter(
        F.array(*[F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(c)) for c in required]),
        lambda c: c.isNotNull(),
    )
    return catalog.select("relation", blank.alias("missing")).where(F.size("missing") > 0)


def list_differences(actual: DataFrame, expected: DataFrame, value: str, position: str = "position") -> DataFrame:
    """Positions at which two ordered lists differ."""
    a = actual.select(position, F.col(value).alias("actual"))
    b = expected.select(position, F.col(value).alias("expected"))
    return a.join(b, position, "full").where(~F.col("actual").eqNullSafe(F.col("expected")))


def broken_layers(layers: DataFrame, result_columns: DataFrame) -> DataFrame:
    """Layer mappings that name a missing result or a missing column of it.

    ``layers`` has layer_id, result_id, role, column_name (null where a role is unmapped);
    ``result_columns`` has result_id, column_name.
    """
    results = result_columns.select("result_id").distinct()
    lost = layers.join(results, "result_id", "left_anti").select(
        "layer_id", "result_id", F.lit(None).cast("string").alias("role"),
        F.lit(None).cast("string").alias("column_name"), F.lit("missing result").alias("problem"),
    ).distinct()
    mapped = layers.where(F.col("column_name").isNotNull()).join(results, "result_id", "left_semi")
    unknown = mapped.join(result_columns, ["result_id", "column_name"], "left_anti").select(
        "layer_id", "result_id", "role", "column_name", F.lit("missing column").alias("problem")
    )
    return lost.unionByName(unknown)

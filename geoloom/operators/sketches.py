"""Mergeable summaries of groups: quantiles (KLL) and distinct counts (HLL), for tables too large to sort or to list.

A sketch is a small binary column, so summaries can be stored per day or source and merged later without the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoloom.functions.geo import quoted

#: KLL size, and how far the rank of an estimated quantile may lie from the asked one (share of rows, 99 percent of cases).
KLL_SIZE, RANK_ERROR = 400, 0.0075
#: HLL size as a power of two, and three times the relative standard error of a count (1.04 / sqrt(size)).
HLL_BITS, COUNT_ERROR = 14, 3 * 1.04 / 128


def sketch(df: DataFrame, group: list[str], value: str, distinct: str) -> DataFrame:
    """Per group: ``quantiles`` of one column, ``distinct`` values of another, both as sketches, and ``n`` rows. Null and
    NaN values count as rows only."""
    number = quoted(value).cast("double")
    return df.groupBy(*[quoted(c) for c in group]).agg(
        F.kll_sketch_agg_double(F.when(~F.isnan(number), number), KLL_SIZE).alias("quantiles"),
        F.hll_sketch_agg(quoted(distinct), HLL_BITS).alias("distinct"), F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, group: list[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    return sketches.groupBy(*[quoted(c) for c in group]).agg(
        F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("distinct").alias("distinct"), F.sum("n").alias("n"))


def read_sketches(sketches: DataFrame, quantile: float = 0.5) -> DataFrame:
    """Replaces the sketches by ``estimate`` (the quantile, null without values) and ``distinct_estimate``."""
    has = F.kll_sketch_get_n_double("quantiles") > 0
    return sketches.withColumns({
        "estimate": F.when(has, F.kll_sketch_get_quantile_double("quantiles", F.lit(float(quantile)))),
        "distinct_estimate": F.hll_sketch_estimate("distinct")}).drop("quantiles", "distinct")

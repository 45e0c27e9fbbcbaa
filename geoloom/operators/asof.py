"""As-of join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from geoloom.functions.geo import quoted
from geoloom.operators.ordering import EARLIER, split_hot
from geoloom.operators.skew import DEFAULT_POLICY, HotPolicy


def asof_join(
    left: DataFrame, right: DataFrame, by: str, left_time: str, right_time: str,
    tiebreak: str | None = None, policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Adds to each left row the latest right row of the same key at or before its time, or nulls.

    ``by`` is a column of both sides; the other column names must differ. Of right rows at one time the
    largest ``tiebreak`` wins. Both sides are merged into one order per key; a long key is cut into parts
    along time, side and tiebreak, so also one hot time is split, and the last right row of earlier parts is carried over from one row per part.
    """
    payload = [c for c in right.columns if c != by]
    clash = set(payload) & set(left.columns)
    if clash:
        raise ValueError(f"Both sides have columns named {', '.join(sorted(clash))}.")
    tie = quoted(tiebreak) if tiebreak else F.lit(0)
    right_row = F.struct(*[quoted(c) for c in payload])
    left_row = F.struct(*[quoted(c) for c in left.columns])
    none_left = F.lit(None).cast(left.select(left_row).schema[0].dataType)
    none_right = F.lit(None).cast(right.select(right_row).schema[0].dataType)
    right_side = right.where(quoted(right_time).isNotNull()).select(
        quoted(by).alias("_by"), quoted(right_time).alias("_time"), F.lit(0).alias("_side"), tie.alias("_tie"),
        none_left.alias("_l"), right_row.alias("_r"),
    )
    left_side = left.select(
        quoted(by).alias("_by"), quoted(left_time).alias("_time"), F.lit(1).alias("_side"),
        F.lit(None).cast(right_side.schema["_tie"].dataType).alias("_tie"),
        left_row.alias("_l"), none_right.alias("_r"),
    )
    merged = right_side.unionByName(left_side)
    order = [F.col("_time").asc_nulls_last(), F.col("_side").asc(), F.col("_tie").asc()]
    split = split_hot(merged, F.col("_by"), order, policy)
    upto = (Window.unboundedPreceding, 0)
    found = F.last("_r", ignorenulls=True)
    joined = split.rows.withColumn("_found", found.over(Window.partitionBy("_group").orderBy(*order).rowsBetween(*upto)))
    if split.hot is not None:
        latest = F.max_by("_r", F.when(F.col("_side") == 0, F.col("_place")))
        # One row per part of a hot key: at most hot groups + ranges rows, see Split.
        carried = split.hot.groupBy("_group", "_part").agg(latest.alias("_latest")).select(
            "_group", "_part", F.last("_latest", ignorenulls=True).over(
                Window.partitionBy("_group").orderBy("_part").rowsBetween(*EARLIER)).alias("_carried"))
        here = Window.partitionBy("_group", "_part").orderBy("_place").rowsBetween(*upto)
        hot = split.hot.join(F.broadcast(carried), ["_group", "_part"]).withColumn(
            "_found", F.coalesce(found.over(here), F.col("_carried")))
        joined = joined.unionByName(hot.select(*joined.columns))
    matched = F.when(F.col("_time").isNotNull() & F.col("_by").isNotNull(), F.col("_found"))
    return joined.where(F.col("_side") == 1).select(
        *[F.col("_l").getField(c).alias(c) for c in left.columns],
        *[matched.getField(c).alias(c) for c in payload],
    )

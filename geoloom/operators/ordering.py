"""Positions within ordered groups, and what follows from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F, types as T

from geoloom.functions.geo import quoted
from geoloom.functions.text import natural_key
from geoloom.operators.skew import DEFAULT_POLICY, HotPolicy, hot_groups
from geoloom.session import materialise, store


@dataclass(frozen=True)
class SortKey:
    """A column to sort by. Text of an order (not of a tiebreak) sorts with its digit runs as numbers."""

    name: str
    descending: bool = False
    nulls_first: bool = False
    natural: bool = True


Order = str | SortKey | list[str | SortKey]
#: Bits of an increasing id that hold a row's place within its partition.
PLACE_BITS = 33


def sort_keys(order: Order, natural: bool = True) -> list[SortKey]:
    given = order if isinstance(order, list) else [order]
    return [k if isinstance(k, SortKey) else SortKey(k, natural=natural) for k in given]


def order_expression(df: DataFrame, key: SortKey | str) -> Column:
    """Typed sort value of an order column."""
    key = sort_keys(key)[0]
    value = quoted(key.name)
    if isinstance(df.schema[key.name].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        raise TypeError(f"Cannot order by a column of type {df.schema[key.name].dataType.simpleString()}.")
    return natural_key(value) if key.natural and isinstance(df.schema[key.name].dataType, T.StringType) else value


def sort_columns(df: DataFrame, keys: list[SortKey]) -> list[Column]:
    """Sort columns with direction and place of nulls."""
    out = []
    for k in keys:
        value = order_expression(df, k)
        if k.descending:
            out.append(value.desc_nulls_first() if k.nulls_first else value.desc_nulls_last())
        else:
            out.append(value.asc_nulls_first() if k.nulls_first else value.asc_nulls_last())
    return out


@dataclass(frozen=True)
class Split:
    """Rows with ``_group`` (null-safe group value): ordinary groups, and hot ones (or None).

    Hot rows are stored in ranges of about equal size by group and order: ``_part`` is a row's range and ``_place`` its
    place there, in order. There are at most (hot groups + ranges) pairs of group and part.
    """

    rows: DataFrame
    hot: DataFrame | None


def split_hot(df: DataFrame, group: Column, order: list[Column], policy: HotPolicy = DEFAULT_POLICY) -> Split:
    """Splits hot groups along the order by Spark's range partitioning.

    Its cut points are quantiles of a sample, so they follow any distribution: outliers, frequent values (rows that
    agree in the whole order are cut by their place in the input) and any type that sorts, in any direction. Without
    hot groups nothing is stored and the input is read once more than its result needs, for the counts. With them it
    is read once again to be stored, hot and other rows apart.
    """
    base = df.withColumn("_group", F.struct(group.alias("value")))
    # At most policy.max_groups rows, see HotPolicy.
    found = materialise(hot_groups(base.select("_group"), ["_group"], policy))
    parts = found.agg(F.sum("_parts")).first()[0]
    if not parts:
        return Split(base, None)
    marked = base.join(F.broadcast(found), "_group", "left").withColumn("_hot", F.col("_parts").isNotNull()).drop("_parts")
    kept = store(marked, "split", "_hot")
    hot = kept.where("_hot").drop("_hot").withColumn("_row", F.monotonically_increasing_id())
    # More ranges than this gain nothing, and the driver keeps a cut point for each.
    ranges = hot.repartitionByRange(min(int(parts), policy.max_groups), "_group", *order, "_row")
    placed = ranges.sortWithinPartitions("_group", *order, "_row").drop("_row").withColumn("_id", F.monotonically_increasing_id())
    stored = store(placed, "ranges").withColumn("_part", F.shiftright("_id", PLACE_BITS)).withColumn(
        "_place", F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))).drop("_id")
    return Split(kept.where("NOT _hot").drop("_hot"), stored)


def _along(part: str = "_part") -> WindowSpec:
    return Window.partitionBy("_group").orderBy(part)


EARLIER = (Window.unboundedPreceding, -1)


def _placed(split: Split, order: list[Column], first: list[str]) -> DataFrame:
    """All rows with ``_position``, ``_total`` and ``_first_<i>`` of the group's first row. Rows of ordinary groups are
    shuffled once by group, hot ones are numbered where they lie."""
    within = Window.partitionBy("_group")
    ordered = within.orderBy(*order)
    firsts = [F.struct(quoted(c).alias("v")) for c in first]
    rows = split.rows.withColumns({
        "_position": F.row_number().over(ordered).cast("bigint"), "_total": F.count(F.lit(1)).over(within),
        **{f"_first_{i}": F.first(c).over(ordered) for i, c in enumerate(firsts)}})
    if split.hot is None:
        return rows
    parts = split.hot.groupBy("_group", "_part").agg(
        F.min("_place").alias("_start"), F.count(F.lit(1)).alias("_rows"),
        *[F.min_by(c, "_place").alias(f"_first_{i}") for i, c in enumerate(firsts)])
    parts = parts.select(
        "_group", "_part", "_start", F.coalesce(F.sum("_rows").over(_along().rowsBetween(*EARLIER)), F.lit(0)).alias("_before"),
        F.sum("_rows").over(within).alias("_total"),
        *[F.first(f"_first_{i}").over(_along()).alias(f"_first_{i}") for i in range(len(first))])
    # At most hot groups + ranges rows, see Split.
    hot = split.hot.join(F.broadcast(parts), ["_group", "_part"]).withColumn(
        "_position", F.col("_before") + F.col("_place") - F.col("_start") + 1)
    return rows.unionByName(hot.select(*[quoted(c) for c in rows.columns]))


def add_positions(
    df: DataFrame,
    group: str | None,
    order: Order,
    tiebreak: list[str | SortKey] | None = None,
    first: list[str] | None = None,
    size: bool = True,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Adds ``position`` (from 1) and, with ``size``, ``group_rows`` per group.

    ``order`` is a column or several, each with its direction and place of nulls (:class:`SortKey`; last unless said
    otherwise); ``first`` names columns whose value in the group's first row is added as ``first_<name>``. Rows that
    agree in order and tiebreak come in any order.
    """
    first = first or []
    keys = sort_columns(df, [*sort_keys(order), *sort_keys(tiebreak or [], natural=False)])
    placed = _placed(split_hot(df, F.lit(0) if group is None else quoted(group), keys, policy), keys, first)
    added = {"position": F.col("_position")}
    if size:
        added["group_rows"] = F.col("_total")
    added |= {f"first_{name}": F.col(f"_first_{i}")["v"] for i, name in enumerate(first)}
    return placed.select(*[quoted(c) for c in df.columns], *[value.alias(name) for name, value in added.items()])


def decimate_path(
    df: DataFrame, group: str, order: Order, every: int = 5, tiebreak: list[str | SortKey] | None = None,
    policy: HotPolicy = DEFAULT_POLICY,
) -> DataFrame:
    """Keeps the first, the last and every ``every``-th row of each group."""
    keys = sort_columns(df, [*sort_keys(order), *sort_keys(tiebreak or [], natural=False)])
    placed = _placed(split_hot(df, quoted(group), keys, policy), keys, [])
    keep = (F.col("_position") == 1) | (F.col("_position") == F.col("_total")) | (F.col("_position") % every == 0)
    return placed.where(keep).select(*[quoted(c) for c in df.columns])


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group.

    Spark cuts every input partition to ``k`` rows per group before the shuffle, so a hot group sends
    at most ``k`` rows per task.
    """
    window = Window.partitionBy(*[quoted(c) for c in group]).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= k).drop("_rank")


def add_group_size(
    df: DataFrame, group: str, name: str = "group_rows", policy: HotPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Adds the number of rows with the same group value, null being a value too.

    Counts are aggregated before any shuffle of rows and joined back with hot keys salted.
    """
    from geoloom.operators.skew import lookup_join

    keyed = df.withColumn("_group", F.struct(quoted(group).alias("value")))
    sizes = keyed.groupBy("_group").agg(F.count(F.lit(1)).alias(name))
    return lookup_join(keyed, sizes, "_group", "inner", policy).drop("_group")


def deduplicate(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key combination, the smallest by ``order`` and then by its other columns that sort (nulls last).

    Rows that agree in ``order`` thus have one survivor, whatever their place in the input. A partial aggregate, so
    that copies of one row collapse before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    ties = [f.name for f in df.schema.fields if f.name in rest and f.name not in order and _sorts(f.dataType)]
    rank = F.struct(*[x for c in [*order, *ties] for x in (quoted(c).isNull(), quoted(c))])
    kept = df.groupBy(*[quoted(c) for c in keys]).agg(
        F.min_by(F.struct(*[quoted(c) for c in rest]), rank).alias("_row")
    )
    return kept.select(
        *[quoted(c) if c in keys else F.col("_row").getField(c).alias(c) for c in df.columns]
    )


def _sorts(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return all(_sorts(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _sorts(dtype.elementType)
    return not isinstance(dtype, (T.MapType, T.VariantType, T.CalendarIntervalType, T.SpatialType))


def exact_median(
    df: DataFrame, group: str, value: str, name: str = "median", policy: HotPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Median per group as (group, ``name``): the middle value, or the midpoint of the two middle ones.

    Works on positions, so a group may be larger than the memory of one task. Equal values of a group
    are merged into one counted row before any shuffle of rows.
    """
    weights = df.where(quoted(value).isNotNull() & ~F.isnan(quoted(value))).groupBy(
        quoted(group).alias("_key"), quoted(value).cast("double").alias("_value")
    ).agg(F.count(F.lit(1)).alias("_weight"))
    split = split_hot(weights, F.col("_key"), [F.col("_value").asc()], policy)
    within = Window.partitionBy("_group")
    upto = within.orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    placed = split.rows.withColumn("_total", F.sum("_weight").over(within)).withColumn("_last", F.sum("_weight").over(upto))
    low, high = (F.floor((F.col("_total") + 1) / 2).cast("bigint"), F.ceil((F.col("_total") + 1) / 2).cast("bigint"))
    if split.hot is not None:
        parts = split.hot.groupBy("_group", "_part").agg(F.sum("_weight").alias("_rows")).select(
            "_group", "_part", F.coalesce(F.sum("_rows").over(_along().rowsBetween(*EARLIER)), F.lit(0)).alias("_before"),
            F.sum("_rows").over(within).alias("_total"),
            F.sum("_rows").over(_along().rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"))
        # At most two parts of a hot group hold its middle: at most 2 * policy.max_groups rows, and only those parts move.
        middle = F.broadcast(parts.where((F.col("_before") < high) & (F.col("_upto") >= low)).drop("_upto"))
        here = Window.partitionBy("_group", "_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
        hot = split.hot.join(middle, ["_group", "_part"]).withColumn("_last", F.col("_before") + F.sum("_weight").over(here))
        placed = placed.unionByName(hot.select(*placed.columns))
    begin = F.col("_last") - F.col("_weight") + 1
    lower = F.max(F.when((begin <= low) & (F.col("_last") >= low), F.col("_value")))
    upper = F.max(F.when((begin <= high) & (F.col("_last") >= high), F.col("_value")))
    return placed.groupBy("_key").agg(lower.alias("_lower"), upper.alias("_upper")).select(
        F.col("_key").alias(group),
        (F.col("_lower") + (F.col("_upper") - F.col("_lower")) * 0.5).alias(name),
    )

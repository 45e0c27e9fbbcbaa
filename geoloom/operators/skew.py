"""Splitting of groups that hold a large share of all rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from geoloom.functions.geo import quoted


@dataclass(frozen=True)
class HotPolicy:
    """When a group counts as hot, and how finely it is split.

    A group is hot when it has more than ``floor_rows`` rows and is among the ``max_groups`` largest. That
    bounds the table of hot groups that is broadcast (some tens of bytes per row), and every other group has
    at most ``floor_rows`` rows or 1/``max_groups`` of all rows.
    """

    floor_rows: int = 1_000_000
    max_groups: int = 100_000
    part_rows: int = 65_536


DEFAULT_POLICY = HotPolicy()


def hot_groups(df: DataFrame, keys: list[str], policy: HotPolicy, *measures: Column) -> DataFrame:
    """Keys of the hot groups with ``_parts``, the number of parts for each, and further measures.

    One partial aggregate over the key columns; only groups above the floor reach the sort and limit.
    """
    return largest_groups(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *measures), keys, policy)


def largest_groups(counted: DataFrame, keys: list[str], policy: HotPolicy) -> DataFrame:
    """The hot ones of already counted groups (``_rows``), with ``_parts`` in place of the count."""
    largest = counted.where(F.col("_rows") > policy.floor_rows).orderBy(F.col("_rows").desc(), *keys)
    parts = F.ceil(F.col("_rows") / F.lit(policy.part_rows)).cast("bigint")
    return largest.limit(policy.max_groups).withColumn("_parts", parts).drop("_rows")


def row_hash(df: DataFrame) -> Column:
    """Hash of a row and its partition number, so that equal rows spread and a rerun task repeats it."""
    plain = [quoted(f.name) for f in df.schema.fields if not _has_map(f.dataType)]
    return F.xxhash64(*plain, F.spark_partition_id())


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return any(_has_map(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    return isinstance(dtype, (T.MapType, T.VariantType))


def lookup_join(
    rows: DataFrame, table: DataFrame, key: str, how: str = "left", policy: HotPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Joins ``rows`` to a ``table`` with one row per key; hot keys of ``rows`` are salted.

    Rows of a hot key are spread over its parts and the table's single row is repeated for each part. Rows without a
    key match nothing and are spread by their hash.
    """
    hot = hot_groups(rows.where(quoted(key).isNotNull()), [key], policy)
    # At most policy.max_groups rows, see HotPolicy.
    hot = F.broadcast(hot)
    salted = rows.join(hot, key, "left").withColumn(
        "_salt", F.when(quoted(key).isNull(), F.pmod(row_hash(rows), F.lit(1 << 20)))
        .when(F.col("_parts").isNull(), F.lit(0).cast("bigint"))
        .otherwise(F.pmod(row_hash(rows), F.col("_parts"))),
    ).drop("_parts")
    repeated = table.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1).cast("bigint")) - 1)),
    ).drop("_parts")
    return salted.join(repeated, [key, "_salt"], how).drop("_salt")


def grid_join(
    left: DataFrame, right: DataFrame, keys: list[str], condition: Column, policy: HotPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Inner equi-join on ``keys`` with a further condition, for keys that may be hot on both sides.

    A hot key becomes a grid of tasks: left rows get one of the left parts and are repeated for each right
    part, right rows the other way round, so each pair meets once. All other column names must differ, and
    the result drops the keys.
    """
    lhot = hot_groups(left, keys, policy).withColumnRenamed("_parts", "_lparts")
    rhot = hot_groups(right, keys, policy)
    # At most 2 * policy.max_groups rows, see HotPolicy.
    hot = F.broadcast(lhot.join(rhot.withColumnRenamed("_parts", "_rparts"), keys, "full"))

    def placed(df: DataFrame, mine: str, other: str) -> DataFrame:
        one = F.lit(1).cast("bigint")
        others = F.sequence(F.lit(0).cast("bigint"), F.coalesce(f"_{other}parts", one) - 1)
        own = F.pmod(F.col("_hash"), F.coalesce(f"_{mine}parts", one))
        return df.withColumn("_hash", row_hash(df)).join(hot, keys, "left").select(
            *[quoted(c) for c in df.columns if c not in keys], *[quoted(k).alias(f"_{mine}{k}") for k in keys],
            own.alias(f"_{mine}own"), F.explode(others).alias(f"_{mine}other"),
        )

    for k in keys:
        condition = (F.col(f"_l{k}") == F.col(f"_r{k}")) & condition
    condition = (F.col("_lown") == F.col("_rother")) & (F.col("_lother") == F.col("_rown")) & condition
    joined = placed(left, "l", "r").join(placed(right, "r", "l"), condition)
    return joined.select(*[quoted(c) for df in (left, right) for c in df.columns if c not in keys])


def fits(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; counts no further than that."""
    return df.limit(rows + 1).count() <= rows

"""Stored rows of a result: Parquet in the order of its query, with the range of row indexes of every file.

A row's place is its number within its write task below the task's number, so places grow in the order of the query. One
count per file after writing tells how many rows lie before each file; with it a row's index is an expression of its
place. Reading a result is thus an ordinary file scan with pruned columns and pushed filters, and a range of indexes
opens only the files that hold it. What the driver keeps is one entry per file.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from geoloom.functions.geo import quoted
from geoloom.operators.layers import ROW_INDEX
from geoloom.operators.ordering import PLACE_BITS
from geoloom.session import scratch_path

PLACE = "_row_place"
#: Files whose offsets are written into the expression of the index; more are joined.
LITERAL_FILES = 4_096


@dataclass(frozen=True)
class StoredFile:
    name: str
    part: int
    #: Rows of the result before this file, place of its first row within its part, and its rows.
    before: int
    first: int
    rows: int


@dataclass(frozen=True)
class StoredRows:
    """``schema`` is the result's, with columns of type void; these are not stored."""

    spark: SparkSession
    path: str
    schema: T.StructType
    files: tuple[StoredFile, ...]
    #: Rows that count; a capped result may hold one more.
    rows: int

    def _scan(self, files: tuple[StoredFile, ...] | None = None) -> DataFrame:
        held = T.StructType([f for f in self.schema.fields if not isinstance(f.dataType, T.NullType)] + [_PLACE_FIELD])
        paths = [self.path] if files is None else [f"{self.path}/{f.name}" for f in files]
        return self.spark.read.schema(held).parquet(*paths)

    def _columns(self) -> list[Column]:
        return [F.lit(None).alias(f.name) if isinstance(f.dataType, T.NullType) else quoted(f.name) for f in self.schema.fields]

    def _place(self, index: int) -> int:
        """Place of the row with an index, or one that no row before it reaches."""
        at = max(0, bisect_right([f.before for f in self.files], index) - 1)
        f = self.files[at]
        return (f.part << PLACE_BITS) + f.first + min(index - f.before, f.rows)

    def _whole(self) -> DataFrame:
        held = sum(f.rows for f in self.files)
        return self._scan() if self.rows == held else self._scan().where(F.col(PLACE) < self._place(self.rows))

    def frame(self) -> DataFrame:
        """The rows, without their index."""
        return self._whole().select(*self._columns())

    def indexed(self) -> DataFrame:
        """The rows with their index."""
        return self._with_index(self._whole(), self.files)

    def between(self, low: int, high: int) -> DataFrame:
        """The rows with indexes from ``low`` to ``high`` - 1; only files that hold some are opened."""
        low, high = max(low, 0), min(high, self.rows)
        files = tuple(f for f in self.files if f.rows and f.before < high and low < f.before + f.rows)
        if not files:
            return self._with_index(self._scan().where("false"), self.files[:1])
        kept = self._scan(files).where(F.col(PLACE).between(self._place(low), self._place(high - 1)))
        return self._with_index(kept, files)

    def _with_index(self, df: DataFrame, files: tuple[StoredFile, ...]) -> DataFrame:
        offsets: dict[int, int] = {}
        for f in files:
            offsets.setdefault(f.part, f.before - f.first)
        part, place = F.shiftright(PLACE, PLACE_BITS), F.col(PLACE).bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
        if len(offsets) > LITERAL_FILES:
            table = self.spark.createDataFrame(list(offsets.items()), "_part long, _before long")
            # One row per file of the result.
            joined = df.withColumn("_part", part).join(F.broadcast(table), "_part")
            return joined.select(*self._columns(), (F.col("_before") + place).alias(ROW_INDEX))
        entries = ", ".join(f"{p}L, {b}L" for p, b in offsets.items())
        before = F.element_at(F.expr(f"map({entries})"), part) if entries else F.lit(0)
        return df.select(*self._columns(), (before + place).cast("bigint").alias(ROW_INDEX))


_PLACE_FIELD = T.StructField(PLACE, T.LongType())


def store_rows(df: DataFrame, cap: int | None = None) -> tuple[StoredRows, bool]:
    """Writes the rows of ``df`` once, at most ``cap`` of them, and says whether there were more."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "result")
    wanted = df if cap is None else df.limit(cap + 1)
    held = [quoted(f.name) for f in df.schema.fields if not isinstance(f.dataType, T.NullType)]
    wanted.select(*held, F.monotonically_increasing_id().alias(PLACE)).write.parquet(path)
    sizes = spark.read.schema(T.StructType([_PLACE_FIELD])).parquet(path).groupBy(
        F.col("_metadata.file_name").alias("name")).agg(F.min(PLACE).alias("first"), F.count(F.lit(1)).alias("rows"))
    files, before = [], 0
    for row in sorted(sizes.collect(), key=lambda r: r["first"]):  # one row per file
        part = row["first"] >> PLACE_BITS
        files.append(StoredFile(row["name"], part, before, row["first"] - (part << PLACE_BITS), row["rows"]))
        before += row["rows"]
    rows = before if cap is None else min(before, cap)
    return StoredRows(spark, path, df.schema, tuple(files), rows), before > rows

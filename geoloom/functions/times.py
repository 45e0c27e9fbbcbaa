"""Epoch numbers and timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS = {"s": 1_000_000, "ms": 1_000, "us": 1}
ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def _at_micros(micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01").cast("timestamp_ntz"))


def _micros_of_nanos(nanos: Column) -> Column:
    return F.floor(nanos.cast("decimal(20,0)") / F.lit(1_000)).cast("bigint")


def epoch_timestamp(value: Column, unit: str | None = None) -> Column:
    """UTC instant of an integer column.

    With ``unit`` (``s``, ``ms``, ``us``, ``ns``) the reading is exact. Without it the size of each
    number decides: above 1e17 nanoseconds, above 1e14 microseconds, else milliseconds; that misreads
    microseconds from late 1966 to early 1973.
    """
    number = value.cast("bigint")
    if unit == "ns":
        return _at_micros(_micros_of_nanos(number))
    if unit is not None:
        return _at_micros(number * F.lit(MICROS[unit]))
    size = F.abs(number)
    return _at_micros(
        F.when(size > F.lit(10**17), _micros_of_nanos(number))
        .when(size > F.lit(10**14), number)
        .otherwise(number * F.lit(1_000))
    )


def iso_text(instant: Column) -> Column:
    """ISO text in UTC with milliseconds."""
    return F.date_format(instant, ISO_PATTERN)


def days_after(origin: str, days: Column) -> Column:
    """Timestamp at a fractional number of days after ``origin``."""
    start = F.lit(origin).cast("timestamp_ntz")
    return start + days.cast("double") * F.expr("INTERVAL '1' DAY")


def day_difference(start: Column, end: Column) -> Column:
    """Number of midnights between two timestamps, as a long."""
    return F.date_diff(end, start).cast("bigint")

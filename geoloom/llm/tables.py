"""Reading the input tables and cutting lineage, shared by the operators and their queries."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from geoloom.session import store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet below the shared folder and read back: its size is then known to the optimizer
    and no lost executor makes it run again."""
    return store(df, name)


_WORKER: dict[int, object] = {}


def once(shared, make: Callable) -> object:
    """What ``make`` builds from a broadcast value, once per worker process; one such thing is kept."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make(shared.value)
    return _WORKER[key]


def hand_back() -> None:
    """Gives freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


def lean(run: Callable) -> Callable:
    """A function over batches that starts without what earlier stages have left in its worker process, and hands freed
    memory back to the system at its end: workers live on and serve stages with other needs."""

    @functools.wraps(run)
    def whole(batches):
        _WORKER.clear()
        try:
            yield from run(batches)
        finally:
            hand_back()

    return whole


def text_pieces(batch: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """A text column in parts of at most ``size`` bytes (a longer text alone), each with the number of its first row."""
    upto = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(batch):
        done = int(upto[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + size, "right")))
        yield lo, batch.slice(lo, hi - lo)
        lo = hi


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_024) -> Iterator[None]:
    """While it holds, jobs hand texts to Python workers in batches of few rows, which bounds memory on both sides;
    the session's own setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)

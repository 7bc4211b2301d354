"""Writes whose Python workers get few rows at a time.

A batch of Spark's usual 10,000 rows is tens of megabytes if the rows are whole texts or sets of shingles. It is held several
times over: in the executor's direct memory, in the worker as Arrow data and again as Python objects. Batches of ROWS rows
bound all of these, at the cost of a few more messages.

Workers live on between tasks and stages, and their allocators keep what was freed; returning_memory gives it back to the
machine when a task ends, so a stage's peak isn't held through the next ones.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skyloom.session import cut

ROWS = 500
SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Batches of at most ROWS rows in what is run inside; the session's setting holds again after that."""
    before = spark.conf.get(SETTING)
    if not 0 < int(before) <= ROWS:
        spark.conf.set(SETTING, str(ROWS))
    try:
        yield
    finally:
        spark.conf.set(SETTING, before)


def cut_in_batches(df: DataFrame, name: str) -> DataFrame:
    """cut(), run in small batches."""
    with small_batches(df.sparkSession):
        return cut(df, name)


def returning_memory(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that returns unused memory to the machine when the task ends, where the C library can."""

    @wraps(run)
    def task(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task

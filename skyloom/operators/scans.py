"""Running states over the rows of a key in order, without a key's rows ever being sorted in one task.

A running count, sum, maximum or last value is associative, so it is taken in two levels. Rows are dealt to buckets of the order's
range, whose bounds are quantiles of all rows; a window runs within (key, bucket), and each bucket's whole state goes into a
table of at most (keys x buckets) rows, from which what comes before a bucket is carried into it. A key with a third of all rows is
spread over all buckets like the whole table is. Rows that are equal in the first order column share a bucket.

Nulls of the order sort first, as in a window. A null key is a key of its own. No row in, no row out.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets that the order's range is cut in.
BUCKETS = 64


class Running(NamedTuple):
    """A running state: ``count``, ``sum``, ``max`` or ``last`` (of non-null values), with the row itself or up to the one before."""

    kind: str
    value: Column | None = None
    own: bool = True


def bounds(rows: DataFrame, order: str, buckets: int = BUCKETS) -> list:
    """Inner bounds of buckets of about as many rows each; at most that many numbers come to the driver."""
    at = [i / buckets for i in range(1, buckets)]
    found = rows.agg(F.percentile_approx(order, at, 10_000).alias("b")).first()["b"] if at else None
    return sorted(set(found or []))


def bucket_of(value: Column, inner: list, first: int = 0) -> Column:
    """How many of the bounds aren't above a value, by bisection; null is in the first bucket."""
    if not inner:
        return F.lit(first)
    mid = len(inner) // 2
    return F.when(value >= F.lit(inner[mid]), bucket_of(value, inner[mid + 1 :], first + mid + 1)).otherwise(bucket_of(value, inner[:mid], first))


def _whole(state: Running, order: list[str]) -> Column:
    if state.kind == "count":
        return F.count(F.lit(1))
    if state.kind == "last":
        return F.max_by(state.value, F.when(state.value.isNotNull(), F.struct(*order)))
    return {"sum": F.sum, "max": F.max}[state.kind](state.value)


def _over(state: Running, value: Column | None, window) -> Column:
    if state.kind == "count":
        return F.count(F.lit(1)).over(window) if value is None else F.sum(value).over(window)
    return F.last(value, ignorenulls=True).over(window) if state.kind == "last" else {"sum": F.sum, "max": F.max}[state.kind](value).over(window)


def _joined(kind: str, carry: Column, local: Column) -> Column:
    if kind in ("count", "sum"):
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    return F.greatest(carry, local) if kind == "max" else F.coalesce(local, carry)


def scan(rows: DataFrame, keys: list[str], order: list[str], inner: list | None = None, **states: Running) -> DataFrame:
    """Adds a column for each running state over the rows of equal keys in the given order, whose first column is a number, date or time.
    inner: bounds of the buckets, where they are known from a scan of the same rows."""
    dealt = rows.withColumn("_bucket", bucket_of(F.col(order[0]), bounds(rows, order[0]) if inner is None else inner))
    whole = dealt.groupBy(*keys, "_bucket").agg(*[_whole(s, order).alias(f"_{n}") for n, s in states.items()])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_bucket").alias("_b"), *[_over(s, F.col(f"_{n}"), before).alias(f"_{n}") for n, s in states.items()])
    here = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    local = dealt.withColumns({n: _over(s, s.value if s.kind != "count" else None, here.rowsBetween(Window.unboundedPreceding, 0 if s.own else -1)) for n, s in states.items()})
    same = F.col("_bucket") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = local.join(carried, same)
    return joined.select(*[c for c in rows.columns], *[_joined(s.kind, F.col(f"_{n}"), F.col(n)).alias(n) for n, s in states.items()])

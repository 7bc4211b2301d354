"""Vectors as (i, x) rows: element-wise products, folds, reductions, prefix sums, partitions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def generate(spark: SparkSession, n: int, f) -> DataFrame:
    """(i, x) with x = f(i)."""
    return spark.range(n).select(F.col("id").alias("i"), f(F.col("id")).alias("x"))


def zip_with(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """(i, x) of f over two vectors by position."""
    return a.select("i", F.col("x").alias("xa")).join(b.select("i", F.col("x").alias("xb")), "i").select("i", f(F.col("xa"), F.col("xb")).alias("x"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    return zip_with(a, b, lambda x, y: x * y).agg(F.sum("x").alias("dot"))


def newton_sqrt(x: Column, steps: int = 40) -> Column:
    """Square root by Newton's iteration to a relative step of 1e-5, inside one expression."""
    start = F.struct(x.alias("r"), F.lit(False).alias("done"))

    def improve(s: Column, _: Column) -> Column:
        r = (s["r"] + x / s["r"]) / 2
        return F.when(s["done"], s).otherwise(F.struct(r.alias("r"), (F.abs(r - s["r"]) < r * 1e-5).alias("done")))

    return F.when(x > 0, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, improve, lambda s: s["r"])).otherwise(F.lit(0.0))


def running_total(df: DataFrame, order: str, value: str, width: int) -> DataFrame:
    """Adds total, the prefix sum of an integer index's values, in two levels: ranges of ``width`` indexes, then within each.
    No task sorts more than a range, or the list of ranges."""
    ranged = df.withColumn("range", F.floor(F.col(order) / width))
    sums = ranged.groupBy("range").agg(F.sum(value).alias("s"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(base, "range").withColumn("total", F.col("base") + F.sum(value).over(within)).drop("range", "base")


def linear_partition(sums: list[tuple[int, float]], parts: int) -> list[int]:
    """Contiguous parts with the least greatest sum: for each index in order, its part. For at most a few thousand aggregated
    entries on the driver; dynamic programme over prefix sums."""
    p = np.r_[0.0, np.cumsum([s for _, s in sorted(sums)])]
    n = len(p) - 1
    cost, back = p.copy(), []
    for _ in range(1, min(parts, n)):
        worst = np.maximum(cost[None, :], p[:, None] - p[None, :])
        worst[np.triu_indices(n + 1, 0)] = np.inf
        worst[0, 0] = 0.0
        back.append(worst.argmin(axis=1))
        cost = worst.min(axis=1)
    out, z = [0] * n, n
    for k in range(len(back), 0, -1):
        a = int(back[k - 1][z])
        out[a:z] = [k] * (z - a)
        z = a
    return out


def chunks(df: DataFrame, index: str, size: int) -> DataFrame:
    """Adds chunk: consecutive indexes in chunks of a size, by arithmetic rather than by a sort."""
    return df.withColumn("chunk", F.floor(F.col(index) / size))


def fold(values: Column, zero: Column, step, finish=None) -> Column:
    """Left fold of an array column."""
    return F.aggregate(values, zero, step, finish) if finish else F.aggregate(values, zero, step)

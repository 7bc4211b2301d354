"""Convolution kernels as rows: symmetric ones from a quarter, cut to a support, dealt by sub-pixel offset, and ragged ones by baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a kernel table up to which it is broadcast, some 40 bytes each; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def mirrored(quarter: DataFrame, half: int) -> DataFrame:
    """The whole kernel (y, x, re, im), of size 2 * half + 1 about its middle, of a quarter whose (y, x) are distances from the middle.
    Cells on an axis have one mirror image less, the middle none."""
    signs = lambda c: F.when(F.col(c) == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(-1), F.lit(1)))
    each = quarter.withColumn("sy", F.explode(signs("y"))).withColumn("sx", F.explode(signs("x")))
    return each.select((half + F.col("sy") * F.col("y")).cast("int").alias("y"), (half + F.col("sx") * F.col("x")).cast("int").alias("x"), "re", "im")


def oversampled(kernel: DataFrame, half: int, over: int) -> DataFrame:
    """The kernel about the middle of an array ``over`` times as large, the rest of which is absent."""
    move = (2 * half + 1) * over // 2 - half
    return kernel.withColumns({"y": F.col("y") + move, "x": F.col("x") + move})


def by_offset(kernel: DataFrame, over: int) -> DataFrame:
    """(ou, ov, y, x, re, im): an oversampled kernel dealt by sub-pixel offset, whose cells are ``over`` apart."""
    part = lambda c: F.floor(F.col(c) / over).cast("int").alias(c)
    return kernel.select((F.col("x") % over).alias("ou"), (F.col("y") % over).alias("ov"), part("y"), part("x"), "re", "im")


def extracted(kernel: DataFrame, half: int, support: Column | int) -> DataFrame:
    """The middle 2 * support + 1 cells squared of a kernel of size 2 * half + 1, counted from their own corner; support may differ by row."""
    s = support if isinstance(support, Column) else F.lit(support)
    inside = kernel.filter((F.abs(F.col("y") - half) <= s) & (F.abs(F.col("x") - half) <= s))
    return inside.withColumns({"y": (F.col("y") - half + s).cast("int"), "x": (F.col("x") - half + s).cast("int")})


def ragged_grid(vis: DataFrame, kernels: DataFrame, size: int, *keys: str) -> DataFrame:
    """(x, y, keys, gre, gim, n): gridding with a kernel of its own width for every baseline; weights apply to real and imaginary
    part each for itself, and what falls beyond the grid is left out cell by cell.

    vis: bl, u, v (cells, cut towards zero), re, im and the keys (such as the polarisation); kernels: bl, half, du, dv from -half to half, wre, wim.
    Points that share a baseline's cell are summed first, so the fan-out follows the grid and not the number of points. The kernel
    table is broadcast only where its rows were counted; a larger one meets the sums by a shuffle on the baseline, where hot ones are split."""
    cell = lambda c: F.col(c).cast("int")
    sums = vis.groupBy("bl", *keys, cell("u").alias("cu"), cell("v").alias("cv")).agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.count("*").alias("n"))
    table = kernels.select("bl", "du", "dv", "wre", "wim")
    table = F.broadcast(table) if kernels.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table
    fan = sums.join(table, "bl").select(*keys, (F.col("cu") + F.col("du")).alias("x"), (F.col("cv") + F.col("dv")).alias("y"), (F.col("re") * F.col("wre")).alias("gre"), (F.col("im") * F.col("wim")).alias("gim"), "n")
    inside = fan.filter(F.col("x").between(0, size - 1) & F.col("y").between(0, size - 1))
    return inside.groupBy("x", "y", *keys).agg(F.sum("gre").alias("gre"), F.sum("gim").alias("gim"), F.sum("n").alias("n"))

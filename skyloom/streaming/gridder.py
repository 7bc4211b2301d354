"""Structured Streaming forms: visibilities that arrive over time, folded into a grid or into counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators import gridding as G


def grid_stream(vis: DataFrame, grid: int, size: int, over: int = 8) -> DataFrame:
    """Running sums per place and offset of a stream of visibilities. The state has a row per (x, y, ou, ov), bounded by the
    grid; convolve() makes the grid of it, a batch at a time."""
    placed = G.in_bounds(G.pregrid(vis, grid, size, over), grid, size)
    return placed.groupBy(*G.CELL).agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.count("*").alias("n"))


def convolve(sums: DataFrame, gcf: DataFrame) -> DataFrame:
    """The grid of what grid_stream() has summed so far; for use in foreachBatch."""
    fan = sums.join(F.broadcast(gcf), ["ou", "ov"])
    re, im, gr, gi = (F.col(c) for c in ("re", "im", "gr", "gi"))
    return fan.groupBy((F.col("x") + F.col("su")).alias("x"), (F.col("y") + F.col("sv")).alias("y")).agg(
        F.sum(re * gr - im * gi).alias("gre"), F.sum(re * gi + im * gr).alias("gim"), F.sum("n").alias("n")
    )


def kernel_rates(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Invocations and time per kernel and window of a stream of events; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))

"""Bins and tiles: range lookups made arithmetic, halo copies, occupancy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def w_range(vis: DataFrame) -> tuple[float, float]:
    """Ends of the w-bins: zero-anchored, the upper one widened so that the greatest w lies inside."""
    r = vis.agg(F.least(F.lit(0.0), F.min("w")).alias("lo"), F.greatest(F.lit(0.0), F.max("w")).alias("hi")).first()
    lo, hi = r["lo"] or 0.0, r["hi"] or 0.0
    return lo, hi + (hi - lo) * 1e-4


def w_bin(w: Column, lo: float, hi: float, bins: int) -> Column:
    """Bin number, a range join turned into arithmetic."""
    width = hi - lo
    return F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((w - F.lit(lo)) / F.lit(width) * bins).cast("int"))) if width else F.lit(0)


def tile(z: Column, width: int) -> Column:
    return F.floor(z / width).cast("int")


def bin_sizes(vis: DataFrame, bins: int, width: int) -> DataFrame:
    """(tile_u, tile_v, wbin, n) of the bins that hold something."""
    lo, hi = w_range(vis)
    return vis.groupBy(tile(F.col("u"), width).alias("tile_u"), tile(F.col("v"), width).alias("tile_v"), w_bin(F.col("w"), lo, hi, bins).alias("wbin")).agg(F.count("*").alias("n"))


def split_bins(bins: DataFrame, low: str, high: str, parts: int) -> DataFrame:
    """Adds part: the interval that holds a bin's low edge when the range from the first low to the last high edge is cut into
    parts of equal width. The ends are one row."""
    ends = bins.agg(F.min(low).alias("first"), F.max(high).alias("last")).first()
    width = ((ends["last"] or 0) - (ends["first"] or 0)) or 1
    return bins.withColumn("part", F.least(F.lit(parts - 1), F.floor((F.col(low) - F.lit(ends["first"] or 0)) * parts / width)).cast("int"))


def with_margin(vis: DataFrame, width: int, margin: int) -> DataFrame:
    """A row for each tile that a point belongs to or comes within the margin of (up to four), with home, true for its own."""
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    near = lambda z, t: (F.floor((z + t * margin) / width)).cast("int")
    tiles = lambda c: F.array_distinct(F.transform(steps, lambda s: near(F.col(c), s)))
    copies = vis.select("*", F.explode(tiles("u")).alias("tile_u")).select("*", F.explode(tiles("v")).alias("tile_v"))
    return copies.withColumn("home", (F.col("tile_u") == tile(F.col("u"), width)) & (F.col("tile_v") == tile(F.col("v"), width)))


def sub_cell_occupancy(vis: DataFrame, sub: int, grid: int) -> DataFrame:
    """(su, sv, n, inbound): points by cell within a block of sub cells, and the share that lies in the grid."""
    x, y = F.floor("u").cast("int"), F.floor("v").cast("int")
    inside = x.between(-grid // 2, grid // 2 - 1) & y.between(-grid // 2, grid // 2 - 1)
    return vis.groupBy(F.pmod(x, F.lit(sub)).alias("su"), F.pmod(y, F.lit(sub)).alias("sv")).agg(F.count("*").alias("n"), F.avg(inside.cast("double")).alias("inbound"))


def bin_starts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Adds start, the running total of n before each bin in key order. One row a bin: bounded by the tiling, not by the data."""
    return counts.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def bookmarks(vis: DataFrame, block: int) -> DataFrame:
    """(block_y, block_x, first, n): where each block starts in block order, from counts rather than from a sort of the points."""
    counts = vis.groupBy(tile(F.col("v"), block).alias("block_y"), tile(F.col("u"), block).alias("block_x")).agg(F.count("*").alias("n"))
    return bin_starts(counts, ["block_y", "block_x"]).withColumnRenamed("start", "first")


def sort_into_blocks(vis: DataFrame, block: int, sub: int = 8) -> DataFrame:
    """Points dealt by block and sorted within each partition by block and sub-cell: locality without a total order."""
    keyed = vis.withColumns({"block_y": tile(F.col("v"), block), "block_x": tile(F.col("u"), block), "sub": F.floor((F.col("u") - F.floor("u")) * sub) * sub + F.floor((F.col("v") - F.floor("v")) * sub)})
    return keyed.repartition("block_y", "block_x").sortWithinPartitions("block_y", "block_x", "sub")


def densify(sparse: DataFrame, n: int, width: int) -> DataFrame:
    """(tile, x, v) of a sparse array of n cells as a dense one, tile by tile; absent cells are zero."""
    held = sparse.groupBy("x").agg(F.sum("v").alias("v"))
    return sparse.sparkSession.range(n).select(F.col("id").alias("x")).join(held, "x", "left").select(tile(F.col("x"), width).alias("tile"), "x", F.coalesce("v", F.lit(0)).alias("v"))


def plane_order(ends: DataFrame, key: str, wstep: float) -> DataFrame:
    """(key, least_plane, plane, place, place_abs) from (key, lo, hi), the ends of w: the least plane covered, half to even, its
    sign, and the places by plane and by absolute plane. One row a baseline or timestep."""
    least = F.when(F.col("lo") > 0, F.rint(F.col("lo") / wstep)).when(F.col("hi") < 0, F.rint(-F.col("hi") / wstep)).otherwise(0).cast("int")
    planes = ends.select(key, least.alias("least_plane"), F.when(F.col("hi") < 0, -least).otherwise(least).alias("plane"))
    place = lambda *order: F.row_number().over(Window.orderBy(*order)).cast("long")
    return planes.withColumns({"place": place("plane", key), "place_abs": place(F.abs("plane"), "plane", key)})

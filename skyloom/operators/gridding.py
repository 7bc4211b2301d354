"""Gridding and degridding: visibilities to and from a regular grid by convolution.

Both are linear in what shares a grid place and a sub-pixel offset. Visibilities are summed per (x, y, ou, ov) first, with
map-side partial sums, and only these sums fan out over the convolution's support: the fan-out is bounded by the grid, not
by the number of visibilities. The convolution table has over**2 * size**2 rows, a bound that doesn't grow with the data,
so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions.complex import cmul, conj, nearest

CELL = ["x", "y", "ou", "ov"]


def pregrid(vis: DataFrame, grid: int, size: int, over: int = 8, scale: float = 1.0, rule: str = "rint") -> DataFrame:
    """Adds x, y (top-left of the support) and ou, ov (sub-pixel offsets). The pixel is rounded while the fraction is taken
    from the floor, and the offset is clamped, not carried: both as the convolution table expects."""

    def place(c: str) -> Column:
        return nearest(F.col(c) * scale, rule) + F.lit(grid // 2 - size // 2)

    def offset(c: str) -> Column:
        z = F.col(c) * scale
        return F.greatest(F.lit(0), F.least(F.lit(over - 1), nearest(F.lit(float(over)) * (z - F.floor(z)))))

    return vis.withColumns({"x": place("u"), "y": place("v"), "ou": offset("u"), "ov": offset("v")})


def in_bounds(points: DataFrame, grid: int, size: int, margin: int = 0) -> DataFrame:
    """Points whose whole support lies in the grid, less a margin."""
    low, high = margin, grid - size - 1 - margin
    return points.filter(F.col("x").between(low, high) & F.col("y").between(low, high))


def w_pregrid(vis: DataFrame, grid: int, support: int, wstep: float, over: int = 8, scale: float = 1.0, mirror: bool = False) -> DataFrame:
    """Adds x, y, ou, ov, wp and layer = (wp * over + ou) * over + ov by floor; with mirror, the layer of a negative w is negated
    (its table is the conjugate one)."""
    us, vs = F.col("u") * scale, F.col("v") * scale
    wp = F.round((F.abs("w") if mirror else F.col("w")) / wstep).cast("int")
    cols = {
        "x": (F.floor(us) + grid // 2 - support // 2).cast("int"),
        "y": (F.floor(vs) + grid // 2 - support // 2).cast("int"),
        "ou": F.floor((us - F.floor(us)) * over).cast("int"),
        "ov": F.floor((vs - F.floor(vs)) * over).cast("int"),
        "wp": wp,
    }
    layer = (F.col("wp") * over + F.col("ou")) * over + F.col("ov")
    return vis.withColumns(cols).withColumn("layer", F.when(F.col("w") < 0, -layer).otherwise(layer) if mirror else layer)


def grid(vis: DataFrame, gcf: DataFrame, size: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, x, y, gre, gim, n) from pregridded visibilities: every one adds itself times the table's layer to its support.
    n counts the visibilities that touch a cell."""
    sums = vis.groupBy(*keys, *CELL).agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.count("*").alias("n"))
    fan = sums.join(F.broadcast(gcf), ["ou", "ov"])
    gre, gim = cmul((F.col("re"), F.col("im")), (F.col("gr"), F.col("gi")))
    return fan.groupBy(*keys, (F.col("x") + F.col("su")).alias("x"), (F.col("y") + F.col("sv")).alias("y")).agg(F.sum(gre).alias("gre"), F.sum(gim).alias("gim"), F.sum("n").alias("n"))


def gather_grid(vis: DataFrame, gcf: DataFrame, size: int) -> DataFrame:
    """grid() planned from the cells' side: partial sums per destination row first, then per cell."""
    sums = vis.groupBy(*CELL).agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.count("*").alias("n"))
    rows = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("sv")).withColumn("row", F.col("y") + F.col("sv"))
    fan = rows.join(F.broadcast(gcf), ["ou", "ov", "sv"])
    gre, gim = cmul((F.col("re"), F.col("im")), (F.col("gr"), F.col("gi")))
    return fan.groupBy((F.col("x") + F.col("su")).alias("x"), F.col("row").alias("y")).agg(F.sum(gre).alias("gre"), F.sum(gim).alias("gim"), F.sum("n").alias("n"))


def w_support(vis: DataFrame, growth: int, least: int, most: int, wstep: float, of: str | None = None) -> DataFrame:
    """Adds support: least + growth * w-plane, most at most; with ``of``, the greatest among the rows that share that column."""
    wp = F.round(F.abs("w") / wstep).cast("int")
    own = vis.withColumn("support", F.least(F.lit(most), F.lit(least) + F.lit(growth) * wp))
    return own if of is None else own.drop("support").join(own.groupBy(of).agg(F.max("support").alias("support")), of)


def w_grid(vis: DataFrame, gcf: DataFrame, growth: int, least: int, most: int, grid_size: int, wstep: float, of: str | None = None) -> DataFrame:
    """W-dependent gridding: the support of a visibility follows its w-plane, or with ``of`` the greatest of its baseline; the
    table is centred on it, and a negative w takes the conjugate."""
    us = F.floor("u")
    placed = w_support(vis, growth, least, most, wstep, of).withColumns({"ou": F.floor((F.col("u") - us) * 8).cast("int"), "ov": F.floor((F.col("v") - F.floor("v")) * 8).cast("int"), "neg": F.col("w") < 0})
    placed = placed.withColumns({"x": (us + grid_size // 2).cast("int") - F.floor(F.col("support") / 2).cast("int"), "y": (F.floor("v") + grid_size // 2).cast("int") - F.floor(F.col("support") / 2).cast("int")})
    fits = placed.filter((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < grid_size - F.col("support")) & (F.col("y") < grid_size - F.col("support")))
    sums = fits.groupBy(*CELL, "support", "neg").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.count("*").alias("n"))
    start = F.floor((F.lit(most) - F.col("support")) / 2).cast("int")
    fan = sums.join(F.broadcast(gcf), ["ou", "ov"]).filter(F.col("su").between(start, start + F.col("support") - 1) & F.col("sv").between(start, start + F.col("support") - 1))
    g = (F.col("gr"), F.when(F.col("neg"), conj((F.col("gr"), F.col("gi")))[1]).otherwise(F.col("gi")))
    gre, gim = cmul((F.col("re"), F.col("im")), g)
    return fan.groupBy((F.col("x") + F.col("su") - start).alias("x"), (F.col("y") + F.col("sv") - start).alias("y")).agg(F.sum(gre).alias("gre"), F.sum(gim).alias("gim"), F.sum("n").alias("n"))


def grid_simple(vis: DataFrame, gcf: DataFrame) -> DataFrame:
    """Four-polarisation gridding that multiplies real by real and imaginary by imaginary part."""
    sums = vis.groupBy("pol", *CELL).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    fan = sums.join(F.broadcast(gcf), ["ou", "ov"])
    return fan.groupBy("pol", (F.col("x") + F.col("su")).alias("x"), (F.col("y") + F.col("sv")).alias("y")).agg(F.sum(F.col("re") * F.col("gr")).alias("gre"), F.sum(F.col("im") * F.col("gi")).alias("gim"))


def grid_nearest(vis: DataFrame, scale: float = 1.0) -> DataFrame:
    """Every visibility to its nearest cell, without convolution."""
    return vis.groupBy(nearest(F.col("u") * scale, "half_away").alias("x"), nearest(F.col("v") * scale, "half_away").alias("y")).agg(
        F.sum("re").alias("gre"), F.sum("im").alias("gim"), F.count("*").alias("n")
    )


def uniform_weight(vis: DataFrame, scale: float = 1.0) -> DataFrame:
    """Each visibility divided by how many share its cell. Counts are summed by cell, then joined back, so a crowded cell is
    never held in one task."""
    placed = vis.withColumns({"cx": nearest(F.col("u") * scale, "half_away"), "cy": nearest(F.col("v") * scale, "half_away")})
    counts = placed.groupBy("cx", "cy").agg(F.count("*").alias("cell_n"))
    return placed.join(counts, ["cx", "cy"]).withColumns({"re": F.col("re") / F.col("cell_n"), "im": F.col("im") / F.col("cell_n")})


def degrid(vis: DataFrame, image: DataFrame, gcf: DataFrame, predict: bool = False) -> DataFrame:
    """Visibilities less (or, with predict, as) the sum of grid times table over their support; a missing cell is zero.
    The sum is taken once per distinct place and offset and joined back."""
    places = vis.select(*CELL).distinct()
    fan = places.join(F.broadcast(gcf), ["ou", "ov"]).withColumns({"gx": F.col("x") + F.col("su"), "gy": F.col("y") + F.col("sv")})
    cells = image.select(F.col("x").alias("gx"), F.col("y").alias("gy"), "gre", "gim")
    pre, pim = cmul((F.col("gre"), F.col("gim")), (F.col("gr"), F.col("gi")))
    seen = fan.join(cells, ["gx", "gy"]).groupBy(*CELL).agg(F.sum(pre).alias("pre"), F.sum(pim).alias("pim"))
    both = vis.join(seen, CELL, "left")
    pre, pim = F.coalesce("pre", F.lit(0.0)), F.coalesce("pim", F.lit(0.0))
    return both.withColumns({"re": pre if predict else F.col("re") - pre, "im": pim if predict else F.col("im") - pim}).drop("pre", "pim")


def hermitian_fold(image: DataFrame, n: int) -> DataFrame:
    """The half grid y < n/2: g(y, x) + conj(g(n-1-y, n-1-x)), as a projection before one aggregate."""
    upper = F.col("y") < n // 2
    return image.groupBy(F.when(upper, F.col("x")).otherwise(n - 1 - F.col("x")).alias("x"), F.when(upper, F.col("y")).otherwise(n - 1 - F.col("y")).alias("y")).agg(
        F.sum("gre").alias("gre"), F.sum(F.when(upper, F.col("gim")).otherwise(-F.col("gim"))).alias("gim")
    )


def normalise(image: DataFrame, factor: float) -> DataFrame:
    return image.withColumns({"gre": F.col("gre") * factor, "gim": F.col("gim") * factor})


def in_bounds_support(points: DataFrame, grid: int, support: str) -> DataFrame:
    """Points whose own support, a column, lies in the grid."""
    return points.filter((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < grid - F.col(support)) & (F.col("y") < grid - F.col(support)))


def polarisation(image: DataFrame, pol: int, grid: int) -> DataFrame:
    """One polarisation of a grid, over its number of cells."""
    return normalise(image.filter(F.col("pol") == pol).drop("pol"), 1.0 / grid**2)


def layer_support(plane: Column, least: int, growth: int, most: int) -> Column:
    """Support of the convolution function of a w-plane."""
    return F.least(F.lit(most), F.lit(least) + F.lit(growth) * F.abs(plane))

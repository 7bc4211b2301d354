"""Images as (y, x, val) or (y, x, gre, gim) rows: sums, tiles, facets, transforms, peaks and CLEAN."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.session import cut

IMAGE = "y int, x int, val double"
COMPLEX = "y int, x int, gre double, gim double"


def image_sum(*images: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, images).groupBy("y", "x").agg(F.sum("val").alias("val"))


def detile(tiles: DataFrame, height: int, width: int) -> DataFrame:
    """Overlap-add of tiles with margins (top, left, ty, tx, gre, gim), clipped to the grid."""
    y, x = F.col("top") + F.col("ty"), F.col("left") + F.col("tx")
    inside = tiles.filter(y.between(0, height - 1) & x.between(0, width - 1))
    return inside.groupBy(y.alias("y"), x.alias("x")).agg(F.sum("gre").alias("gre"), F.sum("gim").alias("gim"))


def defacet(facets: DataFrame, size: int, height: int, width: int) -> DataFrame:
    """Disjoint facets (l, m, y, x, val) pasted at their place and clipped to the image."""
    placed = facets.select((F.col("m") * size + F.col("y")).cast("int").alias("y"), (F.col("l") * size + F.col("x")).cast("int").alias("x"), "val")
    return placed.filter(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))


def transpose(matrix: DataFrame) -> DataFrame:
    return matrix.select(F.col("x").alias("y"), F.col("y").alias("x"), "val")


def part_of(i: str, n: int, parts: int):
    """Number of the part that holds index i when n is split into parts whose first n % parts are one longer."""
    q, r = divmod(n, parts)
    c = F.col(i)
    return F.when(c < r * (q + 1), F.floor(c / (q + 1))).otherwise(r + F.floor((c - r * (q + 1)) / max(q, 1))).cast("int")


def peak(image: DataFrame) -> DataFrame:
    """One row: y, x and signed value of the greatest absolute value, the first in row order of equal ones."""
    best = image.agg(F.max(F.struct(F.abs("val").alias("size"), (-F.col("y")).alias("y"), (-F.col("x")).alias("x"), "val")).alias("b"))
    return best.select((-F.col("b.y")).alias("y"), (-F.col("b.x")).alias("x"), F.col("b.val").alias("val"))


def subtract_shifted(residual: DataFrame, psf: DataFrame, dy: int, dx: int, factor: float) -> DataFrame:
    """residual less factor times the psf moved by (dy, dx); nothing outside the psf."""
    moved = psf.select((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.col("val").alias("p"))
    return residual.join(moved, ["y", "x"], "left").select("y", "x", (F.col("val") - F.lit(factor) * F.coalesce("p", F.lit(0.0))).alias("val"))


def clean(residual: DataFrame, psf: DataFrame, gain: float, threshold: float, cycles: int = 12, model: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Högbom CLEAN: (model, residual). Each cycle takes the peak of the residual, stops if it is under the threshold, moves
    gain times it to the model and subtracts the psf scaled to it. The driver sees one row a cycle; the residual is written
    to the shared folder, so plans don't grow."""
    spark = residual.sparkSession
    top = peak(psf).first()
    found = []
    for _ in range(cycles):
        at = peak(residual).first()
        if at["val"] is None or abs(at["val"]) < threshold:
            break
        found.append((at["y"], at["x"], gain * at["val"]))
        residual = cut(subtract_shifted(residual, psf, at["y"] - top["y"], at["x"] - top["x"], gain * at["val"] / top["val"]), "residual")
    added = spark.createDataFrame(found, IMAGE)
    return image_sum(added) if model is None else image_sum(model, added), residual


def _transform_lines(image: DataFrame, line: str, along: str, n: int, inverse: bool) -> DataFrame:
    """One-dimensional centred transform of every line; a group is one line of n points."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.zeros(n, complex)
        z[pdf[along].to_numpy()] = pdf["gre"].to_numpy() + 1j * pdf["gim"].to_numpy()
        z = np.fft.ifftshift(z)
        z = np.fft.fftshift(np.fft.ifft(z) * n if inverse else np.fft.fft(z))
        return pd.DataFrame({line: np.full(n, pdf[line].iloc[0], np.int32), along: np.arange(n, dtype=np.int32), "gre": z.real, "gim": z.imag})[["y", "x", "gre", "gim"]]

    return image.select("y", "x", "gre", "gim").groupBy(line).applyInPandas(run, COMPLEX)


def fft2(image: DataFrame, n: int) -> DataFrame:
    """Grid of an image (y, x, val): centred forward transform over n; rows first, then columns, a shuffle between."""
    z = image.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("val").alias("gre"), F.lit(0.0).alias("gim"))
    out = _transform_lines(_transform_lines(z, "y", "x", n, False), "x", "y", n, False)
    return out.withColumns({"gre": F.col("gre") / n, "gim": F.col("gim") / n})


def ifft2(grid: DataFrame, n: int) -> DataFrame:
    """Image (y, x, val) of a grid: made Hermitian about (n-1)/2, centred inverse transform without 1/n**2, over n, real part."""
    z = grid.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "gre", "gim")
    mirror = z.select((n - 1 - F.col("y")).alias("y"), (n - 1 - F.col("x")).alias("x"), "gre", (-F.col("gim")).alias("gim"))
    herm = z.union(mirror).groupBy("y", "x").agg((F.sum("gre") / 2).alias("gre"), (F.sum("gim") / 2).alias("gim"))
    out = _transform_lines(_transform_lines(herm, "y", "x", n, True), "x", "y", n, True)
    return out.select("y", "x", (F.col("gre") / n).alias("val"))


def w_kernels(planes: DataFrame, support: int, over: int, theta: float) -> DataFrame:
    """(wp, ou, ov, su, sv, re, im): convolution functions of w-planes (wp, w), a group per plane: the w phase screen over the
    field, padded by the oversampling, transformed, split by sub-pixel offset and normalised to unit real sum."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = support
        w = float(pdf["w"].iloc[0])
        at = (np.arange(n) - n // 2) / n * theta
        r2 = at[:, None] ** 2 + at[None, :] ** 2
        screen = np.exp(-2j * np.pi * w * (1 - np.sqrt(1 - r2)))
        pad = np.zeros((n * over, n * over), complex)
        low = (n * over - n) // 2
        pad[low : low + n, low : low + n] = screen
        k = np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(pad)))
        k = k.reshape(n, over, n, over).transpose(1, 3, 0, 2)  # offset v, offset u, v, u
        k = k / k.real.sum(axis=(2, 3), keepdims=True)
        ov, ou, sv, su = (i.ravel().astype(np.int32) for i in np.indices(k.shape))
        return pd.DataFrame({"wp": np.full(k.size, pdf["wp"].iloc[0], np.int32), "ou": ou, "ov": ov, "su": su, "sv": sv, "re": k.real.ravel(), "im": k.imag.ravel()})

    return planes.groupBy("wp").applyInPandas(run, "wp int, ou int, ov int, su int, sv int, re double, im double")


def reproject(image: DataFrame, n: int, place) -> DataFrame:
    """Image resampled bilinearly: place(x, y) gives, as columns, where an output pixel lies in the input; outside is zero."""
    spark = image.sparkSession
    out = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("y"), (F.col("id") % n).cast("int").alias("x"))
    sx, sy = place(F.col("x").cast("double"), F.col("y").cast("double"))
    at = out.withColumns({"sx": sx, "sy": sy}).withColumns({"fx": F.floor("sx").cast("int"), "fy": F.floor("sy").cast("int")})
    ax, ay = F.col("sx") - F.col("fx"), F.col("sy") - F.col("fy")
    corners = [((F.col("fy") + j).alias("iy"), (F.col("fx") + i).alias("ix"), ((ay if j else 1 - ay) * (ax if i else 1 - ax)).alias("weight")) for j in (0, 1) for i in (0, 1)]
    fan = at.select("y", "x", F.explode(F.array(*[F.struct(*c) for c in corners])).alias("c")).select("y", "x", "c.*")
    cells = image.select(F.col("y").alias("iy"), F.col("x").alias("ix"), "val")
    return fan.join(cells, ["iy", "ix"], "left").groupBy("y", "x").agg(F.sum(F.col("weight") * F.coalesce("val", F.lit(0.0))).alias("val"))


def dense(image: DataFrame, n: int) -> DataFrame:
    """Every cell of an n x n grid; absent ones are zero."""
    cells = image.sparkSession.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("y"), (F.col("id") % n).cast("int").alias("x"))
    return cells.join(image, ["y", "x"], "left").select("y", "x", F.coalesce("gre", F.lit(0.0)).alias("gre"), F.coalesce("gim", F.lit(0.0)).alias("gim"))


def pixel_area_ratio(out_cd: list[list[float]], in_cd: list[list[float]]) -> float:
    """Area of an output pixel in input pixels; a pixel's sides are the lengths of its scale matrix's columns."""
    area = lambda m: math.hypot(m[0][0], m[1][0]) * math.hypot(m[0][1], m[1][1])
    return area(out_cd) / area(in_cd)


def centre_odd(kernel: DataFrame, half: int, over: int) -> DataFrame:
    """A kernel of odd size 2 * half + 1 about the centre of its oversampled array, whose size is over times as large; the rest
    of the array is zero, so absent."""
    move = (2 * half + 1) * over // 2 - half
    return kernel.withColumns({"y": F.col("y") + move, "x": F.col("x") + move})

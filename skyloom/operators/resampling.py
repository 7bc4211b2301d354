"""Images between sky systems, by weighted sampling.

An output pixel is the mean of n x n samples between its neighbours' centres, weighted by a tent that is 1 at its own centre. n
follows the pixel's size in the input: 4 for each two input pixels that it spans, 10 at most. Samples are bilinear; those whose
four input pixels aren't all in the image count neither value nor weight. A pixel without any sample, or with a corner where
the output system wraps around, is zero.

A sample's share of an input pixel is summed per (output pixel, input pixel) in the task that made it, so about the pixels that an
output pixel covers are shuffled to the input image, not its up to 324 parts. Nothing is broadcast or collected.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import sky

#: Samples an axis, at most, and for each two input pixels.
MOST, EACH = 10, 4


class System(NamedTuple):
    """Direction of the reference pixel (right ascension, declination), the reference pixel, and radians a pixel."""

    ref: tuple[float, float]
    at: tuple[float, float]
    cd: list[list[float]]


def between(rows: DataFrame, name: str, points: Column, source: System, target: System) -> DataFrame:
    """Adds <name>: for an array of pixels (x, y) of the target system, an array of where they lie in the source system (sx, sy), and
    whether that is past half a turn of right ascension or a quarter of declination from the target's reference, where that
    system wraps around (wraps).

    Both systems are sinusoidal: lines of right ascension narrow with declination. A pass over the array a step, so that no term is
    computed twice and the generated code stays short."""
    (a, b), (d, e) = target.cd
    back = sky.inverse(source.cd)
    turn = sky.matmul([list(r) for r in zip(*sky.to_world(source.ref))], sky.to_world(target.ref))
    dx, dy = (lambda p: p["x"] - F.lit(target.at[0])), (lambda p: p["y"] - F.lit(target.at[1]))
    unit = lambda p: (F.cos(p["lon"]) * F.cos(p["lat"]), F.sin(p["lon"]) * F.cos(p["lat"]), F.sin(p["lat"]))
    turned = lambda p: sky.apply_matrix(turn, tuple(p[f"u{i}"] for i in range(3)))
    steps = [
        lambda p: {"along": F.lit(a) * dx(p) + F.lit(b) * dy(p), "lat": F.lit(d) * dx(p) + F.lit(e) * dy(p)},
        lambda p: {"lon": p["along"] / F.cos(p["lat"]), "lat": p["lat"]},
        lambda p: {"wraps": (F.abs(p["lon"]) > math.pi) | (F.abs(p["lat"]) > math.pi / 2), **{f"u{i}": u for i, u in enumerate(unit(p))}},
        lambda p: {"wraps": p["wraps"], **{f"v{i}": v for i, v in enumerate(turned(p))}},
        lambda p: {"wraps": p["wraps"], "lat": F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p["v2"]))), "v0": p["v0"], "v1": p["v1"]},
        lambda p: {"wraps": p["wraps"], "lat": p["lat"], "lon": F.atan2(p["v1"], p["v0"]) * F.cos(p["lat"])},
        lambda p: {"wraps": p["wraps"], **{f"s{k}": F.lit(back[i][0]) * p["lon"] + F.lit(back[i][1]) * p["lat"] + F.lit(source.at[i]) for i, k in enumerate("xy")}},
    ]
    rows = rows.withColumn(name, points)
    for step in steps:
        rows = rows.withColumn(name, F.transform(name, lambda p: F.struct(*[v.alias(k) for k, v in step(p).items()])))  # noqa: B023
    return rows


def sample_counts(pixels: DataFrame, source: System, target: System) -> DataFrame:
    """Adds n, samples an axis of output pixels (y, x), and wraps, whether a neighbour that their samples lie between wraps around."""
    corners = F.array(*[F.struct((F.col("x") + dx).cast("double").alias("x"), (F.col("y") + dy).cast("double").alias("y")) for dy in (-1, 1) for dx in (-1, 1)])
    held = between(pixels, "_c", corners, source, target)
    span = lambda c: F.floor(F.array_max(F.transform("_c", lambda p: p[c]))) - F.floor(F.array_min(F.transform("_c", lambda p: p[c])))
    region = F.greatest(span("sx"), span("sy"))
    return held.select(*pixels.columns, F.least(F.lit(MOST), (F.floor(region / 2) + 1) * EACH).cast("int").alias("n"), F.exists("_c", lambda p: p["wraps"]).alias("wraps"))


def regrid(image: DataFrame, source: System, target: System, width: int, height: int, out_width: int, out_height: int) -> DataFrame:
    """(y, x, val) in the target system of an image of width x height in the source system; absent cells of it are zero."""
    spark = image.sparkSession
    pixels = spark.range(out_width * out_height).select(F.floor(F.col("id") / out_width).cast("int").alias("y"), (F.col("id") % out_width).cast("int").alias("x"))
    sized = sample_counts(pixels, source, target).filter("not wraps").select("y", "x", "n")
    inner = F.sequence(F.lit(1), F.col("n") - 1)
    tent = lambda f: F.when(f <= 0.5, f * 2).otherwise(2 - f * 2)
    at = F.transform(inner, lambda k: F.struct((F.col("x") - 1 + k / F.col("n") * 2).alias("x"), (F.col("y") - 1 + F.col("l") / F.col("n") * 2).alias("y")))
    lines = between(sized.withColumn("l", F.explode(inner)), "s", at, source, target).select("y", "x", "n", "l", F.posexplode("s").alias("k", "s"))
    weight = tent((F.col("k") + 1) / F.col("n")) * tent(F.col("l") / F.col("n"))
    at = lines.select("y", "x", weight.alias("w"), "s.sx", "s.sy", F.floor("s.sx").alias("fx"), F.floor("s.sy").alias("fy"))
    at = at.filter((F.col("fx") >= 0) & (F.col("fx") < width - 1) & (F.col("fy") >= 0) & (F.col("fy") < height - 1))
    at = at.select("y", "x", "w", F.col("fx").cast("int").alias("fx"), F.col("fy").cast("int").alias("fy"), (F.col("sx") - F.col("fx")).alias("ax"), (F.col("sy") - F.col("fy")).alias("ay"))
    along = [(F.col("fx"), 1 - F.col("ax")), (F.col("fx") + 1, F.col("ax"))]
    up = [(F.col("fy"), 1 - F.col("ay")), (F.col("fy") + 1, F.col("ay"))]
    four = [F.struct(iy.alias("iy"), ix.alias("ix"), (F.col("w") * wx * wy).alias("w")) for iy, wy in up for ix, wx in along]
    shares = at.select("y", "x", F.inline(F.array(*four))).groupBy("y", "x", "iy", "ix").agg(F.sum("w").alias("w"))
    # every output pixel once more, with no weight on some cell
    none = pixels.select("y", "x", F.least("y", F.lit(height - 1)).alias("iy"), F.least("x", F.lit(width - 1)).alias("ix"), F.lit(0.0).alias("w"))
    cells = image.select(F.col("y").alias("iy"), F.col("x").alias("ix"), "val")
    met = shares.unionByName(none).join(cells, ["iy", "ix"], "left")
    total = F.sum("w")
    value = F.sum(F.col("w") * F.coalesce("val", F.lit(0.0)))
    return met.groupBy("y", "x").agg(F.when(total != 0, value / total).otherwise(0.0).alias("val"))

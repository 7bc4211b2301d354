"""Högbom CLEAN over an image kept in tiles, with the same components and residual as one cycle after the other.

The residual is a table of tiles (ty, tx, vals); the driver knows each tile's peak, one row a tile of TILE x TILE cells. A pass takes
the tile with the greatest peak and runs cycles there, as long as its peak stays above what any other tile can hold by
then: the next peak, plus each component's share of the psf's greatest sidelobe. Only that tile is read for it. Then the tiles that the
moved psf reaches, and no others, tell their new peaks. Components since the last write are applied when a tile is read; the
tiles are written anew every ``every`` components, so neither plans nor the work on a tile grow.

Subtractions of a cell happen in the order of the components, so results don't depend on passes. Tasks hold one tile at a time and
the psf, which is sent to them up to PSF_CELLS cells; a larger one is subtracted by a join (``images.clean``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.operators import images
from skyloom.session import cut

TILE = 64
#: Cells of a psf that tasks hold, eight bytes each.
PSF_CELLS = 1 << 22
TILES = "ty int, tx int, vals array<double>"
PEAKS = "ty int, tx int, size double, y int, x int, val double"
COMPONENTS = "cycle int, y int, x int, val double"


def to_tiles(image: DataFrame, size: int, tile: int = TILE) -> DataFrame:
    """(ty, tx, vals) of a size x size image (y, x, val): tiles by rows, absent cells zero. A group is one tile."""

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        vals = np.zeros(tile * tile)
        vals[(pdf["y"] % tile * tile + pdf["x"] % tile).to_numpy()] = pdf["val"].to_numpy()
        return pd.DataFrame({"ty": pdf["ty"].iloc[:1], "tx": pdf["tx"].iloc[:1], "vals": [vals]})

    # every tile has a cell, be the image absent there
    per = -(-size // tile)
    corners = image.sparkSession.range(per * per).select((F.floor(F.col("id") / per) * tile).cast("int").alias("y"), (F.col("id") % per * tile).cast("int").alias("x"), F.lit(0.0).alias("val"))
    cells = image.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "val").unionByName(corners).groupBy("y", "x").agg(F.sum("val").alias("val"))
    at = lambda c: F.floor(F.col(c) / tile).cast("int")
    return cells.withColumns({"ty": at("y"), "tx": at("x")}).groupBy("ty", "tx").applyInPandas(fill, TILES)


def from_tiles(tiles: DataFrame, size: int, tile: int = TILE) -> DataFrame:
    """The image (y, x, val) of tiles, every cell."""
    each = tiles.select("ty", "tx", F.posexplode("vals").alias("i", "val"))
    cells = each.select((F.col("ty") * tile + F.floor(F.col("i") / tile)).cast("int").alias("y"), (F.col("tx") * tile + F.col("i") % tile).cast("int").alias("x"), "val")
    return cells.filter((F.col("y") < size) & (F.col("x") < size))


class _Beam:
    """A psf as tasks hold it: cells, where its peak is, and the greatest absolute value beside that."""

    def __init__(self, cells: np.ndarray, top: tuple[int, int]):
        self.cells, self.top, self.value = cells, top, cells[top]
        beside = np.abs(cells)
        beside[top] = 0
        self.side = float(beside.max())

    def reaches(self, y: int, x: int, ty: int, tx: int, tile: int) -> bool:
        """Whether the psf moved to a component at (y, x) has a cell in a tile."""
        top, left = y - self.top[0], x - self.top[1]
        return top < (ty + 1) * tile and top + self.cells.shape[0] > ty * tile and left < (tx + 1) * tile and left + self.cells.shape[1] > tx * tile

    def subtract(self, vals: np.ndarray, ty: int, tx: int, y: int, x: int, factor: float) -> None:
        """Takes factor times the moved psf from a tile's cells (a square array)."""
        tile = vals.shape[0]
        top, left = ty * tile - y + self.top[0], tx * tile - x + self.top[1]  # of the tile, in the psf
        a, b = max(0, top), min(self.cells.shape[0], top + tile)
        c, d = max(0, left), min(self.cells.shape[1], left + tile)
        if a < b and c < d:
            vals[a - top : b - top, c - left : d - left] -= factor * self.cells[a:b, c:d]


def _applied(row, components: list[tuple[int, int, float]], beam: _Beam, tile: int) -> np.ndarray:
    vals = np.array(row.vals, float).reshape(tile, tile)
    for y, x, factor in components:
        beam.subtract(vals, row.ty, row.tx, y, x, factor)
    return vals


def _peak(vals: np.ndarray, ty: int, tx: int, size: int) -> tuple[float, int, int, float]:
    """Absolute peak of a tile, the first in row order, without what lies beyond the image."""
    tile = vals.shape[0]
    seen = np.abs(vals[: size - ty * tile, : size - tx * tile])
    i, j = np.unravel_index(int(seen.argmax()), seen.shape)
    return float(seen[i, j]), ty * tile + int(i), tx * tile + int(j), float(vals[i, j])


def _over_tiles(tiles: DataFrame, work, schema: str) -> DataFrame:
    """work(row) gives the rows of a tile."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                yield pd.DataFrame(list(work(row)), columns=names)

    return tiles.mapInPandas(run, schema)


def clean(residual: DataFrame, psf: DataFrame, size: int, gain: float, threshold: float, cycles: int = 12, tile: int = TILE, every: int = 32) -> tuple[DataFrame, DataFrame]:
    """(components, residual) of a size x size image: components (cycle, y, x, val) in their order, val being gain times the peak."""
    spark = residual.sparkSession
    if size * size > PSF_CELLS:
        model, left = images.clean(residual, psf, gain, threshold, cycles)
        return model.select(F.lit(None).cast("int").alias("cycle"), "y", "x", "val"), left
    cells = np.zeros((size, size))
    held = psf.select("y", "x", "val").toPandas()
    cells[held["y"], held["x"]] = held["val"]
    top = np.unravel_index(int(np.abs(cells).argmax()), cells.shape)
    sent = spark.sparkContext.broadcast(_Beam(cells, (int(top[0]), int(top[1]))))
    beam = sent.value
    base = cut(to_tiles(residual, size, tile), "tiles")
    pending: list[tuple[int, int, float]] = []  # (y, x, factor of the psf) since base was written
    found: list[tuple[int, int, int, float]] = []
    peaks: dict[tuple[int, int], tuple] = {}

    def tell(tiles: DataFrame) -> None:
        known = list(pending)
        rows = _over_tiles(tiles, lambda r: [(r.ty, r.tx, *_peak(_applied(r, known, sent.value, tile), r.ty, r.tx, size))], PEAKS).collect()
        peaks.update({(r.ty, r.tx): tuple(r)[2:] for r in rows})

    def applied() -> DataFrame:
        known = list(pending)
        return _over_tiles(base, lambda r: [(r.ty, r.tx, _applied(r, known, sent.value, tile).ravel())], TILES)

    def run_in(where: tuple[int, int], others: float, most: int) -> list[tuple[int, int, float]]:
        """Cycles in one tile while no other can hold a peak as great."""
        known = list(pending)

        def work(row):
            beam, vals, bound = sent.value, _applied(row, known, sent.value, tile), others
            for i in range(most):
                absolute, y, x, val = _peak(vals, row.ty, row.tx, size)
                if absolute < threshold or i and not absolute > bound * (1 + 1e-9):
                    break
                factor = gain * val / beam.value
                yield y, x, val
                beam.subtract(vals, row.ty, row.tx, y, x, factor)
                bound += abs(factor) * beam.side

        here = base.filter((F.col("ty") == where[0]) & (F.col("tx") == where[1]))
        return [tuple(r) for r in _over_tiles(here, work, "y int, x int, val double").collect()]

    tell(base)
    while len(found) < cycles:
        best = max(peaks, key=lambda t: (peaks[t][0], -peaks[t][1], -peaks[t][2]))
        if peaks[best][0] < threshold:
            break
        others = max((p[0] for t, p in peaks.items() if t != best), default=0.0)
        new = run_in(best, others, min(every - len(pending), cycles - len(found)))
        found += [(len(found) + i, y, x, gain * val) for i, (y, x, val) in enumerate(new)]
        pending += [(y, x, gain * val / beam.value) for y, x, val in new]
        if len(pending) >= every:
            base = cut(applied(), "tiles")
            reached, pending[:] = list(pending), []
        else:
            reached = [(y, x, 0.0) for y, x, _ in new]
        touched = [t for t in peaks if any(beam.reaches(y, x, *t, tile) for y, x, _ in reached)]
        all_of_them = len(touched) == len(peaks)
        tell(base if all_of_them else base.join(F.broadcast(spark.createDataFrame(touched, "ty int, tx int")), ["ty", "tx"], "left_semi"))
    return spark.createDataFrame(found, COMPONENTS), from_tiles(applied(), size, tile)

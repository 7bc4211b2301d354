"""Registered queries on images between systems, and their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skyloom.functions import sky
from skyloom.operators import kernels as K
from skyloom.operators.resampling import System, regrid, sample_counts
from skyloom.plans import derived as D
from skyloom.plans.imaging import GRID, OFF_TIES, gridded
from skyloom.sources import tables as T

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: The grid's own system; one with pixels as large, turned and moved; and one with pixels seven times as large that passes the pole.
SOURCE = System((0.3, 0.5), (128.0, 128.0), [[-0.002, 0.0], [0.0, 0.002]])
NEAR = System((0.302, 0.501), (127.0, 129.0), [[-0.0019, 0.0001], [0.0001, 0.0019]])
WIDE = System((0.31, 0.52), (130.0, 126.0), [[-0.014, 0.0], [0.0, 0.014]])


def _times(m, v) -> list[str]:
    return ["(" + " + ".join(f"({a!r}) * {b}" for a, b in zip(row, v)) + ")" for row in m]


def _world(x: str, y: str, s: System) -> tuple[list[str], str]:
    """SQL of a pixel's direction, and of whether the system wraps around there."""
    along, lat = _times(s.cd, (f"({x} - {s.at[0]!r})", f"({y} - {s.at[1]!r})"))
    lon = f"({along} / cos({lat}))"
    unit = (f"(cos({lon}) * cos({lat}))", f"(sin({lon}) * cos({lat}))", f"sin({lat})")
    return _times(sky.to_world(s.ref), unit), f"(abs({lon}) > {math.pi!r} or abs({lat}) > {math.pi / 2!r})"


def _pixel(d: str, s: System) -> list[str]:
    """SQL of the pixel of a direction d, a list of three."""
    px, py, pz = _times(list(zip(*sky.to_world(s.ref))), [f"{d}[{i}]" for i in (1, 2, 3)])
    lat = f"asin(greatest(-1.0, least(1.0, {pz})))"
    return [f"{o} + {s.at[i]!r}" for i, o in enumerate(_times(sky.inverse(s.cd), (f"(atan2({py}, {px}) * cos({lat}))", lat)))]


def _sampled(target: System, size: int) -> str:
    direction, wraps = _world("cx", "cy", target)
    px, py = _pixel("d", SOURCE)
    return f"""o as (select cast(i // {size} as integer) as y, cast(i % {size} as integer) as x from range({size * size}) r(i)),
    c as (select y, x, cast(x + dx as double) as cx, cast(y + dy as double) as cy from o, (values (-1), (1)) a(dx), (values (-1), (1)) b(dy)),
    e as (select y, x, [{', '.join(direction)}] as d, {wraps} as wraps from c),
    f as (select y, x, wraps, {px} as px, {py} as py from e),
    s as (select y, x, bool_or(wraps) as wraps, cast(least(10, (floor(greatest(floor(max(px)) - floor(min(px)), floor(max(py)) - floor(min(py))) / 2) + 1) * 4) as integer) as n from f group by y, x)"""


def _regrid(target: System, size: int) -> str:
    direction, _ = _world("cx", "cy", target)
    px, py = _pixel("d", SOURCE)
    tent = lambda c: f"(case when {c} / n <= 0.5 then {c} / n * 2 else 2 - {c} / n * 2 end)"
    return f"""with {D.gridded()}, {_sampled(target, size)},
    p as (select y, x, x - 1 + k / n * 2 as cx, y - 1 + l / n * 2 as cy, {tent('k')} * {tent('l')} as w from (select y, x, cast(n as double) as n, cast(k as double) as k, cast(l as double) as l
        from s, range(1, 10) a(k), range(1, 10) b(l) where not wraps and k < n and l < n)),
    q as (select y, x, w, [{', '.join(direction)}] as d from p),
    t as (select y, x, w, {px} as sx, {py} as sy from q),
    u as (select *, cast(floor(sx) as integer) as fx, cast(floor(sy) as integer) as fy from t where floor(sx) between 0 and {GRID - 2} and floor(sy) between 0 and {GRID - 2}),
    v as (select y, x, fx + i as ix, fy + j as iy, sum(w * (case i when 1 then sx - fx else 1 - (sx - fx) end) * (case j when 1 then sy - fy else 1 - (sy - fy) end)) as w from u, range(2) a(i), range(2) b(j) group by all),
    m as (select v.y, v.x, sum(w) as total, sum(w * coalesce(gre, 0)) as value from v left join grid on grid.x = ix and grid.y = iy group by v.y, v.x)
    select o.y, o.x, round(coalesce(value / total, 0) + {OFF_TIES}, 4) + 0.0 as val from o left join m on m.y = o.y and m.x = o.x"""


def _image(spark, sf_dir):
    return gridded(spark, sf_dir).select("y", "x", F.col("gre").alias("val"))


def _rounded(image):
    return image.select("y", "x", (F.round(F.col("val") + OFF_TIES, 4) + 0.0).alias("val"))


@query(_regrid(NEAR, GRID))
def m18_regrid(spark, sf_dir):
    """The gridded image in a system that is turned and moved."""
    return _rounded(regrid(_image(spark, sf_dir), SOURCE, NEAR, GRID, GRID, GRID, GRID))


@query(_regrid(WIDE, GRID))
def m18_regrid_wide(spark, sf_dir):
    """The gridded image in a system of large pixels: many samples a pixel, and corners beyond the pole."""
    return _rounded(regrid(_image(spark, sf_dir), SOURCE, WIDE, GRID, GRID, GRID, GRID))


@query(f"with {D.gridded()}, {_sampled(WIDE, GRID)} select s.n, wraps, count(*) as pixels from s join grid on grid.y = s.y and grid.x = s.x group by s.n, wraps")
def m18_sample_counts(spark, sf_dir):
    """Cells of the grid by the samples that they take in the wide system."""
    return sample_counts(gridded(spark, sf_dir).select("y", "x"), SOURCE, WIDE).groupBy("n", "wraps").agg(F.count("*").alias("pixels"))


#: Half width of the middle kernel, its oversampling, and half of what is extracted.
_HALF, _OVER, _SUPPORT = 16, 4, 5


def _quarter(spark, sf_dir):
    """Sums of the grid over the four cells that lie as far from its middle: a quarter of a symmetric kernel."""
    far = lambda c: F.abs(F.col(c) - 128).cast("int").alias(c)
    near = gridded(spark, sf_dir).filter(F.col("y").between(128 - _HALF, 128 + _HALF) & F.col("x").between(128 - _HALF, 128 + _HALF))
    return near.groupBy(far("y"), far("x")).agg(F.sum("gre").alias("re"), F.sum("gim").alias("im"))


_QUARTER = f"""{D.gridded()}, q as (select abs(y - 128) as y, abs(x - 128) as x, sum(gre) as re, sum(gim) as im from grid where abs(y - 128) <= {_HALF} and abs(x - 128) <= {_HALF} group by all),
    k as (select {_HALF} + a.y as y, {_HALF} + a.x as x, re, im from (select j as y, i as x from range(-{_HALF}, {_HALF + 1}) r(j), range(-{_HALF}, {_HALF + 1}) s(i)) a join q on q.y = abs(a.y) and q.x = abs(a.x))"""


@query(f"with {_QUARTER} select cast(y - {_HALF - _SUPPORT} as integer) as y, cast(x - {_HALF - _SUPPORT} as integer) as x, re, im from k where abs(y - {_HALF}) <= {_SUPPORT} and abs(x - {_HALF}) <= {_SUPPORT}")
def m13_extract(spark, sf_dir):
    """A symmetric kernel made of its quarter, and its middle cut out."""
    return K.extracted(K.mirrored(_quarter(spark, sf_dir), _HALF), _HALF, _SUPPORT)


@query(
    f"""with {_QUARTER}, o as (select cast(y + {(2 * _HALF + 1) * _OVER // 2 - _HALF} as integer) as y, cast(x + {(2 * _HALF + 1) * _OVER // 2 - _HALF} as integer) as x, re, im from k)
    select x % {_OVER} as ou, y % {_OVER} as ov, y // {_OVER} as y, x // {_OVER} as x, re, im from o"""
)
def m13_by_offset(spark, sf_dir):
    """The symmetric kernel about the middle of its oversampled array, dealt by sub-pixel offset."""
    return K.by_offset(K.oversampled(K.mirrored(_quarter(spark, sf_dir), _HALF), _HALF, _OVER), _OVER)


_RAGGED = "kern as (select bl, du, dv, ((du * 3 + dv * 5 + bl + 64) % 8 + 1) / 16.0::double as wre, ((du + 2 * dv + bl + 64) % 4 - 1) / 16.0::double as wim from range(16) b(bl), range(-7, 8) p(du), range(-7, 8) q(dv) where abs(du) <= bl % 8 and abs(dv) <= bl % 8)"


@query(
    f"""with {D.VIS}, {_RAGGED}, s as (select bl, t % 4 as pol, trunc(u + 128) as cu, trunc(v + 128) as cv, sum(re) as re, sum(im) as im, count(*) as n from vis group by all)
    select cast(cu + du as integer) as x, cast(cv + dv as integer) as y, pol, sum(re * wre) as gre, sum(im * wim) as gim, cast(sum(n) as bigint) as n
    from s join kern on kern.bl = s.bl where cu + du between 0 and 255 and cv + dv between 0 and 255 group by all"""
)
def a12_ragged_grid(spark, sf_dir):
    """Four polarisations gridded with odd, centred kernels whose width differs by baseline."""
    vis = T.visibilities(spark, sf_dir).select("bl", (F.col("u") + 128).alias("u"), (F.col("v") + 128).alias("v"), "re", "im", (F.col("t") % 4).alias("pol"))
    half = spark.range(16).select(F.col("id").cast("int").alias("bl"), (F.col("id") % 8).cast("int").alias("half"))
    at = half.withColumn("du", F.explode(F.sequence(-F.col("half"), F.col("half")))).withColumn("dv", F.explode(F.sequence(-F.col("half"), F.col("half"))))
    kernels = at.selectExpr("bl", "half", "du", "dv", "((du * 3 + dv * 5 + bl + 64) % 8 + 1) / 16.0D as wre", "((du + 2 * dv + bl + 64) % 4 - 1) / 16.0D as wim")
    return K.ragged_grid(vis, kernels, GRID, "pol")


_TURN = sky.matmul(sky.rot_x(-0.02), sky.rot_y(0.01))


@query(
    f"with {D.VIS} select bl, "
    + ", ".join(f"round(max({' + '.join(f'({a!r}) * {c}' for a, c in zip(row, 'uvw'))}), 9) + 0.0 as {out}" for row, out in zip(_TURN, "uvw"))
    + " from vis group by bl"
)
def p4_turned_uvw(spark, sf_dir):
    """Greatest coordinates by baseline, seen from a facet's phase centre."""
    turned = sky.rotated_uvw(0.01, 0.02, (F.col("u"), F.col("v"), F.col("w")))
    return T.visibilities(spark, sf_dir).groupBy("bl").agg(*[(F.round(F.max(c), 9) + 0.0).alias(n) for n, c in zip("uvw", turned)])

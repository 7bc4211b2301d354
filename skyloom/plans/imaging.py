"""Registered imaging queries over visibilities derived from lineitem."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import complex as cx
from skyloom.functions import sky
from skyloom.operators import binning as B
from skyloom.operators import gridding as G
from skyloom.operators import images as M
from skyloom.operators import regions as R
from skyloom.operators import tiled_clean
from skyloom.plans import derived as D
from skyloom.session import cut, new_path
from skyloom.sources import tables as T

QUERIES: dict = {}
ORACLE_SQL: dict = {}
GRID, SMALL, SIZE, OVER = 256, 64, 8, 8
#: Cells a unit of u and v at which every visibility's support lies in GRID.
WHOLE = 0.96
WSTEP, BINS = 25.0, 10
#: Added before results of transforms are rounded: many are dyadic, and would lie on a rounding tie.
OFF_TIES = 1e-7


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def points(spark: SparkSession, sf_dir: str, grid: int = GRID, scale: float = 1.0) -> DataFrame:
    return G.in_bounds(G.pregrid(T.visibilities(spark, sf_dir), grid, SIZE, OVER, scale), grid, SIZE)


def gridded(spark: SparkSession, sf_dir: str, grid: int = GRID) -> DataFrame:
    return G.grid(points(spark, sf_dir, grid), T.convolution_table(spark), SIZE)


def ones(vis: DataFrame) -> DataFrame:
    return vis.withColumns({"re": F.lit(1.0), "im": F.lit(0.0)})


@query(f"with {D.gridded()} select x, y, gre, gim, n from grid")
def a8_grid(spark, sf_dir):
    """Convolutional gridding of all visibilities."""
    return gridded(spark, sf_dir)


@query(f"with {D.gridded()} select x, y, gre, gim, n from grid")
def a10_gather_grid(spark, sf_dir):
    return G.gather_grid(points(spark, sf_dir), T.convolution_table(spark), SIZE)


@query(f"with {D.gridded(re='1.0', im='0.0')} select x, y, gre, gim, n from grid")
def a15_psf_grid(spark, sf_dir):
    return G.grid(ones(points(spark, sf_dir)), T.convolution_table(spark), SIZE)


@query(f"with {D.VIS}, {D.GCF}, {D.pregrid()}, {D.inside()}, {D.grid(keys='bl,')} select bl, x, y, gre, gim, n from grid where bl = 3")
def a8_grid_by_baseline(spark, sf_dir):
    """One baseline's grid: the filter on the baseline reaches the scan."""
    return G.grid(points(spark, sf_dir).filter("bl = 3"), T.convolution_table(spark), SIZE, ["bl"])


@query(f"with {D.VIS}, {D.GCF}, {D.pregrid()}, {D.inside()}, {D.grid(keys='bl,')} select bl, x, y, gre, gim, n from grid")
def a8_grid_all_baselines(spark, sf_dir):
    """Every baseline's grid."""
    return G.grid(points(spark, sf_dir), T.convolution_table(spark), SIZE, ["bl"])


@query(
    f"""with {D.VIS}, {D.GCF}, s as (select *, least(8, 4 + cast(round(abs(w) / 50.0) as integer)) as support, cast(floor((u - floor(u)) * 8) as integer) as ou,
    cast(floor((v - floor(v)) * 8) as integer) as ov, cast(floor(u) as integer) + 128 as px, cast(floor(v) as integer) + 128 as py from vis),
    p as (select *, px - support // 2 as x, py - support // 2 as y, (8 - support) // 2 as start from s),
    f as (select * from p where x >= 0 and y >= 0 and x < 256 - support and y < 256 - support)
    select x + su - start as x, y + sv - start as y, sum(re * gr - im * (case when w < 0 then -gi else gi end)) as gre,
    sum(re * (case when w < 0 then -gi else gi end) + im * gr) as gim, count(*) as n
    from f join gcf using (ou, ov) where su between start and start + support - 1 and sv between start and start + support - 1 group by all"""
)
def a9_w_grid(spark, sf_dir):
    """Gridding whose support grows with the w-plane; negative w by the conjugate table."""
    return G.w_grid(T.visibilities(spark, sf_dir), T.convolution_table(spark), 1, 4, 8, GRID, 50.0)


@query(f"with {D.VIS}, {D.GCF}, {D.pregrid()}, {D.inside()} select t % 4 as pol, x + su as x, y + sv as y, sum(re * gr) as gre, sum(im * gi) as gim from pts join gcf using (ou, ov) group by all")
def a12_grid_simple(spark, sf_dir):
    return G.grid_simple(points(spark, sf_dir).withColumn("pol", F.col("t") % 4), T.convolution_table(spark))


@query(f"with {D.VIS} select cast(round(u) as integer) as x, cast(round(v) as integer) as y, sum(re) as gre, sum(im) as gim, count(*) as n from vis group by all")
def a13_grid_nearest(spark, sf_dir):
    return G.grid_nearest(T.visibilities(spark, sf_dir))


@query(f"with {D.VIS} select vis_id, u, v, re / count(*) over c as re, im / count(*) over c as im from vis window c as (partition by cast(round(u) as integer), cast(round(v) as integer))")
def a14_reweight(spark, sf_dir):
    return G.uniform_weight(T.visibilities(spark, sf_dir)).select("vis_id", "u", "v", "re", "im")


_SEEN = f"""with {D.gridded()}, c as (select distinct x, y, ou, ov from pts),
    s as (select c.x, c.y, c.ou, c.ov, sum(gre * gr - gim * gi) as pre, sum(gre * gi + gim * gr) as pim from c join gcf using (ou, ov) join grid on grid.x = c.x + su and grid.y = c.y + sv group by all)"""


@query(f"{_SEEN} select vis_id, u, v, re - coalesce(pre, 0) as re, im - coalesce(pim, 0) as im from pts left join s using (x, y, ou, ov)")
def a16_degrid(spark, sf_dir):
    """Visibilities less what the gridded image predicts."""
    pts = points(spark, sf_dir)
    gcf = T.convolution_table(spark)
    return G.degrid(pts, cut(G.grid(pts, gcf, SIZE), "grid"), gcf).select("vis_id", "u", "v", "re", "im")


@query(f"{_SEEN} select vis_id, u, v, coalesce(pre, 0) as re, coalesce(pim, 0) as im from pts left join s using (x, y, ou, ov)")
def a17_predict(spark, sf_dir):
    pts = points(spark, sf_dir)
    gcf = T.convolution_table(spark)
    return G.degrid(pts, cut(G.grid(pts, gcf, SIZE), "grid"), gcf, predict=True).select("vis_id", "u", "v", "re", "im")


@query(
    f"with {D.gridded()} select case when y < 128 then x else 255 - x end as x, case when y < 128 then y else 255 - y end as y, sum(gre) as gre, sum(case when y < 128 then gim else -gim end) + 0.0 as gim from grid group by all"
)
def m9_hermitian_fold(spark, sf_dir):
    return G.hermitian_fold(gridded(spark, sf_dir), GRID).withColumn("gim", F.col("gim") + 0.0)


@query(f"with {D.gridded()} select x, y, gre / 65536 + 0.0 as gre, gim / 65536 + 0.0 as gim, n from grid")
def p10_normalise(spark, sf_dir):
    g = G.normalise(gridded(spark, sf_dir), 1.0 / GRID**2)
    return g.withColumns({"gre": F.col("gre") + 0.0, "gim": F.col("gim") + 0.0})


@query(f"with {D.VIS}, {D.pregrid()} select vis_id, u, v, x, y, ou, ov, x between 0 and 247 and y between 0 and 247 as inbound from pre")
def p7_pregrid(spark, sf_dir):
    p = G.pregrid(T.visibilities(spark, sf_dir), GRID, SIZE, OVER)
    return p.select("vis_id", "u", "v", "x", "y", "ou", "ov", (F.col("x").between(0, GRID - SIZE - 1) & F.col("y").between(0, GRID - SIZE - 1)).alias("inbound"))


@query(
    f"""with {D.VIS}, p as (select *, cast(floor(u) as integer) + 124 as x, cast(floor(v) as integer) + 124 as y, cast(floor((u - floor(u)) * 8) as integer) as ou,
    cast(floor((v - floor(v)) * 8) as integer) as ov, cast(round(abs(w) / 25.0) as integer) as wp from vis)
    select vis_id, u, v, x, y, ou, ov, wp, case when w < 0 then -((wp * 8 + ou) * 8 + ov) else (wp * 8 + ou) * 8 + ov end as layer from p"""
)
def p6_w_pregrid(spark, sf_dir):
    return G.w_pregrid(T.visibilities(spark, sf_dir), GRID, SIZE, WSTEP, OVER, mirror=True).select("vis_id", "u", "v", "x", "y", "ou", "ov", "wp", "layer")


@query(f"with {D.VIS} select bl, sum(re * cos(2 * pi() * w * 0.001) - im * sin(2 * pi() * w * 0.001)).round(6) + 0.0 as re, sum(re * sin(2 * pi() * w * 0.001) + im * cos(2 * pi() * w * 0.001)).round(6) + 0.0 as im from vis group by all")
def p3_rotate(spark, sf_dir):
    """Phase rotation by w, summed by baseline."""
    re, im = cx.turned((F.col("re"), F.col("im")), F.lit(2 * math.pi) * F.col("w") * 0.001)
    out = T.visibilities(spark, sf_dir).groupBy("bl").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    return out.select("bl", *[(F.round(c, 6) + 0.0).alias(c) for c in ("re", "im")])


_L, _M = 0.01, 0.02
_SHIFT = sky.facet_shift(_L, _M)
_ANGLE = "(" + " + ".join(f"({2 * math.pi * s!r}) * {c}" for s, c in zip(_SHIFT, "uvw")) + ")"


@query(f"with {D.VIS} select bl, round(sum(re * cos({_ANGLE}) - im * sin({_ANGLE})), 6) + 0.0 as re, round(sum(re * sin({_ANGLE}) + im * cos({_ANGLE})), 6) + 0.0 as im from vis group by all")
def p4_facet_rotate(spark, sf_dir):
    """Visibilities turned to a facet's phase centre, summed by baseline."""
    angle = sum(F.lit(2 * math.pi * s) * F.col(c) for s, c in zip(_SHIFT, "uvw"))
    re, im = cx.turned((F.col("re"), F.col("im")), angle)
    out = T.visibilities(spark, sf_dir).groupBy("bl").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
    return out.select("bl", *[(F.round(c, 6) + 0.0).alias(c) for c in ("re", "im")])


@query(f"with {D.VIS} select bl, count(*) as n, min(u) as u_min, max(u) as u_max, min(v) as v_min, max(v) as v_max, min(w) as w_min, max(w) as w_max from vis group by grouping sets ((bl), ())")
def s2_header(spark, sf_dir):
    """Counts and ranges of u, v, w by baseline and, under a null baseline, over all."""
    stats = [f(c).alias(f"{c}_{n}") for c in "uvw" for n, f in (("min", F.min), ("max", F.max))]
    return T.visibilities(spark, sf_dir).rollup("bl").agg(F.count("*").alias("n"), *stats)


@query(f"with {D.VIS} select vis_id, bl, t, u, v, w, re, im from vis where bl between 4 and 7")
def s3_select(spark, sf_dir):
    return T.select_visibilities(T.visibilities(spark, sf_dir), 4 * 200, 8 * 200, 16, 200)


@query(f"with {D.gridded()} select x, y, gre, gim from grid where y // 64 = 1")
def s17_dump_reload(spark, sf_dir):
    """The grid dumped by tile row and one tile row reloaded: only that folder is read."""
    path = new_path(spark, "dump")
    T.write_by_region(gridded(spark, sf_dir).withColumn("tile", F.floor(F.col("y") / 64).cast("int")), path, "tile")
    return spark.read.parquet(path).filter("tile = 1").select("x", "y", "gre", "gim")


@query(
    f"""with {D.VIS}, r as (select least(0, min(w)) as lo, greatest(0, max(w)) as hi from vis)
    select cast(floor(u / 64) as integer) as tile_u, cast(floor(v / 64) as integer) as tile_v,
    greatest(0, least(9, cast(floor((w - lo) / (hi + (hi - lo) * 1e-4 - lo) * 10) as integer))) as wbin, count(*) as n from vis, r group by all"""
)
def a24_bin_sizes(spark, sf_dir):
    return B.bin_sizes(T.visibilities(spark, sf_dir), BINS, 64)


@query(
    f"""with {D.VIS}, e as (select *, [floor((u - 8) / 64), floor(u / 64), floor((u + 8) / 64)] as tu, [floor((v - 8) / 64), floor(v / 64), floor((v + 8) / 64)] as tv from vis),
    a as (select *, unnest(list_distinct(tu)) as a from e), b as (select *, unnest(list_distinct(tv)) as b from a)
    select cast(a as integer) as tile_u, cast(b as integer) as tile_v, count(*) as n, count(*) filter (where a = floor(u / 64) and b = floor(v / 64)) as own from b group by all"""
)
def j8_margin(spark, sf_dir):
    """Points by tile, with the copies that neighbours' margins add."""
    tiles = B.with_margin(T.visibilities(spark, sf_dir), 64, 8)
    return tiles.groupBy("tile_u", "tile_v").agg(F.count("*").alias("n"), F.count_if("home").alias("own"))


@query(
    f"""with {D.VIS} select cast((floor(u) % 8 + 8) % 8 as integer) as su, cast((floor(v) % 8 + 8) % 8 as integer) as sv, count(*) as n,
    avg(cast(floor(u) between -64 and 63 and floor(v) between -64 and 63 as integer)) as inbound from vis group by all"""
)
def a25_occupancy(spark, sf_dir):
    return B.sub_cell_occupancy(T.visibilities(spark, sf_dir), 8, 128)


_BLOCKS = f"with {D.VIS}, b as (select cast(floor(v / 16) as integer) as block_y, cast(floor(u / 16) as integer) as block_x, count(*) as n from vis group by all)"


@query(f"{_BLOCKS} select block_y, block_x, n, cast(coalesce(sum(n) over (order by block_y, block_x rows between unbounded preceding and 1 preceding), 0) as bigint) as first from b")
def w4_bookmarks(spark, sf_dir):
    return B.bookmarks(T.visibilities(spark, sf_dir), 16)


@query(f"with {D.VIS} select cast(round(w / 25.0) as integer) as wp, sum(w) as w_sum, count(*) as n, avg(w) as w_mean from vis group by all")
def a22_w_planes(spark, sf_dir):
    wp = F.round(F.col("w") / WSTEP).cast("int").alias("wp")
    return T.visibilities(spark, sf_dir).groupBy(wp).agg(F.sum("w").alias("w_sum"), F.count("*").alias("n"), F.avg("w").alias("w_mean"))


@query(
    f"""with {D.VIS}, b as (select bl, min(w) as lo, max(w) as hi from vis group by bl) select bl, lo, hi,
    cast(case when hi < 0 then round(hi / 25.0) when lo > 0 then round(lo / 25.0) else 0 end as integer) as w_plane from b order by w_plane, bl"""
)
def o3_baseline_planes(spark, sf_dir):
    """W-plane of each baseline, in plane order."""
    b = T.visibilities(spark, sf_dir).groupBy("bl").agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    plane = F.when(F.col("hi") < 0, F.round(F.col("hi") / WSTEP)).when(F.col("lo") > 0, F.round(F.col("lo") / WSTEP)).otherwise(0)
    return b.withColumn("w_plane", plane.cast("int")).orderBy("w_plane", "bl")


@query(f"with {D.VIS} select bl, cast(sum((floor(abs(w) / 25) * 8 + 17) ** 2) as bigint) as grid_points, count(*) as n from vis group by all")
def a26_grid_points(spark, sf_dir):
    support = F.floor(F.abs("w") / WSTEP) * 8 + 17
    return T.visibilities(spark, sf_dir).groupBy("bl").agg(F.sum(support * support).cast("bigint").alias("grid_points"), F.count("*").alias("n"))


_SIZES = [(0.0, 16), (60.0, 32), (120.0, 64)]


@query(
    f"""with {D.VIS}, g(w0, size) as (values {', '.join(f'({w}::double, {s})' for w, s in _SIZES)}), b as (select cast(floor(abs(w) / 20) as integer) as wbin, count(*) as n from vis group by all)
    select wbin, n, size, cast(8 * size * size * n as bigint) as flops from b asof join g on b.wbin * 20 >= g.w0"""
)
def a27_flops(spark, sf_dir):
    """Operations per w-bin: the table size is chosen as of the bin's w, eight operations a point of its square."""
    steps = spark.createDataFrame(_SIZES, "w0 double, size int")
    bins = T.visibilities(spark, sf_dir).groupBy(F.floor(F.abs("w") / 20).cast("int").alias("wbin")).agg(F.count("*").alias("n"))
    at = R.as_of(bins.withColumn("w_low", F.col("wbin") * 20.0), steps, "w_low", "w0")
    return at.select("wbin", "n", "size", (8 * F.col("size") * F.col("size") * F.col("n")).cast("bigint").alias("flops"))


_IMG = f"with {D.gridded()}"


@query(f"{_IMG}, a as (select y, x, gre as val from grid), b as (select y, x, gim as val from grid) select y, x, sum(val) as val from (select * from a union all select * from b) group by all")
def a18_image_sum(spark, sf_dir):
    g = cut(gridded(spark, sf_dir), "grid")
    return M.image_sum(g.select("y", "x", F.col("gre").alias("val")), g.select("y", "x", F.col("gim").alias("val")))


@query(f"{_IMG} select y, x, gre as val from grid order by abs(gre) desc, y, x limit 1")
def a19_peak(spark, sf_dir):
    return M.peak(gridded(spark, sf_dir).select("y", "x", F.col("gre").alias("val")))


@query(f"{_IMG} select max(sqrt(gre * gre + gim * gim)) as magnitude from grid")
def a20_max_magnitude(spark, sf_dir):
    return gridded(spark, sf_dir).agg(F.max(cx.magnitude((F.col("gre"), F.col("gim")))).alias("magnitude"))


@query(f"{_IMG} select x as y, y as x, gre as val from grid")
def m20_transpose(spark, sf_dir):
    return M.transpose(gridded(spark, sf_dir).select("y", "x", F.col("gre").alias("val")))


@query(f"{_IMG} select case when y < 4 * 37 then y // 37 else 4 + (y - 4 * 37) // 36 end as part, count(*) as n, sum(gre) as gre from grid group by all")
def m21_row_parts(spark, sf_dir):
    """Cells per part of the rows dealt to seven parts, the first ones a row longer."""
    return gridded(spark, sf_dir).groupBy(M.part_of("y", GRID, 7).alias("part")).agg(F.count("*").alias("n"), F.sum("gre").alias("gre"))


@query(f"{_IMG} select y, x, gre, gim from grid where y between 0 and 255 and x between 0 and 255")
def m2_detile(spark, sf_dir):
    """Grids of tiles with margins, each gridded for itself, added up: the same as one grid."""
    pts = points(spark, sf_dir).withColumns({"top": F.floor(F.col("y") / 64).cast("int") * 64, "left": F.floor(F.col("x") / 64).cast("int") * 64})
    tiles = G.grid(pts, T.convolution_table(spark), SIZE, ["top", "left"])
    return M.detile(tiles.withColumns({"ty": F.col("y") - F.col("top"), "tx": F.col("x") - F.col("left")}), GRID, GRID)


@query(f"{_IMG} select y, x, gre as val from grid where y < 200 and x < 200")
def m3_defacet(spark, sf_dir):
    """Facets of 128 pixels pasted into an image of 200."""
    g = gridded(spark, sf_dir)
    facets = g.select(F.floor(F.col("x") / 128).cast("int").alias("l"), F.floor(F.col("y") / 128).cast("int").alias("m"), (F.col("y") % 128).alias("y"), (F.col("x") % 128).alias("x"), F.col("gre").alias("val"))
    return M.defacet(facets, 128, 200, 200)


def _dft(source: str, sign: int, n: int) -> str:
    angle = f"{sign} * 2 * pi() * ((c - {n // 2}) * (k - {n // 2})) / {n}"
    step = lambda src, line, along: f"""(select {line} as line, k as along, sum(gre * cos({angle}) - gim * sin({angle})) as gre, sum(gre * sin({angle}) + gim * cos({angle})) as gim
        from (select {line}, {along} as c, gre, gim from {src}), range({n}) r(k) group by all)"""  # noqa: E731
    rows = step(source, "y", "x")
    return step(f"(select line as y, along as x, gre, gim from {rows})", "x", "y")


_SMALL = f"with {D.gridded(SMALL)}"


@query(
    f"""{_SMALL}, h as (select y, x, sum(gre) / 2 as gre, sum(gim) / 2 as gim from (select y, x, gre, gim from grid union all select {SMALL - 1} - y, {SMALL - 1} - x, gre, -gim from grid) group by all)
    select along as y, line as x, round(gre / {SMALL} + {OFF_TIES}, 4) + 0.0 as val from {_dft('h', 1, SMALL)}"""
)
def m5_inverse_fft(spark, sf_dir):
    """Dirty image: Hermitian part of the grid, inverse transform by rows and columns."""
    return M.ifft2(gridded(spark, sf_dir, SMALL), SMALL).select("y", "x", (F.round(F.col("val") + OFF_TIES, 4) + 0.0).alias("val"))


@query(
    f"""{_SMALL}, i as (select y, x, gre, 0.0 as gim from grid) select along as y, line as x, round(gre / {SMALL} + {OFF_TIES}, 4) + 0.0 as gre, round(gim / {SMALL} + {OFF_TIES}, 4) + 0.0 as gim from {_dft('i', -1, SMALL)}"""
)
def m4_forward_fft(spark, sf_dir):
    image = gridded(spark, sf_dir, SMALL).select("y", "x", F.col("gre").alias("val"))
    return M.fft2(image, SMALL).select("y", "x", *[(F.round(F.col(c) + OFF_TIES, 4) + 0.0).alias(c) for c in ("gre", "gim")])


def _fast_dft(source: str, sign: int, n: int) -> str:
    """As _dft(), with the turns of a circle in a list rather than computed for each term."""
    turn = f"((c - {n // 2}) * (k - {n // 2}) % {n} + {n}) % {n} + 1"
    step = lambda src, line, along: f"""(select {line} as line, k as along, sum(gre * cs[{turn}] - gim * {sign} * sn[{turn}]) as gre, sum(gre * {sign} * sn[{turn}] + gim * cs[{turn}]) as gim
        from (select {line}, {along} as c, gre, gim from {src}), range({n}) r(k), turns group by all)"""  # noqa: E731
    rows = step(source, "y", "x")
    return step(f"(select line as y, along as x, gre, gim from {rows})", "x", "y")


_TURNS = f"turns as (select list(cos(2 * pi() * m / {GRID}) order by m) as cs, list(sin(2 * pi() * m / {GRID}) order by m) as sn from range({GRID}) r(m))"
_ALL = f"with {D.VIS}, {D.GCF}, {D.pregrid(source='(select * replace (u * 0.96 as u, v * 0.96 as v) from vis)')}, {D.inside()}, {D.grid()}, {_TURNS}"


@query(
    f"""{_ALL}, h as (select y, x, sum(gre) / 2 as gre, sum(gim) / 2 as gim from (select y, x, gre, gim from grid union all select {GRID - 1} - y, {GRID - 1} - x, gre, -gim from grid) group by all)
    select along as y, line as x, round(gre / {GRID} + {OFF_TIES}, 3) + 0.0 as val from {_fast_dft('h', 1, GRID)}"""
)
def m5_inverse_fft_all(spark, sf_dir):
    """Dirty image of all visibilities."""
    image = M.ifft2(G.grid(points(spark, sf_dir, scale=WHOLE), T.convolution_table(spark), SIZE), GRID)
    return image.select("y", "x", (F.round(F.col("val") + OFF_TIES, 3) + 0.0).alias("val"))


@query(
    f"""{_ALL}, i as (select y, x, gre, 0.0 as gim from grid)
    select along as y, line as x, round(gre / {GRID} + {OFF_TIES}, 3) + 0.0 as gre, round(gim / {GRID} + {OFF_TIES}, 3) + 0.0 as gim from {_fast_dft('i', -1, GRID)}"""
)
def m4_forward_fft_all(spark, sf_dir):
    """Forward transform of the real part of the grid of all visibilities."""
    g = G.grid(points(spark, sf_dir, scale=WHOLE), T.convolution_table(spark), SIZE)
    out = M.fft2(g.select("y", "x", F.col("gre").alias("val")), GRID)
    return out.select("y", "x", *[(F.round(F.col(c) + OFF_TIES, 3) + 0.0).alias(c) for c in ("gre", "gim")])


@query()
def m15_clean(spark, sf_dir):
    """Imaging: dirty image and point spread function of all visibilities, twelve CLEAN cycles, the model."""
    pts = points(spark, sf_dir, scale=WHOLE)
    gcf = T.convolution_table(spark)
    dirty, psf = (cut(M.ifft2(G.grid(p, gcf, SIZE), GRID), "image") for p in (pts, ones(pts)))
    found, _ = tiled_clean.clean(dirty, psf, GRID, 0.1, 0.0)
    return M.image_sum(found.select("y", "x", "val"))


_BLOCK = 8
_EDGE = GRID // _BLOCK
_BEAM = f"floor(1024 / (1 + ((y - {_EDGE // 2}) * (y - {_EDGE // 2}) + (x - {_EDGE // 2}) * (x - {_EDGE // 2})) / 4.0)) / 1024"
_HOGBOM = f"""with recursive {D.gridded()}, cells as (select i, i // {_EDGE} as y, i % {_EDGE} as x from range({_EDGE * _EDGE}) r(i)),
    blocks as (select y // {_BLOCK} as y, x // {_BLOCK} as x, sum(gre) as val from grid group by all),
    img as (select list(coalesce(val, 0.0::double) order by i) as vals from cells left join blocks on blocks.y = cells.y and blocks.x = cells.x),
    psf as (select list(cast({_BEAM.replace('4.0', '4.0::double')} as double) order by i) as p from cells),
    r as (select 0 as cycle, vals, cast(null as bigint) as y, cast(null as bigint) as x, cast(null as double) as flux from img
        union all
        select cycle + 1, list_transform(range(1, {_EDGE * _EDGE + 1}), lambda j: v[j] - (0.125::double * v[pk]) * (case when (j - 1) // {_EDGE} - ay between -{_EDGE // 2} and {_EDGE // 2 - 1} and (j - 1) % {_EDGE} - ax between -{_EDGE // 2} and {_EDGE // 2 - 1}
            then p[((j - 1) // {_EDGE} - ay + {_EDGE // 2}) * {_EDGE} + (j - 1) % {_EDGE} - ax + {_EDGE // 2} + 1] else 0 end)), ay, ax, 0.125::double * v[pk]
        from (select cycle, vals as v, pk, (pk - 1) // {_EDGE} as ay, (pk - 1) % {_EDGE} as ax from (select cycle, vals, list_position(list_transform(vals, lambda e: abs(e)), list_max(list_transform(vals, lambda e: abs(e)))) as pk from r where cycle < 20)) s, psf)"""


def _small_clean(spark, sf_dir):
    """Twenty CLEAN cycles with gain 1/8 over the grid summed by blocks of 8 x 8 cells, in tiles of 8."""
    block = lambda c: F.floor(F.col(c) / _BLOCK).cast("int").alias(c)
    blocks = gridded(spark, sf_dir).groupBy(block("y"), block("x")).agg(F.sum("gre").alias("val"))
    at = spark.range(_EDGE * _EDGE).select(F.floor(F.col("id") / _EDGE).cast("int").alias("y"), (F.col("id") % _EDGE).cast("int").alias("x"))
    psf = at.withColumn("val", F.expr(_BEAM.replace("4.0", "4.0D")).cast("double"))
    return tiled_clean.clean(blocks, psf, _EDGE, 0.125, 0.0, 20, tile=8, every=6)


@query(f"{_HOGBOM} select cast(cycle - 1 as integer) as cycle, cast(y as integer) as y, cast(x as integer) as x, flux as val from r where cycle > 0")
def m14_components(spark, sf_dir):
    """Components of CLEAN in their order."""
    return _small_clean(spark, sf_dir)[0]


@query(f"{_HOGBOM} select cast((i - 1) // {_EDGE} as integer) as y, cast((i - 1) % {_EDGE} as integer) as x, vals[i] as val from r, range(1, {_EDGE * _EDGE + 1}) c(i) where cycle = 20")
def m16_residual(spark, sf_dir):
    """What CLEAN leaves of the image."""
    return _small_clean(spark, sf_dir)[1]


_KSUP, _KOVER, _KTHETA = 16, 4, 0.04
_KPAD = _KSUP * _KOVER


def _kernel_sql() -> str:
    """Two passes of a centred transform over the screen, which fills the middle of the padded array."""
    turn = lambda j, i: f"(2 * pi() * ({j} - {_KPAD // 2}) * ({i} - {_KSUP // 2}) / {_KPAD})"
    step = lambda src, keep, i, j: f"""select {keep}, j as {j}, sum(re * cos({turn('j', i)}) - im * sin({turn('j', i)})) / {_KPAD} as re, sum(re * sin({turn('j', i)}) + im * cos({turn('j', i)})) / {_KPAD} as im
        from {src}, range({_KPAD}) r(j) group by all"""  # noqa: E731
    at = lambda i: f"(({i} - {_KSUP // 2}) / {_KSUP}.0::double * {_KTHETA})"
    return f"""with {D.VIS}, p as (select cast(round(w / 25.0) as integer) as wp, avg(w) as w from vis group by all),
    s as (select wp, y, x, -2 * pi() * w * (1 - sqrt(1 - ({at('y')} * {at('y')} + {at('x')} * {at('x')}))) as phase from p, range({_KSUP}) a(y), range({_KSUP}) b(x)),
    c as (select wp, y, x, cos(phase) as re, sin(phase) as im from s), a as ({step('c', 'wp, y', 'x', 'ju')}), b as ({step('a', 'wp, ju', 'y', 'jv')}),
    k as (select wp, cast(ju % {_KOVER} as integer) as ou, cast(jv % {_KOVER} as integer) as ov, cast(ju // {_KOVER} as integer) as su, cast(jv // {_KOVER} as integer) as sv, re, im from b),
    n as (select *, sum(re) over (partition by wp, ou, ov) as total from k)
    select wp, ou, ov, su, sv, round(re / total + {OFF_TIES}, 5) + 0.0 as re, round(im / total + {OFF_TIES}, 5) + 0.0 as im from n"""


@query(_kernel_sql())
def m11_w_kernels(spark, sf_dir):
    """Convolution functions for the mean w of every w-plane that occurs."""
    planes = a22_w_planes(spark, sf_dir).select("wp", F.col("w_mean").alias("w"))
    out = M.w_kernels(planes, _KSUP, _KOVER, _KTHETA)
    return out.select("wp", "ou", "ov", "su", "sv", *[(F.round(F.col(c) + OFF_TIES, 5) + 0.0).alias(c) for c in ("re", "im")])


_SYSTEM = {"ref": (0.3, 0.5), "at": (128.0, 128.0), "cd": [[-0.002, 0.0], [0.0, 0.002]]}
_OTHER = {"ref": (0.302, 0.501), "at": (128.0, 128.0), "cd": [[-0.0019, 0.0001], [0.0001, 0.0019]]}


def _world(x: str, y: str, ref, at, cd) -> tuple[str, str]:
    """SQL of the sky position of a pixel."""
    dx, dy = f"({x} - {at[0]!r})", f"({y} - {at[1]!r})"
    xi, eta = f"({cd[0][0]!r} * {dx} + {cd[0][1]!r} * {dy})", f"({cd[1][0]!r} * {dx} + {cd[1][1]!r} * {dy})"
    down = f"(cos({ref[1]!r}) - {eta} * sin({ref[1]!r}))"
    return f"({ref[0]!r} + atan2({xi}, {down}))", f"atan2(sin({ref[1]!r}) + {eta} * cos({ref[1]!r}), sqrt({xi} * {xi} + {down} * {down}))"


def _pixel(lon: str, lat: str, ref, at, cd) -> tuple[str, str]:
    """SQL of the pixel of a sky position."""
    dl = f"({lon} - {ref[0]!r})"
    depth = f"(sin({lat}) * sin({ref[1]!r}) + cos({lat}) * cos({ref[1]!r}) * cos({dl}))"
    xi = f"(cos({lat}) * sin({dl}) / {depth})"
    eta = f"((sin({lat}) * cos({ref[1]!r}) - cos({lat}) * sin({ref[1]!r}) * cos({dl})) / {depth})"
    det = cd[0][0] * cd[1][1] - cd[0][1] * cd[1][0]
    return f"({at[0]!r} + {cd[1][1] / det!r} * {xi} - {cd[0][1] / det!r} * {eta})", f"({at[1]!r} + {cd[0][0] / det!r} * {eta} - {cd[1][0] / det!r} * {xi})"


_LON, _LAT = _world("x", "y", **_OTHER)
_SX, _SY = _pixel("lon", "lat", **_SYSTEM)


@query(f"{_IMG}, w as (select x, y, {_LON} as lon, {_LAT} as lat from grid) select x, y, round(lon, 9) as lon, round(lat, 9) as lat, round({_SX}, 6) as px, round({_SY}, 6) as py from w")
def p19_world_pixel(spark, sf_dir):
    """Sky position of every grid cell in one system, and its pixel in another."""
    g = gridded(spark, sf_dir).select("x", "y")
    lon, lat = sky.pixel_to_world(F.col("x").cast("double"), F.col("y").cast("double"), **_OTHER)
    px, py = sky.world_to_pixel(lon, lat, **_SYSTEM)
    return g.select("x", "y", F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"), F.round(px, 6).alias("px"), F.round(py, 6).alias("py"))


@query(
    f"""{_IMG}, o as (select cast(i // 256 as integer) as y, cast(i % 256 as integer) as x from range(65536) r(i)), w as (select x, y, {_LON} as lon, {_LAT} as lat from o),
    s as (select x, y, {_SX} as sx, {_SY} as sy from w), c as (select x, y, cast(floor(sx) as integer) + i as ix, cast(floor(sy) as integer) + j as iy,
    (case i when 1 then sx - floor(sx) else 1 - (sx - floor(sx)) end) * (case j when 1 then sy - floor(sy) else 1 - (sy - floor(sy)) end) as weight from s, range(2) a(i), range(2) b(j))
    select c.y, c.x, round(sum(weight * coalesce(gre, 0)) + {OFF_TIES}, 4) + 0.0 as val from c left join grid on grid.x = ix and grid.y = iy group by c.y, c.x"""
)
def m18_reproject(spark, sf_dir):
    """The gridded image resampled to another tangent-plane system."""
    image = gridded(spark, sf_dir).select("y", "x", F.col("gre").alias("val"))
    out = M.reproject(image, GRID, lambda x, y: sky.world_to_pixel(*sky.pixel_to_world(x, y, **_OTHER), **_SYSTEM))
    return out.withColumn("val", F.round(F.col("val") + OFF_TIES, 4) + 0.0)


@query(f"{_IMG}, two as (select y, x, gre as val, 1 as own from grid union all select y + 3, x + 5, -0.5 * gre, 0 from grid) select y, x, sum(val) as val from two group by y, x having max(own) = 1")
def m17_subtract_shifted(spark, sf_dir):
    image = cut(gridded(spark, sf_dir).select("y", "x", F.col("gre").alias("val")), "image")
    return M.subtract_shifted(image, image, 3, 5, 0.5)


@query(f"with {D.VIS} select bl, round(max(u / 2.99792458), 9) as u, round(max(v / 2.99792458), 9) as v, round(max(w / 2.99792458), 9) as w from vis group by all")
def s2_wavelengths(spark, sf_dir):
    """Greatest coordinates by baseline, in wavelengths at 100 MHz."""
    vis = T.in_wavelengths(T.visibilities(spark, sf_dir), 1e8)
    return vis.groupBy("bl").agg(*[F.round(F.max(c), 9).alias(c) for c in "uvw"])


@query(f"with {D.VIS}, {D.GCF}, {D.pregrid()}, {D.inside()}, {D.grid('2.0', '-1.0')} select x, y, gre, gim, n from grid")
def p2_constant(spark, sf_dir):
    """The grid of visibilities set to one value."""
    return G.grid(T.constant(points(spark, sf_dir), 2.0, -1.0), T.convolution_table(spark), SIZE)


@query(f"with {D.VIS}, {D.GCF}, {D.pregrid()}, {D.inside()} select x, y, gre / 65536 + 0.0 as gre, gim / 65536 + 0.0 as gim from (select x + su as x, y + sv as y, sum(re * gr) as gre, sum(im * gi) as gim from pts join gcf using (ou, ov) where t % 4 = 2 group by all)")
def p11_polarisation(spark, sf_dir):
    """One polarisation of the four-polarisation grid, normalised; the filter goes below the aggregates."""
    g = G.polarisation(a12_grid_simple(spark, sf_dir), 2, GRID)
    return g.withColumns({"gre": F.col("gre") + 0.0, "gim": F.col("gim") + 0.0})


@query(f"with {D.VIS}, s as (select *, cast(floor(u) as integer) + 128 as x, cast(floor(v) as integer) + 128 as y, least(30, 8 + 2 * cast(round(abs(w) / 25.0) as integer)) as support from vis) select support, count(*) as n from s where x >= 0 and y >= 0 and x < 256 - support and y < 256 - support group by all")
def p9_in_bounds(spark, sf_dir):
    """Points in bounds by the support of their w-plane."""
    support = G.layer_support(F.round(F.abs("w") / WSTEP).cast("int"), 8, 2, 30)
    placed = T.visibilities(spark, sf_dir).withColumns({"x": F.floor("u").cast("int") + 128, "y": F.floor("v").cast("int") + 128, "support": support})
    return G.in_bounds_support(placed, GRID, "support").groupBy("support").agg(F.count("*").alias("n"))


@query(f"with {D.gridded()}, c as (select i // 256 as y, i % 256 as x from range(65536) r(i)) select cast(c.y as integer) as y, cast(c.x as integer) as x, coalesce(gre, 0) as gre, coalesce(gim, 0) as gim from c left join grid on grid.x = c.x and grid.y = c.y")
def m1_dense_grid(spark, sf_dir):
    return M.dense(gridded(spark, sf_dir), GRID)


@query(f"with {D.VIS}, {D.GCF.replace('/ 16.0 as gi', '/ -16.0 as gi')}, {D.pregrid()}, n as (select * from pre where w < 0), pts as (select * from n where x between 0 and 247 and y between 0 and 247), {D.grid()} select x, y, gre, gim, n from grid")
def s8_conjugate_table(spark, sf_dir):
    """Gridding of the negative w-range with the conjugate table; the filter on w reaches the scan."""
    gcf = T.conjugated(T.convolution_table(spark), -200.0, 0.0)
    return G.grid(points(spark, sf_dir).filter("w < 0"), gcf, SIZE)


_RANGES = [(-100.0, -20.0, "low"), (-20.0, 35.0, "mid"), (60.0, 200.0, "high")]


@query(f"with {D.VIS}, r(lo, hi, name) as (values {', '.join(f'({a}::double, {b}::double, {c!r})' for a, b, c in _RANGES)}) select name, count(*) as n, min(w) as w_min, max(w) as w_max from vis left join r on w >= lo and w < hi group by name")
def j6_range_lookup(spark, sf_dir):
    """Visibilities by the named w-range that holds them, null for none."""
    ranges = spark.createDataFrame(_RANGES, "lo double, hi double, name string")
    return R.in_range(T.visibilities(spark, sf_dir), ranges, "w").groupBy("name").agg(F.count("*").alias("n"), F.min("w").alias("w_min"), F.max("w").alias("w_max"))


@query(f"with {D.VIS} select cast(floor(v / 16) as integer) as block_y, cast(floor(u / 16) as integer) as block_x, cast(floor((u - floor(u)) * 8) * 8 + floor((v - floor(v)) * 8) as integer) as sub, vis_id, u, v from vis")
def o5_block_sort(spark, sf_dir):
    """Points dealt by block and sorted within partitions by block and sub-cell."""
    return B.sort_into_blocks(T.visibilities(spark, sf_dir), 16).select("block_y", "block_x", F.col("sub").cast("int").alias("sub"), "vis_id", "u", "v")


@query(
    f"""with {D.VIS}, r as (select least(0, min(w)) as lo, greatest(0, max(w)) as hi from vis), b as (select greatest(0, least(39, cast(floor((w - lo) / (hi + (hi - lo) * 1e-4 - lo) * 40) as integer))) as wbin, count(*) as n
    from vis, r where w > -120 group by all), e as (select min(wbin) as a, max(wbin) + 1 as z from b) select cast(floor((wbin - a) * 4 / (z - a)) as integer) as part, count(*) as bins, cast(sum(n) as bigint) as n from b, e group by all"""
)
def f8_split_bins(spark, sf_dir):
    """The w-bins that hold points above a bound, split in four intervals of equal width between the first and the last of them."""
    vis = T.visibilities(spark, sf_dir)
    bins = vis.filter("w > -120").groupBy(B.w_bin(F.col("w"), *B.w_range(vis), 40).alias("wbin")).agg(F.count("*").alias("n"))
    return B.split_bins(bins.withColumn("end", F.col("wbin") + 1), "wbin", "end", 4).groupBy("part").agg(F.count("*").alias("bins"), F.sum("n").alias("n"))


@query(
    f"""with {D.VIS}, {D.GCF}, s as (select *, max(least(8, 4 + cast(round(abs(w) / 100.0) as integer))) over (partition by t) as support, cast(floor((u - floor(u)) * 8) as integer) as ou,
    cast(floor((v - floor(v)) * 8) as integer) as ov, cast(floor(u) as integer) + 128 as px, cast(floor(v) as integer) + 128 as py from vis),
    p as (select *, px - support // 2 as x, py - support // 2 as y, (8 - support) // 2 as start from s),
    f as (select * from p where x >= 0 and y >= 0 and x < 256 - support and y < 256 - support)
    select x + su - start as x, y + sv - start as y, sum(re * gr - im * (case when w < 0 then -gi else gi end)) as gre,
    sum(re * (case when w < 0 then -gi else gi end) + im * gr) as gim, count(*) as n
    from f join gcf using (ou, ov) where su between start and start + support - 1 and sv between start and start + support - 1 group by all"""
)
def a9_shared_support(spark, sf_dir):
    """W-dependent gridding at the greatest support among the points of a timestep."""
    return G.w_grid(T.visibilities(spark, sf_dir), T.convolution_table(spark), 1, 4, 8, GRID, 100.0, of="t")


@query(
    f"""with {D.VIS}, b as (select t, min(w) as lo, max(w) as hi from vis where t % 3 > 0 and w > 30 or t % 3 = 0 and w < -40 group by t),
    p as (select t, lo, hi, cast(case when lo > 0 then round_even(lo / 25.0, 0) when hi < 0 then round_even(-hi / 25.0, 0) else 0 end as integer) as least_plane from b),
    s as (select *, case when hi < 0 then -least_plane else least_plane end as plane from p)
    select t, least_plane, plane, row_number() over (order by plane, t) as place, row_number() over (order by abs(plane), plane, t) as place_abs from s"""
)
def o2_plane_order(spark, sf_dir):
    """Timesteps by w-plane and by its absolute value; the least plane that they cover is rounded half to even. A row a timestep."""
    vis = T.visibilities(spark, sf_dir).filter("t % 3 > 0 and w > 30 or t % 3 = 0 and w < -40")
    ends = vis.groupBy("t").agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    return B.plane_order(ends, "t", WSTEP)


@query(f"{_IMG} select y, x, gre * (sqrt(0.0019 * 0.0019 + 0.0001 * 0.0001) * sqrt(0.0001 * 0.0001 + 0.0019 * 0.0019)) / (0.002 * 0.002) as val from grid".replace("select y, x, gre *", "select y, x, round(gre *").replace(" as val", f" + {OFF_TIES}, 6) + 0.0 as val"))
def m19_pixel_area(spark, sf_dir):
    """The gridded image scaled by the area of another system's pixels."""
    ratio = M.pixel_area_ratio(_OTHER["cd"], _SYSTEM["cd"])
    return gridded(spark, sf_dir).select("y", "x", (F.round(F.col("gre") * ratio + OFF_TIES, 6) + 0.0).alias("val"))


@query(f"{_IMG} select y - 120 + 60 as y, x - 120 + 60 as x, gre as val from grid where y between 120 and 136 and x between 120 and 136")
def m13_centre_odd(spark, sf_dir):
    """The middle 17 x 17 cells of the grid as a kernel of half support 8, about the centre of its array oversampled eight times."""
    middle = gridded(spark, sf_dir).filter("y between 120 and 136 and x between 120 and 136")
    return M.centre_odd(middle.select((F.col("y") - 120).alias("y"), (F.col("x") - 120).alias("x"), F.col("gre").alias("val")), 8, 8)


@query(f"{_IMG} select y, string_agg(cast(gre + 0.0 as varchar), ' ' order by x) as line from grid where y < 100 group by y")
def s19_text_dump(spark, sf_dir):
    """The first hundred rows of the gridded image as text; the cap is the format's own."""
    return T.text_rows(gridded(spark, sf_dir).select("y", "x", (F.col("gre") + 0.0).alias("val")), 100)

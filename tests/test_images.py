"""Array operators against numpy on small images."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import sky
from skyloom.operators import gridding as G
from skyloom.operators import images as M
from skyloom.plans import imaging as I
from skyloom.session import cut
from skyloom.sources import tables as T


def rows_of(a):
    return [(y, x, float(v)) for (y, x), v in np.ndenumerate(a)]


def array_of(df, n, column="val"):
    out = np.zeros((n, n))
    for r in df.collect():
        out[r["y"], r["x"]] = r[column]
    return out


@pytest.fixture(scope="module")
def image_of(spark):
    return lambda a: spark.createDataFrame(rows_of(a), M.IMAGE)


def test_forward_and_inverse_transforms(spark, image_of):
    a = np.random.default_rng(1).normal(size=(16, 16))
    got = M.fft2(image_of(a), 16)
    want = np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(a))) / 16
    assert np.allclose(array_of(got, 16, "gre"), want.real) and np.allclose(array_of(got, 16, "gim"), want.imag)
    g = np.random.default_rng(2).normal(size=(2, 16, 16))
    z = g[0] + 1j * g[1]
    herm = (z + np.conj(z[::-1, ::-1])) / 2
    want = (np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(herm))) * 256 / 16).real
    grid = spark.createDataFrame([(y, x, float(v.real), float(v.imag)) for (y, x), v in np.ndenumerate(z)], M.COMPLEX)
    assert np.allclose(array_of(M.ifft2(grid, 16), 16), want)


def numpy_clean(res, psf, gain, threshold, cycles):
    res, model = res.copy(), np.zeros_like(res)
    py, px = np.unravel_index(np.abs(psf).argmax(), psf.shape)
    for _ in range(cycles):
        y, x = np.unravel_index(np.abs(res).argmax(), res.shape)
        v = res[y, x]
        if abs(v) < threshold:
            break
        model[y, x] += gain * v
        for (j, i), p in np.ndenumerate(psf):
            if 0 <= j + y - py < len(res) and 0 <= i + x - px < len(res):
                res[j + y - py, i + x - px] -= gain * v / psf[py, px] * p
    return model, res


@pytest.mark.parametrize(("gain", "threshold"), [(0.01, 10.0), (0.5, 280.0), (0.1, 1e9)])
def test_clean_of_two_bowls(image_of, gain, threshold):
    y, x = np.indices((20, 20)).astype(float)
    res, psf = 300 - (x - 10) ** 2 - (y - 10) ** 2, 150 - (x - 9) ** 2 - (y - 11) ** 2
    model, left = M.clean(image_of(res), image_of(psf), gain, threshold, 4)
    want_model, want_left = numpy_clean(res, psf, gain, threshold, 4)
    assert np.allclose(array_of(model, 20), want_model) and np.allclose(array_of(left, 20), want_left)


def test_peak_takes_the_first_of_equal_ones(image_of):
    a = np.zeros((4, 4))
    a[2, 1], a[1, 3], a[3, 3] = -5.0, 5.0, 2.0
    assert tuple(M.peak(image_of(a)).first()) == (1, 3, 5.0)


def test_w_kernels_are_normalised_transforms(spark):
    got = M.w_kernels(spark.createDataFrame([(0, 0.0), (3, 75.0)], "wp int, w double"), 8, 4, 0.04).collect()
    sums = {}
    for r in got:
        sums[r["wp"], r["ou"], r["ov"]] = sums.get((r["wp"], r["ou"], r["ov"]), 0) + r["re"]
    assert len(got) == 2 * 4 * 4 * 64 and all(math.isclose(s, 1.0) for s in sums.values())
    n, over = 8, 4
    at = (np.arange(n) - n // 2) / n * 0.04
    screen = np.exp(-2j * np.pi * 75.0 * (1 - np.sqrt(1 - at[:, None] ** 2 - at[None, :] ** 2)))
    k = np.arange(n * over) - n * over // 2
    place = np.arange(n) + (n * over - n) // 2 - n * over // 2
    e = np.exp(2j * np.pi * np.outer(k, place) / (n * over))
    full = e @ screen @ e.T
    for r in got[-50:]:
        sub = full[r["ov"] :: over, r["ou"] :: over]
        assert np.isclose(complex(r["re"], r["im"]), sub[r["sv"], r["su"]] / sub.real.sum())


def test_reproject_identity_and_shift(image_of):
    a = np.random.default_rng(3).normal(size=(8, 8))
    assert np.allclose(array_of(M.reproject(image_of(a), 8, lambda x, y: (x, y)), 8), a)
    got = array_of(M.reproject(image_of(a), 8, lambda x, y: (x + 0.5, y)), 8)
    want = (a + np.c_[a[:, 1:], np.zeros(8)]) / 2
    assert np.allclose(got, want)


def test_sky_round_trip(spark):
    system = {"ref": (0.3, 0.5), "at": (10.0, 12.0), "cd": [[-0.002, 0.0003], [0.0001, 0.002]]}
    df = spark.range(50).select((F.col("id") % 7).cast("double").alias("x"), (F.col("id") / 7.0).alias("y"))
    back = sky.world_to_pixel(*sky.pixel_to_world(F.col("x"), F.col("y"), **system), **system)
    for r in df.select("x", "y", back[0].alias("bx"), back[1].alias("by")).collect():
        assert math.isclose(r["x"], r["bx"], abs_tol=1e-9) and math.isclose(r["y"], r["by"], abs_tol=1e-9)


def vis_of(spark, rows):
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "vis_id long, u double, v double, w double, re double, im double")


def test_gridding_and_degridding_are_adjoint(spark):
    """<grid(v), g> = <v, degrid(g)> with the bilinear pairing."""
    rng = np.random.default_rng(4)
    vis = vis_of(spark, np.c_[rng.uniform(-6, 6, (30, 2)), rng.normal(size=(30, 3))])
    gcf = T.convolution_table(spark)
    pts = G.in_bounds(G.pregrid(vis, 32, 8), 32, 8)
    g = rng.normal(size=(2, 32, 32))
    image = spark.createDataFrame([(y, x, float(g[0, y, x]), float(g[1, y, x])) for y in range(32) for x in range(32)], "y int, x int, gre double, gim double")
    left = sum(complex(r["gre"], r["gim"]) * complex(*g[:, r["y"], r["x"]]) for r in G.grid(pts, gcf, 8).collect())
    seen = {r["vis_id"]: complex(r["re"], r["im"]) for r in G.degrid(pts, image, gcf, predict=True).collect()}
    right = sum(complex(r["re"], r["im"]) * seen[r["vis_id"]] for r in pts.collect())
    assert np.isclose(left, right)


def test_gridding_conformance(spark):
    """One point with a support of one cell and one with three by three; every other cell is empty."""
    one = spark.createDataFrame([("a", 5, 6, 0, 0, 1.0, 2.0)], "pol string, x int, y int, ou int, ov int, re double, im double")
    gcf1 = spark.createDataFrame([(0, 0, 0, 0, 1.0, 1.0)], "ou int, ov int, su int, sv int, gr double, gi double")
    gcf3 = spark.createDataFrame([(0, 0, i, j, 1.0, 1.0) for i in range(3) for j in range(3)], "ou int, ov int, su int, sv int, gr double, gi double")
    assert [tuple(r) for r in G.grid_simple(one, gcf1).collect()] == [("a", 5, 6, 1.0, 2.0)]
    two = one.withColumns({"x": F.lit(11), "y": F.lit(12)})
    assert {(r["x"], r["y"]) for r in G.grid_simple(two, gcf3).collect()} == {(x, y) for x in (11, 12, 13) for y in (12, 13, 14)}
    assert G.grid(two.filter("false"), gcf3, 3).count() == 0


def test_readers_and_dumps(spark, tmp_path):
    a = np.arange(50.0).reshape(10, 5)
    a.astype("<f8").tofile(tmp_path / "vis.dat")
    assert sorted(tuple(r) for r in T.read_quintuples(spark, str(tmp_path / "vis.dat")).collect()) == sorted(map(tuple, a.tolist()))
    assert [tuple(r) for r in T.read_vector(spark, str(tmp_path / "vis.dat"), 7, 3).orderBy("i").collect()] == [(7, 7.0), (8, 8.0), (9, 9.0)]
    image = spark.createDataFrame(rows_of(np.eye(2)), M.IMAGE)
    assert [tuple(r) for r in T.text_rows(image).orderBy("y").collect()] == [(0, "1.0 0.0"), (1, "0.0 1.0")]
    with pytest.raises(ValueError):
        T.select_visibilities(image, 5, 400, 16, 200)


def test_transforms_take_all_visibilities(spark):
    sf = "/root/testdata/sf0.001"
    pts = I.points(spark, sf, scale=I.WHOLE)
    assert pts.count() == T.visibilities(spark, sf).count()
    grid = cut(G.grid(pts, T.convolution_table(spark), I.SIZE), "grid")
    re, im = (array_of(grid, I.GRID, c) for c in ("gre", "gim"))
    want = np.fft.fftshift(np.fft.fft2(np.fft.ifftshift(re))) / I.GRID
    assert np.allclose(array_of(M.fft2(grid.select("y", "x", F.col("gre").alias("val")), I.GRID), I.GRID, "gre"), want.real)
    assert np.allclose(array_of(I.m4_forward_fft_all(spark, sf), I.GRID, "gre"), want.real, rtol=0, atol=6e-4)  # the query rounds to three places
    z = re + 1j * im
    herm = (z + np.conj(z[::-1, ::-1])) / 2
    want = (np.fft.fftshift(np.fft.ifft2(np.fft.ifftshift(herm))) * I.GRID).real
    assert np.allclose(array_of(M.ifft2(grid, I.GRID), I.GRID), want)
    assert np.allclose(array_of(I.m5_inverse_fft_all(spark, sf), I.GRID), want, rtol=0, atol=6e-4)
    assert 0 < I.m15_clean(spark, sf).count() <= 12

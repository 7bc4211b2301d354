"""Weighted resampling and CLEAN in tiles, against plain loops and one cycle after the other."""

import math

import numpy as np
import pytest

from skyloom.operators import images, tiled_clean
from skyloom.operators.resampling import System, regrid


def turned(s: System):
    (ra, dec) = s.ref
    z = np.array([[math.cos(ra), -math.sin(ra), 0], [math.sin(ra), math.cos(ra), 0], [0, 0, 1]])
    y = np.array([[math.cos(dec), 0, -math.sin(dec)], [0, 1, 0], [math.sin(dec), 0, math.cos(dec)]])
    return z @ y


def world(x, y, s):
    along, lat = np.array(s.cd) @ np.array([x - s.at[0], y - s.at[1]])
    lon = along / math.cos(lat)
    return turned(s) @ np.array([math.cos(lon) * math.cos(lat), math.sin(lon) * math.cos(lat), math.sin(lat)]), abs(lon) > math.pi or abs(lat) > math.pi / 2


def pixel(d, s):
    x, y, z = turned(s).T @ d
    lat = math.asin(max(-1, min(1, z)))
    return np.linalg.inv(np.array(s.cd)) @ np.array([math.atan2(y, x) * math.cos(lat), lat]) + np.array(s.at)


def brute(image, source, target, width, height):
    h, w = image.shape
    out = np.zeros((height, width))
    for j in range(height):
        for i in range(width):
            corners = [world(i + a, j + b, target) for a in (-1, 1) for b in (-1, 1)]
            if any(c[1] for c in corners):
                continue
            at = np.array([pixel(c[0], source) for c in corners])
            n = min(10, (int(max(np.floor(at.max(0)) - np.floor(at.min(0)))) // 2 + 1) * 4)
            total = weight = 0.0
            for k in range(1, n):
                for m in range(1, n):
                    tent = [2 * f if f <= 0.5 else 2 - 2 * f for f in (k / n, m / n)]
                    x, y = pixel(world(i - 1 + k / n * 2, j - 1 + m / n * 2, target)[0], source)
                    fx, fy = math.floor(x), math.floor(y)
                    if 0 <= fx < w - 1 and 0 <= fy < h - 1:
                        a, b = x - fx, y - fy
                        part = image[fy, fx] * (1 - a) * (1 - b) + image[fy, fx + 1] * a * (1 - b) + image[fy + 1, fx] * (1 - a) * b + image[fy + 1, fx + 1] * a * b
                        total, weight = total + part * tent[0] * tent[1], weight + tent[0] * tent[1]
            out[j, i] = total / weight if weight else 0
    return out


def rows(spark, image):
    return spark.createDataFrame([(int(y), int(x), float(image[y, x])) for y, x in np.ndindex(image.shape)], images.IMAGE)


@pytest.mark.parametrize("scale", [0.4, 1.1, 3.0, 60.0])
def test_regrid_equals_a_loop(spark, scale):
    """From many output pixels an input pixel to pixels that pass the pole."""
    image = np.random.default_rng(1).normal(size=(14, 17))
    source = System((1.0, 0.4), (8.0, 7.0), [[-0.01, 0.001], [0.002, 0.012]])
    target = System((1.01, 0.41), (6.0, 5.0), [[-0.01 * scale, 0.0], [0.0, 0.01 * scale]])
    got = np.full((11, 13), np.nan)
    for r in regrid(rows(spark, image), source, target, 17, 14, 13, 11).collect():
        got[r.y, r.x] = r.val
    assert np.allclose(got, brute(image, source, target, 13, 11), atol=1e-9)


@pytest.mark.parametrize("every", [2, 32])
def test_tiles_clean_alike(spark, every):
    """The same components and the same residual, bit by bit, over an image whose side isn't whole tiles."""
    rng = np.random.default_rng(3)
    n = 21
    y, x = np.indices((n, n))
    psf = 2.0 / (1 + ((y - 9) ** 2 + (x - 11) ** 2) / 3.0) * np.cos((y - 9) * 0.9)
    image = rng.normal(size=(n, n)) + sum(9 * np.exp(-((y - a) ** 2 + (x - b) ** 2) / 4) for a, b in ((3, 4), (15, 16), (4, 17)))
    model, left = images.clean(rows(spark, image), rows(spark, psf), 0.2, 1.5, 25)
    found, residual = tiled_clean.clean(rows(spark, image), rows(spark, psf), n, 0.2, 1.5, 25, tile=8, every=every)
    steps = found.orderBy("cycle").collect()
    assert [r.cycle for r in steps] == list(range(len(steps))) and 5 < len(steps) <= 25
    assert {(r.y, r.x) for r in steps} == {(r.y, r.x) for r in model.collect()}
    assert sorted(map(tuple, residual.collect())) == sorted(map(tuple, left.collect()))


def test_nothing_to_clean(spark):
    flat = np.zeros((5, 5))
    psf = flat.copy()
    psf[2, 2] = 1
    found, residual = tiled_clean.clean(rows(spark, flat), rows(spark, psf), 5, 0.1, 0.5, tile=4)
    assert found.count() == 0 and residual.count() == 25

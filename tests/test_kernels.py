"""Kernels as rows, against arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import kernels as K


def rows(spark, a):
    return spark.createDataFrame([(int(y), int(x), float(a[y, x].real), float(a[y, x].imag)) for y, x in np.ndindex(a.shape)], "y int, x int, re double, im double")


def array(df, n):
    out = np.zeros((n, n), complex)
    for r in df.collect():
        assert out[r.y, r.x] == 0
        out[r.y, r.x] = complex(r.re, r.im)
    return out


def test_quarter_to_whole_to_support_and_offsets(spark):
    half, over = 5, 4
    rng = np.random.default_rng(1)
    quarter = rng.normal(size=(half + 1, half + 1)) + 1j * rng.normal(size=(half + 1, half + 1))
    away = np.abs(np.arange(-half, half + 1))
    whole = quarter[np.ix_(away, away)]
    made = K.mirrored(rows(spark, quarter), half)
    assert (array(made, 2 * half + 1) == whole).all()
    assert (array(K.extracted(made, half, 2), 5) == whole[3:8, 3:8]).all()
    size = (2 * half + 1) * over
    big = np.zeros((size, size), complex)
    big[size // 2 - half : size // 2 + half + 1, size // 2 - half : size // 2 + half + 1] = whole
    dealt = K.by_offset(K.oversampled(made, half, over), over).collect()
    assert len(dealt) == whole.size
    assert all(big[r.y * over + r.ov, r.x * over + r.ou] == complex(r.re, r.im) for r in dealt)


@pytest.mark.parametrize("bound", [K.BROADCAST_ROWS, 10])
def test_ragged_grid(spark, monkeypatch, bound):
    """Kernels of several widths, hot cells, supports over the edge; broadcast or joined."""
    monkeypatch.setattr(K, "BROADCAST_ROWS", bound)
    rng = np.random.default_rng(2)
    n, size = 400, 12
    bl, u, v = rng.integers(0, 3, n), rng.uniform(-1.5, size + 1, n), rng.uniform(0, size, n)
    u[:200], v[:200], bl[:200] = 5.5, 6.5, 1
    vis = [(int(b), float(x), float(y), float(r), float(i), int(p)) for b, x, y, r, i, p in zip(bl, u, v, rng.integers(-4, 5, n), rng.integers(-4, 5, n), rng.integers(0, 2, n))]
    half = {0: 0, 1: 3, 2: 1}
    weight = {b: rng.integers(-3, 4, (2 * h + 1, 2 * h + 1, 2)) for b, h in half.items()}
    table = [(b, h, du, dv, float(weight[b][du + h, dv + h, 0]), float(weight[b][du + h, dv + h, 1])) for b, h in half.items() for du in range(-h, h + 1) for dv in range(-h, h + 1)]
    want = np.zeros((2, size, size, 2))
    for b, x, y, r, i, p in vis:
        h = half[b]
        for du in range(-h, h + 1):
            for dv in range(-h, h + 1):
                cx, cy = int(x) + du, int(y) + dv
                if 0 <= cx < size and 0 <= cy < size:
                    want[p, cx, cy] += (r * weight[b][du + h, dv + h, 0], i * weight[b][du + h, dv + h, 1])
    got = np.zeros_like(want)
    out = K.ragged_grid(spark.createDataFrame(vis, "bl int, u double, v double, re double, im double, pol int"), spark.createDataFrame(table, "bl int, half int, du int, dv int, wre double, wim double"), size, "pol")
    for row in out.withColumn("k", F.lit(1)).collect():
        got[row.pol, row.x, row.y] = (row.gre, row.gim)
    assert (got == want).all()

"""Spherical coordinates and facet geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Matrix = list[list[float]]


def rot_x(a: float) -> Matrix:
    return [[1.0, 0.0, 0.0], [0.0, math.cos(a), -math.sin(a)], [0.0, math.sin(a), math.cos(a)]]


def rot_y(a: float) -> Matrix:
    return [[math.cos(a), 0.0, math.sin(a)], [0.0, 1.0, 0.0], [-math.sin(a), 0.0, math.cos(a)]]


def rot_z(a: float) -> Matrix:
    return [[math.cos(a), -math.sin(a), 0.0], [math.sin(a), math.cos(a), 0.0], [0.0, 0.0, 1.0]]


def matmul(a: Matrix, b: Matrix) -> Matrix:
    return [[sum(x * y for x, y in zip(row, col)) for col in zip(*b)] for row in a]


def apply_matrix(m: Matrix, v: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    return tuple(F.lit(r[0]) * v[0] + F.lit(r[1]) * v[1] + F.lit(r[2]) * v[2] for r in m)


def facet_shift(lon: float, lat: float) -> tuple[float, float, float]:
    """z minus R z for the rotation R that takes the phase centre to a facet's centre."""
    r = matmul(rot_y(-lon), rot_x(lat))
    return -r[0][2], -r[1][2], 1.0 - r[2][2]


def pixel_to_world(x: Column, y: Column, ref: tuple[float, float], at: tuple[float, float], cd: Matrix) -> tuple[Column, Column]:
    """Sky position of a pixel in a tangent-plane system with reference value, reference pixel and 2x2 scale matrix."""
    dx, dy = x - F.lit(at[0]), y - F.lit(at[1])
    xi, eta = F.lit(cd[0][0]) * dx + F.lit(cd[0][1]) * dy, F.lit(cd[1][0]) * dx + F.lit(cd[1][1]) * dy
    sin0, cos0 = math.sin(ref[1]), math.cos(ref[1])
    down = F.lit(cos0) - eta * F.lit(sin0)
    lon = F.lit(ref[0]) + F.atan2(xi, down)
    lat = F.atan2(F.lit(sin0) + eta * F.lit(cos0), F.sqrt(xi * xi + down * down))
    return lon, lat


def world_to_pixel(lon: Column, lat: Column, ref: tuple[float, float], at: tuple[float, float], cd: Matrix) -> tuple[Column, Column]:
    """Pixel of a sky position; the inverse of pixel_to_world."""
    dl = lon - F.lit(ref[0])
    sin0, cos0 = math.sin(ref[1]), math.cos(ref[1])
    depth = F.sin(lat) * F.lit(sin0) + F.cos(lat) * F.lit(cos0) * F.cos(dl)
    xi = F.cos(lat) * F.sin(dl) / depth
    eta = (F.sin(lat) * F.lit(cos0) - F.cos(lat) * F.lit(sin0) * F.cos(dl)) / depth
    det = cd[0][0] * cd[1][1] - cd[0][1] * cd[1][0]
    x = F.lit(at[0]) + (F.lit(cd[1][1] / det) * xi - F.lit(cd[0][1] / det) * eta)
    y = F.lit(at[1]) + (F.lit(cd[0][0] / det) * eta - F.lit(cd[1][0] / det) * xi)
    return x, y


def inverse(m: Matrix) -> Matrix:
    """Inverse of a 2x2 matrix."""
    (a, b), (c, d) = m
    det = a * d - b * c
    return [[d / det, -b / det], [-c / det, a / det]]


def to_world(ref: tuple[float, float]) -> Matrix:
    """Rotation that takes the x axis to the direction of right ascension and declination ref."""
    return matmul(rot_z(ref[0]), rot_y(-ref[1]))


def rotated_uvw(lon: float, lat: float, uvw: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Coordinates of a baseline seen from another phase centre."""
    return apply_matrix(matmul(rot_x(-lat), rot_y(lon)), uvw)

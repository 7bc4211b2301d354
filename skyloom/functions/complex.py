"""Complex numbers as two columns, and the rounding rules that gridding depends on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]


def cmul(a: Pair, b: Pair) -> Pair:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def conj(a: Pair) -> Pair:
    return a[0], -a[1]


def magnitude(a: Pair) -> Column:
    return F.sqrt(a[0] * a[0] + a[1] * a[1])


def turned(a: Pair, angle: Column) -> Pair:
    """a times exp(i angle)."""
    return cmul(a, (F.cos(angle), F.sin(angle)))


def nearest(x: Column, rule: str = "rint") -> Column:
    """Whole number near x: rint (ties to even), half_away, or floor."""
    return {"rint": F.rint, "half_away": F.round, "floor": F.floor}[rule](x).cast("int")

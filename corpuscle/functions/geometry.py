"""Distances, angles and torsions as column expressions over points (x, y, z)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column, Column]


def point(prefix: str = "", struct: str | None = None) -> Point:
    """The columns <prefix>x, <prefix>y, <prefix>z, or the fields of a struct column."""
    return tuple(F.col(struct)[c] if struct else F.col(f"{prefix}{c}") for c in "xyz")


def minus(a: Point, b: Point) -> Point:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def dot(a: Point, b: Point) -> Column:
    x, y, z = (p * q for p, q in zip(a, b, strict=True))
    return x + y + z


def cross(a: Point, b: Point) -> Point:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def distance2(a: Point, b: Point) -> Column:
    d = minus(a, b)
    return dot(d, d)


def distance(a: Point, b: Point) -> Column:
    return F.sqrt(distance2(a, b))


def angle(a: Point, b: Point, c: Point) -> Column:
    """Degrees at b; 0 where an arm is shorter than 1e-10."""
    u, v = minus(a, b), minus(c, b)
    cos = dot(u, v) / (norm(u) * norm(v))
    return F.when((norm(u) < 1e-10) | (norm(v) < 1e-10), F.lit(0.0)).otherwise(F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))


def torsion(a: Point, b: Point, c: Point, d: Point) -> Column:
    """Degrees; the sign is that of y = (n1 x b2) . n2."""
    b1, b2, b3 = minus(b, a), minus(c, b), minus(d, c)
    n1, n2 = cross(b1, b2), cross(b2, b3)
    size = norm(b2) + F.lit(1e-15)
    m1 = cross(n1, tuple(p / size for p in b2))
    return F.degrees(F.atan2(dot(m1, n2), dot(n1, n2)))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once, which keeps nested vector expressions from multiplying."""
    return F.element_at(F.transform(F.array(value), then), 1)

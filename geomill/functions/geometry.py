"""Column expressions of plane and space geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", suffix: str = "") -> Vec:
    return tuple(F.col(f"{prefix}{c}{suffix}") for c in "xyz")


def minus(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b))


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def normalised_angle(a: Column) -> Column:
    """Radians brought into [-pi, pi)."""
    from math import pi

    return a - F.floor((a + pi) / (2 * pi)) * (2 * pi)


def point_line2(p: Vec, origin: Vec, direction: Vec) -> Column:
    """Squared distance of a point from a line."""
    c = cross(direction, minus(p, origin))
    return dot(c, c) / dot(direction, direction)


def line_line(p: Vec, d: Vec, q: Vec, e: Vec) -> tuple[Vec, Column]:
    """Point of the first line nearest to the second, and their squared distance; null for parallel lines."""
    w = minus(p, q)
    a, b, c = dot(d, d), dot(d, e), dot(e, e)
    den = a * c - b * b
    s = F.when(den > 1e-12, (b * dot(e, w) - c * dot(d, w)) / den)
    t = F.when(den > 1e-12, (a * dot(e, w) - b * dot(d, w)) / den)
    near = tuple(x + s * y for x, y in zip(p, d))
    other = tuple(x + t * y for x, y in zip(q, e))
    gap = minus(near, other)
    return near, dot(gap, gap)


def plane_line(p: Vec, d: Vec, normal: Vec, offset: Column) -> Column:
    """Parameter at which a line meets normal . x + offset = 0; null if parallel."""
    den = dot(normal, d)
    return F.when(F.abs(den) > 1e-12, -(dot(normal, p) + offset) / den)


def point_triangle2(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Squared distance of a point from a triangle: from the plane where the foot is inside, else from the nearest side."""

    def side(u: Vec, v: Vec) -> Column:
        d, w = minus(v, u), minus(p, u)
        t = F.least(F.greatest(dot(w, d) / dot(d, d), F.lit(0.0)), F.lit(1.0))
        g = tuple(x - t * y for x, y in zip(w, d))
        return dot(g, g)

    n = cross(minus(b, a), minus(c, a))
    inside = None
    for u, v in ((a, b), (b, c), (c, a)):
        ok = dot(cross(minus(v, u), minus(p, u)), n) >= 0
        inside = ok if inside is None else inside & ok
    h = dot(minus(p, a), n)
    return F.when(inside & (dot(n, n) > 0), h * h / dot(n, n)).otherwise(F.least(side(a, b), side(b, c), side(c, a)))


def quaternion_rotated(q: tuple[Column, Column, Column, Column], p: Vec) -> Vec:
    """p turned by the unit quaternion (w, x, y, z)."""
    w, u = q[0], q[1:]
    t = tuple(2 * v for v in cross(u, p))
    s = cross(u, t)
    return tuple(a + w * b + c for a, b, c in zip(p, t, s))


def euler_rotated(angles: tuple[Column, Column, Column], p: Vec) -> Vec:
    """p turned about x, then y, then z by the angles (radians)."""
    x, y, z = p
    a, b, c = ((F.cos(v), F.sin(v)) for v in angles)
    y, z = y * a[0] - z * a[1], y * a[1] + z * a[0]
    x, z = x * b[0] + z * b[1], z * b[0] - x * b[1]
    return (x * c[0] - y * c[1], x * c[1] + y * c[0], z)


def euler_angles(q: tuple[Column, Column, Column, Column]) -> Vec:
    """Angles about x, y and z, in that order of turning, of the unit quaternion (w, x, y, z)."""
    w, x, y, z = q
    side = F.least(F.greatest(2 * (w * y - z * x), F.lit(-1.0)), F.lit(1.0))
    return (F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y)), F.asin(side), F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z)))


def barycentre(*corners: Vec) -> Vec:
    return tuple(sum(c[i] for c in corners) / len(corners) for i in range(3))

"""Predicates and projections on clouds and voxels, as Column expressions that reach the scan."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def finite(*columns: str) -> Column:
    """Neither null, NaN nor infinite."""
    return reduce(and_, (F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) != float("inf")) for c in columns))


def pass_through(points: DataFrame, field: str, low: float, high: float, negative: bool = False) -> DataFrame:
    """Finite points with low <= field <= high; negative keeps those strictly outside. An unknown field keeps nothing."""
    if field not in points.columns:
        return points.limit(0)
    inside = F.col(field).between(low, high)
    return points.filter(finite(*AXES, field) & (~inside if negative else inside))


COMPARE = {"GT": lambda a, b: a > b, "GE": lambda a, b: a >= b, "LT": lambda a, b: a < b, "LE": lambda a, b: a <= b, "EQ": lambda a, b: a == b}


def condition(tree: tuple) -> Column:
    """Column of ("and" | "or", tree, ...) or (field, comparison, value)."""
    if tree[0] in ("and", "or"):
        return reduce(and_ if tree[0] == "and" else or_, map(condition, tree[1:]))
    field, op, value = tree
    return COMPARE[op](F.col(field), F.lit(value))


def transformed(points: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """Affine transform by a 3 x 4 matrix."""
    return points.withColumns({c: sum(F.col(a) * float(m) for a, m in zip(AXES, row[:3])) + float(row[3]) for c, row in zip(AXES, matrix)})


def crop_box(points: DataFrame, low: tuple, high: tuple, rotation: list[list[float]] | None = None, shift: tuple = (0, 0, 0), negative: bool = False) -> DataFrame:
    """Points inside an oriented box, bounds inclusive; negative keeps the finite points outside.

    A point is moved by -shift and turned by the inverse of `rotation` before it meets the bounds.
    """
    r = rotation or [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    moved = [F.col(c) - float(s) for c, s in zip(AXES, shift)]
    local = [sum(moved[j] * float(r[j][i]) for j in range(3)) for i in range(3)]
    inside = reduce(and_, (v.between(float(a), float(b)) for v, a, b in zip(local, low, high)))
    return points.filter(finite(*AXES) & (~inside if negative else inside))


def half_spaces(points: DataFrame, planes: list[tuple[float, float, float, float]], negative: bool = False) -> DataFrame:
    """Points with a x + b y + c z + d <= 0 for every plane: frustum, clipping plane or convex hull. Negative keeps the others, NaN among them."""
    inside = reduce(and_, ((sum(F.col(c) * float(v) for c, v in zip(AXES, p)) + float(p[3])) <= 0 for p in planes))
    inside = F.coalesce(inside, F.lit(False)) & finite(*AXES)
    return points.filter(~inside if negative else inside)


def in_polygon(points: DataFrame, polygon: list[tuple[float, float]], outside: bool = False) -> DataFrame:
    """Points whose (x, y) is inside the polygon by ray parity; `outside` keeps the others."""
    crossings = []
    for (ax, ay), (bx, by) in zip(polygon, polygon[1:] + polygon[:1]):
        if ay != by:
            spans = (F.col("y") < max(ay, by)) & (F.col("y") >= min(ay, by))
            at = F.lit(float(ax)) + (F.col("y") - float(ay)) * (float(bx - ax) / float(by - ay))
            crossings.append((spans & (F.col("x") < at)).cast("int"))
    inside = sum(crossings) % 2 == 1
    return points.filter(~inside if outside else inside)


def take_indices(points: DataFrame, indices: DataFrame, negative: bool = False, point_id: str = "point_id") -> DataFrame:
    """Positive: the listed points with the list's `ordinal`, duplicates kept. Negative: the points not listed."""
    if negative:
        return points.join(indices.select(point_id), point_id, "left_anti")
    return points.join(indices.select("ordinal", point_id), point_id)


def change_packed_rgb(points: DataFrame, rgb: str = "rgb") -> DataFrame:
    """r, g and b of a colour packed as b << 16 | g << 8 | r, with hue in degrees, saturation and intensity."""
    packed = F.col(rgb).cast("long")
    r, g, b = (F.shiftright(packed, n).bitwiseAND(F.lit(255).cast("long")) for n in (0, 8, 16))
    out = points.withColumns({"r": r, "g": g, "b": b})
    total = F.col("r") + F.col("g") + F.col("b")
    alpha, beta = 2 * F.col("r") - F.col("g") - F.col("b"), (F.col("g") - F.col("b")) * 3**0.5
    hue = F.degrees(F.atan2(beta, alpha.cast("double")))
    return out.withColumns({"hue": F.when(hue < 0, hue + 360).otherwise(hue), "saturation": F.when(total > 0, 1 - 3 * F.least("r", "g", "b") / total).otherwise(0.0), "intensity": total / 3})


def subsample(points: DataFrame, n: int, seed: int = 0, point_id: str = "point_id") -> DataFrame:
    """n points by the order of a hash of id and seed: the same ones on any cluster. n or fewer points stay whole."""
    return points.orderBy(F.xxhash64(point_id, F.lit(seed)), point_id).limit(n)


def adjacent_dedupe(points: DataFrame, tolerance: float = 1e-5, point_id: str = "point_id", slab: float = 64.0) -> DataFrame:
    """Drop each point that differs by at most the tolerance per axis from its predecessor in (x, y, z, id) order.

    The order is cut into slabs of x that know the last point before them, so no task sees all points. Points
    without a finite place stay.
    """
    s = points.filter(finite(*AXES)).withColumn("_slab", F.floor(F.col("x") / slab))
    key = F.struct(*AXES, point_id)
    ends = s.groupBy("_slab").agg(F.max(key).alias("end"))
    # One row for each slab: the previous slab's last point.
    before = ends.withColumn("carry", F.lag("end").over(Window.orderBy("_slab"))).select("_slab", "carry")
    w = Window.partitionBy("_slab").orderBy(*AXES, point_id)
    prev = F.coalesce(F.lag(key).over(w), F.col("carry"))
    marked = s.join(before, "_slab").withColumn("_prev", prev)
    same = reduce(and_, (F.abs(F.col(c) - F.col(f"_prev.{c}")) <= tolerance for c in AXES))
    return marked.filter(~F.coalesce(same, F.lit(False))).select(points.columns).unionByName(points.filter(~finite(*AXES)))


def tiles_cut_by_plane(tiles: DataFrame, normal: tuple, offset: float, lows: tuple = ("x0", "y0", "z0"), highs: tuple = ("x1", "y1", "z1")) -> DataFrame:
    """Tiles with corners strictly on both sides of n . p + offset = 0."""
    least = sum(F.least(F.col(a) * float(n), F.col(b) * float(n)) for a, b, n in zip(lows, highs, normal)) + float(offset)
    most = sum(F.greatest(F.col(a) * float(n), F.col(b) * float(n)) for a, b, n in zip(lows, highs, normal)) + float(offset)
    return tiles.filter((least < 0) & (most > 0))

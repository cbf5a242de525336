"""Iso-surfaces of voxel volumes: cell classification, edge crossings, signed distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
#: Corners of a cell in the order of the case index's bits.
CORNERS = ((0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1))


def cases(volume: DataFrame, iso: int) -> DataFrame:
    """(x, y, z, case_idx) of full cells the surface passes: bit i is set if corner i has gray < iso.

    Each voxel is sent to the cells it is a corner of, and one group-by collects the bits.
    """
    to = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(c, "ijk")), F.lit(1 << b).alias("bit")) for b, c in enumerate(CORNERS)))
    sent = volume.select(*AXES, (F.col("gray") < iso).cast("int").alias("low"), F.inline(to)).select(*((F.col(c) - F.col(o)).alias(c) for c, o in zip(AXES, "ijk")), (F.col("low") * F.col("bit")).alias("bits"))
    return sent.groupBy(*AXES).agg(F.sum("bits").alias("case_idx"), F.count(F.lit(1)).alias("k")).filter("k = 8 AND case_idx NOT IN (0, 255)").drop("k")


def _quadratic(iso: int) -> Column:
    """Place between a and b, 0 to 1, of the root of the parabola through both whose slopes there are nearest to the central differences of the four samples before, a, b, after."""
    before, a, b, after = (F.col(c).cast("double") - iso for c in ("before", "a", "b", "after"))
    at_a, at_b = (b - before) / 2, (after - a) / 2
    bend = (at_b - at_a) / 2
    slope = b - a - bend
    p, q = slope / bend, a / bend
    root = F.sqrt(F.greatest(p * p - 4 * q, F.lit(0.0)))
    low, high = (-p - root) / 2, (-p + root) / 2
    return F.when(bend == 0, -a / slope).when(high > 1, low).otherwise(high)


def crossings(volume: DataFrame, iso: int, quadratic: bool = False) -> DataFrame:
    """(axis, x, y, z, px, py, pz): vertex of the surface on each grid edge whose ends lie on different sides; an edge is named by its axis and lower voxel, so no vertex is made twice.

    Its place is found by linear interpolation, or with `quadratic` from the edge's four samples in a row; at the volume's rim, where one is missing, it stays linear.
    """
    # Each voxel has these roles for edges on each axis, so many steps below it.
    roles = {"a": 0, "b": 1, "before": -1, "after": 2} if quadratic else {"a": 0, "b": 1}
    ends = F.array(*(F.struct(F.lit(c).alias("axis"), *(F.lit(step if c == a else 0).alias(f"o{a}") for a in AXES), F.lit(role).alias("role")) for c in AXES for role, step in roles.items()))
    sent = volume.select(*AXES, "gray", F.inline(ends)).select("axis", *((F.col(c) - F.col(f"o{c}")).alias(c) for c in AXES), "role", "gray")
    e = sent.groupBy("axis", *AXES).agg(*(F.max(F.when(F.col("role") == r, F.col("gray"))).alias(r) for r in roles)).filter("a is not null and b is not null").filter((F.col("a") < iso) != (F.col("b") < iso))
    t = (F.lit(iso) - F.col("a")) / (F.col("b") - F.col("a"))
    if quadratic:
        t = F.when(F.col("before").isNull() | F.col("after").isNull(), t).otherwise(_quadratic(iso))
    return e.select("axis", *AXES, *((F.col(c) + F.when(F.col("axis") == c, t).otherwise(0.0)).alias(f"p{c}") for c in AXES))


def cell_triangles(volume: DataFrame, iso: int) -> DataFrame:
    """(x, y, z, tri, corner, axis, ex, ey, ez): triangles of each cell, corners named by their grid edges.

    A cell is split into six tetrahedra around its main diagonal; a tetrahedron has one
    triangle if one corner is alone, two if the sides are even. The tables follow from that
    rule, and neighbouring cells agree on shared faces, so the surface is closed.
    """
    spark = volume.sparkSession
    table = [(case, n, k, *edge) for case in range(1, 255) for n, tri in enumerate(_case(case)) for k, edge in enumerate(tri)]
    lookup = spark.createDataFrame(table, "case_idx int, tri int, corner int, ax int, ay int, az int, bx int, by int, bz int")
    return cases(volume, iso).join(F.broadcast(lookup), "case_idx").select(*AXES, "tri", "corner", *((F.col(c) + F.col(f"a{c}")).alias(f"a{c}") for c in AXES), *((F.col(c) + F.col(f"b{c}")).alias(f"b{c}") for c in AXES))


def _case(case: int) -> list[list[tuple]]:
    """Triangles of a case as triples of edges (corner a, corner b), a inside (gray < iso)."""
    out = []
    around = (1, 2, 3, 7, 4, 5)
    for a, b in zip(around, around[1:] + around[:1]):
        tet = (0, a, b, 6)
        low = [c for c in tet if case >> c & 1]
        high = [c for c in tet if not case >> c & 1]
        edge = lambda i, j: CORNERS[i] + CORNERS[j]
        if len(low) == 1:
            out.append([edge(low[0], h) for h in high])
        elif len(high) == 1:
            out.append([edge(v, high[0]) for v in low])
        elif len(low) == 2:
            p, q = low
            r, s = high
            out.append([edge(p, r), edge(p, s), edge(q, s)])
            out.append([edge(p, r), edge(q, s), edge(q, r)])
    return out


def signed_distance(vertices: DataFrame, samples: DataFrame, iso: int, sample_id: str = "query_id") -> DataFrame:
    """(sample, distance): mean distance of the three nearest surface points, negative where the sample's gray is over iso."""
    from geomill.operators.neighbors import knn

    near = knn(vertices, samples, 3, query_id=sample_id).groupBy(sample_id).agg(F.avg(F.sqrt("d2")).alias("d"))
    return near.join(samples.select(sample_id, "gray"), sample_id).select(sample_id, F.when(F.col("gray") > iso, -F.col("d")).otherwise(F.col("d")).alias("distance"))

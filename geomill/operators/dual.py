"""Closed surfaces of labelled volumes: one vertex for each patch of a cell, one quad for each grid edge between two labels.

A cell has eight voxels as corners. For each label among them its corners of that label and
the rest are told apart, and its edges between both fall into patches: on a face with two such
edges they belong together, on one with four those around each corner of the label do. A patch has a
vertex, the mean of its edges' middles. An edge between voxels belongs to four cells; their vertices
are the quad's corners, so the quads of a label close around it, and each names the label on its
other side: where two labels meet, both have the quad, turned to either side.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
CORNERS = tuple((i, j, k) for k in (0, 1) for j in (0, 1) for i in (0, 1))
#: Edges of a cell: the axis and the lower end.
EDGES = tuple((a, c) for a in range(3) for c in CORNERS if c[a] == 0)


def _upper(edge: tuple) -> tuple:
    a, c = edge
    return tuple(v + (i == a) for i, v in enumerate(c))


def patches(case: int) -> list[list[int]]:
    """Edges of each patch of a cell; bit i of the case is set if corner i has the label."""
    inside = {c for i, c in enumerate(CORNERS) if case >> i & 1}
    cut = [e for e, edge in enumerate(EDGES) if (edge[1] in inside) != (_upper(edge) in inside)]
    root = {e: e for e in cut}

    def find(e: int) -> int:
        while root[e] != e:
            e = root[e]
        return e

    for axis, side in product(range(3), (0, 1)):
        on = [e for e in cut if EDGES[e][0] != axis and EDGES[e][1][axis] == side]
        groups = [on] if len(on) == 2 else [[e for e in on if c in (EDGES[e][1], _upper(EDGES[e]))] for c in inside if c[axis] == side] if on else []
        for group in groups:
            for e in group[1:]:
                root[find(e)] = find(group[0])
    return [[e for e in cut if find(e) == r] for r in sorted({find(e) for e in cut})]


def _table() -> list[tuple]:
    """(case, edge axis, its lower corner, whether that has the label, place around the edge, patch, vertex in the cell) for each edge of each patch."""
    out = []
    for case in range(1, 255):
        for n, patch in enumerate(patches(case)):
            middle = [sum(EDGES[e][1][i] + _upper(EDGES[e])[i] for e in patch) / (2 * len(patch)) for i in range(3)]
            for e in patch:
                axis, low = EDGES[e]
                lower = bool(case >> CORNERS.index(low) & 1)
                # Cells around an edge: where the edge lies in the cell, in the order of a turn about the axis.
                turn = ((1, 1), (0, 1), (0, 0), (1, 0)).index((low[(axis + 1) % 3], low[(axis + 2) % 3]))
                out.append((case, AXES[axis], *low, CORNERS.index(_upper((axis, low)) if lower else low), lower, turn, n, *middle))
    return out


def label_surfaces(volume: DataFrame, label: str = "label", outside: int = 0) -> DataFrame:
    """(label, other, axis, x, y, z, corners): quads around each label but `outside`, an edge named by its axis and lower voxel.

    `corners` are four structs (cx, cy, cz, patch, px, py, pz), counter-clockwise seen from
    outside the label; vertices are the same where (cx, cy, cz, patch) and the label are. Voxels that
    are missing, so also all around the volume, count as `outside`.
    """
    spark = volume.sparkSession
    to = F.array(*(F.struct(*(F.lit(v).alias(n) for v, n in zip(c, "ijk")), F.lit(i).alias("corner")) for i, c in enumerate(CORNERS)))
    sent = volume.select(*AXES, F.col(label).cast("int").alias("l"), F.inline(to)).select(*((F.col(c) - F.col(o)).alias(f"c{c}") for c, o in zip(AXES, "ijk")), "corner", "l")
    cell = [f"c{c}" for c in AXES]
    cells = sent.groupBy(*cell).agg(*(F.coalesce(F.max(F.when(F.col("corner") == i, F.col("l"))), F.lit(outside)).alias(f"l{i}") for i in range(8)))
    labels = F.array(*(F.col(f"l{i}") for i in range(8)))
    mixed = cells.select(*cell, labels.alias("labels")).withColumn("l", F.explode(F.array_distinct("labels"))).filter(F.col("l") != outside)
    bits = sum(((F.col("labels")[i] == F.col("l")).cast("int") * (1 << i) for i in range(1, 8)), (F.col("labels")[0] == F.col("l")).cast("int"))
    table = spark.createDataFrame(_table(), "case_idx int, axis string, ox int, oy int, oz int, far int, lower boolean, turn int, patch int, mx double, my double, mz double")
    ends = mixed.withColumn("case_idx", bits).join(F.broadcast(table), "case_idx")
    corner = F.struct(*cell, "patch", *((F.col(f"c{c}") + F.col(f"m{c}")).alias(f"p{c}") for c in AXES))
    key = ["l", "axis", *AXES]
    ends = ends.select("l", "axis", *((F.col(f"c{c}") + F.col(f"o{c}")).alias(c) for c in AXES), F.element_at("labels", F.col("far") + 1).alias("other"), "lower", "turn", corner.alias("corner"))
    quads = ends.groupBy(*key).agg(F.first("other").alias("other"), F.first("lower").alias("lower"), *(F.max(F.when(F.col("turn") == i, F.col("corner"))).alias(f"k{i}") for i in range(4)))
    ring = F.when(F.col("lower"), F.array("k0", "k1", "k2", "k3")).otherwise(F.array("k3", "k2", "k1", "k0"))
    return quads.select(F.col("l").alias(label), "other", "axis", *AXES, ring.alias("corners"))


def enclosed(quads: DataFrame, label: str = "label") -> DataFrame:
    """(label, volume): what each label's surface encloses, from the signed volumes over its quads' triangles."""

    def six(a: int, b: int, c: int):
        p, q, r = ([F.col("corners")[i][f"p{x}"] for x in AXES] for i in (a, b, c))
        return p[0] * (q[1] * r[2] - q[2] * r[1]) + p[1] * (q[2] * r[0] - q[0] * r[2]) + p[2] * (q[0] * r[1] - q[1] * r[0])

    return quads.groupBy(label).agg((F.sum(six(0, 1, 2) + six(0, 2, 3)) / 6).alias("volume"))

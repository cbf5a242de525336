"""Triangle meshes as vertex and face tables, with corners joined to faces once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def corners(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    out = faces
    for i in range(3):
        out = out.join(vertices.select(F.col("id").alias(f"v{i}"), *(F.col(c).alias(f"{c}{i}") for c in AXES)), f"v{i}")
    return out


def _cross(a: tuple, b: tuple) -> tuple:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def _dot(a: tuple, b: tuple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _at(i: int) -> tuple:
    return tuple(F.col(f"{c}{i}") for c in AXES)


def _minus(a: tuple, b: tuple) -> tuple:
    return tuple(x - y for x, y in zip(a, b))


def area2(tri: DataFrame) -> Column:
    """Twice the area of a face."""
    n = _cross(_minus(_at(1), _at(0)), _minus(_at(2), _at(0)))
    return F.sqrt(_dot(n, n))


def total_area(tri: DataFrame) -> DataFrame:
    return tri.agg((F.sum(area2(tri)) / 2).alias("area"), F.count(F.lit(1)).alias("faces"))


def face_normals(tri: DataFrame) -> DataFrame:
    n = _cross(_minus(_at(1), _at(0)), _minus(_at(2), _at(0)))
    length = F.sqrt(_dot(n, n))
    return tri.select("face_id", *(F.when(length > 0, v / length).alias(f"n{c}") for v, c in zip(n, AXES)))


def edges(faces: DataFrame) -> DataFrame:
    """(a, b): undirected edges, each once, a < b."""
    pairs = F.array(*(F.struct(F.least(f"v{i}", f"v{j}").alias("a"), F.greatest(f"v{i}", f"v{j}").alias("b")) for i, j in ((0, 1), (1, 2), (0, 2))))
    return faces.select(F.inline(pairs)).distinct()


def incidence(faces: DataFrame) -> DataFrame:
    """(id, faces, neighbours): number of faces and of neighbours of each vertex."""
    f = faces.select(F.explode(F.array("v0", "v1", "v2")).alias("id"), "face_id").groupBy("id").agg(F.count(F.lit(1)).alias("faces"))
    e = edges(faces)
    n = e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("neighbours"))
    return f.join(n, "id")


def smoothed(vertices: DataFrame, faces: DataFrame, value: str) -> DataFrame:
    """(id, value): mean of a vertex's and its neighbours' values."""
    e = edges(faces)
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(vertices.select(F.col("id").alias("b"), value), "b").groupBy(F.col("a").alias("id")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("n"))
    return vertices.join(near, "id", "left").select("id", ((F.col(value) + F.coalesce("s", F.lit(0.0))) / (F.coalesce("n", F.lit(0)) + 1)).alias(value))


def compacted(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices that a face uses, numbered anew from 0 in the order of their ids, and the faces with the new numbers.

    Numbers come from the counts of ranges of ids, so no task sorts all vertices.
    """
    from geomill.operators.numbering import numbered

    used = faces.select(F.explode(F.array("v0", "v1", "v2")).alias("id")).distinct()
    kept = numbered(vertices.join(used, "id", "left_semi"), "id", "new_id")
    out = faces
    for i in range(3):
        out = out.join(kept.select(F.col("id").alias(f"v{i}"), F.col("new_id").alias(f"n{i}")), f"v{i}")
    return kept, out.select("face_id", *(F.col(f"n{i}").alias(f"v{i}") for i in range(3)))


def plane_slice(tri: DataFrame, point: tuple, normal: tuple) -> DataFrame:
    """(face_id, ax, ay, az, bx, by, bz): segment where a face crosses the plane; a face is hit if 1 or 2 corners are strictly in front."""
    d = [sum((F.col(f"{c}{i}") - float(p)) * float(n) for c, p, n in zip(AXES, point, normal)) for i in range(3)]
    t = tri.withColumns({f"d{i}": d[i] for i in range(3)})
    front = sum((F.col(f"d{i}") > 0).cast("int") for i in range(3))
    hit = t.withColumn("front", front).filter("front between 1 and 2")
    # The corner that is alone on its side meets both others.
    alone = F.when((F.col("d0") > 0) == (F.col("front") == 1), F.when((F.col("d1") > 0) != (F.col("d0") > 0), F.when((F.col("d2") > 0) != (F.col("d0") > 0), 0).otherwise(1)).otherwise(2)).otherwise(F.when((F.col("d1") > 0) == (F.col("front") == 1), 1).otherwise(2))
    hit = hit.withColumn("k", alone)
    pick = lambda name, shift: F.element_at(F.array(*(F.col(f"{name}{i}") for i in range(3))), (F.col("k") + shift) % 3 + 1)
    out = [F.col("face_id")]
    for end, shift in (("a", 1), ("b", 2)):
        w = pick("d", 0) / (pick("d", 0) - pick("d", shift))
        out += [(pick(c, 0) + w * (pick(c, shift) - pick(c, 0))).alias(f"{end}{c}") for c in AXES]
    return hit.select(*out)


def ray_hits(tri: DataFrame, rays: DataFrame, cell: float, near: float = 0.0, far: float = float("inf"), face_id: str = "face_id") -> DataFrame:
    """(ray_id, face_id, t): the first face each ray meets, for rays along +z or -z (ox, oy, oz, dz).

    A face is sent to those (x, y) cells of its bounding box that a ray stands in: an
    equi-join whose candidates are the faces over the ray's cell. Moeller-Trumbore decides.
    """
    lo = lambda c: F.floor(F.least(*(F.col(f"{c}{i}") for i in range(3))) / cell)
    hi = lambda c: F.floor(F.greatest(*(F.col(f"{c}{i}") for i in range(3))) / cell)
    t = tri.withColumn("cx", F.explode(F.sequence(lo("x"), hi("x")))).withColumn("cy", F.explode(F.sequence(lo("y"), hi("y"))))
    r = rays.withColumns({"cx": F.floor(F.col("ox") / cell), "cy": F.floor(F.col("oy") / cell)})
    # Only cells with a ray are worth a shuffle of their faces.
    t = t.join(r.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi")
    d = (F.lit(0.0), F.lit(0.0), F.col("dz"))
    return _first_hit(r.join(t, ["cx", "cy"]), d, face_id, near, far)


def oblique_ray_hits(tri: DataFrame, rays: DataFrame, cell: float, near: float = 0.0, far: float = 1e3, face_id: str = "face_id") -> DataFrame:
    """(ray_id, face_id, t): the first face each ray (ox, oy, oz, dx, dy, dz) of any direction meets, near <= t <= far.

    A ray goes to the cells that it passes up to `far`, a face to the cells of its bounding
    box that a ray passes: an equi-join on cells.
    """
    from geomill.operators.rays import traversed

    ends = [((F.col(f"o{c}") + s * F.col(f"d{c}")) / cell).alias(f"{e}{c}") for e, s in (("a", near), ("b", far)) for c in AXES]
    key = [f"c{c}" for c in AXES]
    cells = traversed(rays.select("ray_id", *ends)).select("ray_id", *(F.col(c).cast("long").alias(k) for c, k in zip(AXES, key))).distinct()
    t = tri
    # A corner on a cell's wall may be hit from the cell before.
    for c, k in zip(AXES, key):
        corner = [F.col(f"{c}{i}") for i in range(3)]
        t = t.withColumn(k, F.explode(F.sequence(F.ceil(F.least(*corner) / cell) - 1, F.floor(F.greatest(*corner) / cell))))
    t = t.join(cells.select(*key).distinct(), key, "left_semi")
    both = cells.join(rays, "ray_id").join(t, key)
    return _first_hit(both, tuple(F.col(f"d{c}") for c in AXES), face_id, near, far)


def nearest_faces(tri: DataFrame, points: DataFrame, radius: float, point_id: str = "point_id", face_id: str = "face_id") -> DataFrame:
    """(point_id, face_id, distance): the nearest face within the radius (inclusive) of each point; a tie goes to the least face.

    A face is sent to the cells of side `radius` that its bounding box, grown by the radius,
    meets and that hold a point.
    """
    from geomill.functions import geometry as g

    key = [f"c{c}" for c in AXES]
    p = points.select(point_id, *(F.col(c).alias(f"p{c}") for c in AXES), *(F.floor(F.col(c) / radius).alias(k) for c, k in zip(AXES, key)))
    t = tri
    for c, k in zip(AXES, key):
        corner = [F.col(f"{c}{i}") for i in range(3)]
        t = t.withColumn(k, F.explode(F.sequence(F.floor((F.least(*corner) - radius) / radius), F.floor((F.greatest(*corner) + radius) / radius))))
    t = t.join(p.select(*key).distinct(), key, "left_semi")
    # In steps with named columns, so that nothing is computed twice and the code stays small enough to be compiled.
    both, corner = p.join(t, key), [g.vec("", str(i)) for i in range(3)]
    put = lambda df, name, v: df.withColumns({f"{name}{c}": x for c, x in zip(AXES, v)})
    for i in range(3):
        both = put(put(both, f"w{i}_", g.minus(g.vec("p"), corner[i])), f"e{i}_", g.minus(corner[(i + 1) % 3], corner[i]))
    both = put(both, "n_", g.cross(g.vec("e0_"), g.minus((F.lit(0.0),) * 3, g.vec("e2_"))))
    for i in range(3):
        e, w = g.vec(f"e{i}_"), g.vec(f"w{i}_")
        both = both.withColumns({f"in{i}": g.dot(g.cross(e, w), g.vec("n_")) >= 0, f"t{i}": F.least(F.greatest(g.dot(w, e) / g.dot(e, e), F.lit(0.0)), F.lit(1.0))})
        gap = tuple(a - F.col(f"t{i}") * b for a, b in zip(w, e))
        both = both.withColumn(f"s{i}", g.dot(gap, gap))
    both = both.withColumns({"nn": g.dot(g.vec("n_"), g.vec("n_")), "h": g.dot(g.vec("w0_"), g.vec("n_"))})
    d2 = F.when(F.col("in0") & F.col("in1") & F.col("in2") & (F.col("nn") > 0), F.col("h") * F.col("h") / F.col("nn")).otherwise(F.least("s0", "s1", "s2"))
    near = both.select(point_id, F.struct(d2.alias("d2"), F.col(face_id).alias("face")).alias("b")).groupBy(point_id).agg(F.min("b").alias("b"))
    return near.filter(F.col("b.d2") <= radius * radius).select(point_id, F.col("b.face").alias(face_id), F.sqrt("b.d2").alias("distance"))


def _first_hit(both: DataFrame, d: tuple, face_id: str, near: float, far: float) -> DataFrame:
    """The hit of least t, then least face, of the candidates of each ray."""
    e1, e2 = _minus(_at(1), _at(0)), _minus(_at(2), _at(0))
    h = _cross(d, e2)
    det = _dot(e1, h)
    s = _minus(tuple(F.col(f"o{c}") for c in AXES), _at(0))
    u = _dot(s, h) / det
    q = _cross(s, e1)
    v = _dot(d, q) / det
    dist = _dot(e2, q) / det
    hit = both.filter(F.abs(det) > 1e-12).select("ray_id", face_id, u.alias("u"), v.alias("v"), dist.alias("t")).filter(f"u >= 0 AND v >= 0 AND u + v <= 1 AND t >= {near} AND t <= {1e300 if far == float('inf') else far}")
    return hit.groupBy("ray_id").agg(F.min(F.struct("t", face_id)).alias("b")).select("ray_id", F.col(f"b.{face_id}").alias(face_id), F.col("b.t").alias("t"))


def resampled(tri: DataFrame, per_area: float) -> DataFrame:
    """(face_id, n, x, y, z): round(area * per_area) points on each face, at barycentric places from a hash of face and number."""
    n = F.round(area2(tri) / 2 * per_area).cast("int")
    k = tri.withColumn("n", n).filter("n > 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    u = (F.col("face_id") * 31 + F.col("i") * 17) % 101 / 101.0
    v = (F.col("face_id") * 13 + F.col("i") * 37) % 103 / 103.0
    k = k.withColumns({"u": u, "v": v}).withColumns({"a": F.when(F.col("u") + F.col("v") > 1, 1 - F.col("u")).otherwise(F.col("u")), "b": F.when(F.col("u") + F.col("v") > 1, 1 - F.col("v")).otherwise(F.col("v"))})
    return k.select("face_id", "i", *((F.col(f"{c}0") + F.col("a") * (F.col(f"{c}1") - F.col(f"{c}0")) + F.col("b") * (F.col(f"{c}2") - F.col(f"{c}0"))).alias(c) for c in AXES))


def mesh_components(faces: DataFrame) -> DataFrame:
    """(id, component) of the vertices, connected by edges of faces."""
    from geomill.operators.graph import components

    e = edges(faces)
    nodes = e.select(F.col("a").alias("id")).unionByName(e.select(F.col("b").alias("id"))).distinct()
    return components(nodes, e)


def along_normals(tri: DataFrame) -> DataFrame:
    """(face_id, v0, v1, v2): faces with corners and the normal (nx, ny, nz) of their first vertex; those whose own normal points against it have first and last vertex exchanged."""
    against = _dot(_cross(_minus(_at(1), _at(0)), _minus(_at(2), _at(1))), tuple(F.col(f"n{c}") for c in AXES)) < 0
    ends = lambda a, b: F.when(against, F.col(b)).otherwise(F.col(a))
    return tri.select("face_id", ends("v0", "v2").alias("v0"), "v1", ends("v2", "v0").alias("v2"))


def oriented(faces: DataFrame) -> DataFrame:
    """(face_id, v0, v1, v2, flipped, component, orientable): faces turned so that neighbours run along their shared edge in opposite directions.

    Each face has two sides, and an edge of exactly two faces joins their sides: like sides if they run
    along it in opposite directions, unlike ones else. The components of this graph of sides
    give for each face the side that agrees with the face of least id in its component (`component`), which
    stays as it is. If both sides of a face are connected, as on a strip with one twist, its component
    can't be oriented and stays as it is. Edges of three and more faces join none.
    """
    from geomill.operators.graph import components, cut

    runs = F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("v0", "v1"), ("v1", "v2"), ("v2", "v0"))))
    half = faces.select("face_id", F.inline(runs)).filter("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), F.struct("face_id", (F.col("a") < F.col("b")).alias("up")).alias("half"))
    pair = half.groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"), F.min("half").alias("f"), F.max("half").alias("g")).filter("n = 2 AND f.face_id <> g.face_id")
    turned = (F.col("f.up") == F.col("g.up")).cast("long")
    sides = F.array(*(F.struct((2 * F.col("f.face_id") + s).alias("a"), (2 * F.col("g.face_id") + (turned if s == 0 else 1 - turned)).alias("b")) for s in (0, 1)))
    ids = faces.select(F.explode(F.array(2 * F.col("face_id"), 2 * F.col("face_id") + 1)).alias("id"))
    found = components(ids, pair.select(F.inline(sides)))
    label = found.groupBy(F.floor(F.col("id") / 2).alias("face_id")).agg(F.max(F.when(F.col("id") % 2 == 0, F.col("component"))).alias("own"), F.max(F.when(F.col("id") % 2 == 1, F.col("component"))).alias("other"))
    known = cut(label.select("face_id", (F.col("own") > F.col("other")).alias("flipped"), F.floor(F.least("own", "other") / 2).alias("component"), (F.col("own") != F.col("other")).alias("orientable")))
    ends = lambda a, b: F.when(F.col("flipped"), F.col(b)).otherwise(F.col(a))
    return faces.join(known, "face_id").select("face_id", ends("v0", "v2").alias("v0"), "v1", ends("v2", "v0").alias("v2"), "flipped", "component", "orientable")

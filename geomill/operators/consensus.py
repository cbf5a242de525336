"""Models from minimal samples: lines, planes, circles, spheres and cylinders, tried until the best is certain enough.

Solvers are Column expressions over sample rows with the points s0, s1, ... (and for cylinders
the normals n0, n1); they give the parameters that the residuals of `fit` take, and `fixes`, which is 0
for samples that fix no model. Samples are drawn in batches from a bounded random part of the
points and scored on all points in one pass a batch.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geomill.functions import geometry as g
from geomill.operators import fit
from geomill.operators.filters import finite

AXES = ("x", "y", "z")
#: Points that samples are drawn from.
POOL = 8192


def _scaled(v: g.Vec, by: Column) -> g.Vec:
    return tuple(c * by for c in v)


def _plus(a: g.Vec, b: g.Vec) -> g.Vec:
    return tuple(x + y for x, y in zip(a, b))


def _with(df: DataFrame, **columns: g.Vec | Column) -> DataFrame:
    """Vectors as three columns each, so that later expressions refer to them instead of repeating them."""
    flat = {}
    for name, v in columns.items():
        flat |= {f"{name}{c}": x for c, x in zip("xyz", v)} if isinstance(v, tuple) else {name: v}
    return df.withColumns(flat)


def _safe(c: Column) -> Column:
    """Not zero, so that what a sample without a model divides by is harmless."""
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


def line(s: DataFrame) -> DataFrame:
    s = _with(s, e=g.minus(g.vec("s1"), g.vec("s0"))).withColumn("fixes", g.norm(g.vec("e")))
    return _with(s, p=g.vec("s0"), d=_scaled(g.vec("e"), 1 / _safe(F.col("fixes"))))


def plane(s: DataFrame) -> DataFrame:
    s = _with(s, n=g.cross(g.minus(g.vec("s1"), g.vec("s0")), g.minus(g.vec("s2"), g.vec("s0"))))
    s = s.withColumn("fixes", g.norm(g.vec("n")))
    s = s.withColumns(dict(zip("abc", _scaled(g.vec("n"), 1 / _safe(F.col("fixes"))))))
    return s.withColumn("d", -g.dot((F.col("a"), F.col("b"), F.col("c")), g.vec("s0")))


def circle(s: DataFrame) -> DataFrame:
    """Centre of the circumcircle, the unit normal of its plane, and the radius."""
    s = _with(s, a=g.minus(g.vec("s1"), g.vec("s0")), b=g.minus(g.vec("s2"), g.vec("s0")))
    s = _with(s, n=g.cross(g.vec("a"), g.vec("b")), a2=g.dot(g.vec("a"), g.vec("a")), b2=g.dot(g.vec("b"), g.vec("b")))
    s = s.withColumn("fixes", g.dot(g.vec("n"), g.vec("n")))
    s = _with(s, to=_scaled(_plus(_scaled(g.cross(g.vec("n"), g.vec("a")), F.col("b2")), _scaled(g.cross(g.vec("b"), g.vec("n")), F.col("a2"))), 1 / (2 * _safe(F.col("fixes")))))
    return _with(s, p=_plus(g.vec("s0"), g.vec("to")), d=_scaled(g.vec("n"), 1 / _safe(F.sqrt("fixes"))), r=g.norm(g.vec("to")))


def sphere(s: DataFrame) -> DataFrame:
    s = _with(s, **{n: g.minus(g.vec(f"s{i}"), g.vec("s0")) for i, n in ((1, "a"), (2, "b"), (3, "e"))})
    s = _with(s, u=g.cross(g.vec("b"), g.vec("e")), v=g.cross(g.vec("e"), g.vec("a")), w=g.cross(g.vec("a"), g.vec("b")), **{f"{n}2": g.dot(g.vec(n), g.vec(n)) for n in "abe"})
    s = s.withColumn("fixes", g.dot(g.vec("a"), g.vec("u")))
    s = _with(s, to=_scaled(_plus(_plus(_scaled(g.vec("u"), F.col("a2")), _scaled(g.vec("v"), F.col("b2"))), _scaled(g.vec("w"), F.col("e2"))), 1 / (2 * _safe(F.col("fixes")))))
    return _with(s, c=_plus(g.vec("s0"), g.vec("to")), r=g.norm(g.vec("to")))


def cylinder(s: DataFrame) -> DataFrame:
    """The axis crosses both normals at right angles: its direction is their product, a point of it the first normal's nearest to the second."""
    s = _with(s, m=g.cross(g.vec("n0"), g.vec("n1"))).withColumn("fixes", g.dot(g.vec("m"), g.vec("m")))
    s = s.withColumn("along", g.dot(g.cross(g.minus(g.vec("s1"), g.vec("s0")), g.vec("n1")), g.vec("m")) / _safe(F.col("fixes")))
    return _with(s, p=_plus(g.vec("s0"), _scaled(g.vec("n0"), F.col("along"))), d=_scaled(g.vec("m"), 1 / _safe(F.sqrt("fixes"))), r=F.abs("along") * g.norm(g.vec("n0")))


@dataclass(frozen=True)
class Model:
    size: int
    solve: Callable[[DataFrame], DataFrame]
    params: tuple[str, ...]
    residual: Callable[[], Column]
    normals: bool = False


MODELS = {
    "line": Model(2, line, ("px", "py", "pz", "dx", "dy", "dz"), fit.line_residual),
    "plane": Model(3, plane, ("a", "b", "c", "d"), fit.plane_residual),
    "circle": Model(3, circle, ("px", "py", "pz", "dx", "dy", "dz", "r"), fit.circle_residual),
    "sphere": Model(4, sphere, ("cx", "cy", "cz", "r"), fit.sphere_residual),
    "cylinder": Model(2, cylinder, ("px", "py", "pz", "dx", "dy", "dz", "r"), fit.cylinder_residual, normals=True),
}


def solved(samples: DataFrame, kind: str) -> DataFrame:
    """(model_id, parameters) of the samples (model_id, s0x, s0y, ...) that fix a model."""
    model = MODELS[kind]
    return model.solve(samples).filter(F.col("fixes") != 0).select("model_id", *model.params)


def certainty(share: float, size: int, tried: int) -> float:
    """That one of so many samples held inliers only, at that share of inliers."""
    good = share**size
    return 1.0 if good >= 1 and tried else 1 - (1 - good) ** tried


def consensus(points: DataFrame, kind: str, threshold: float, certain: float = 0.99, batch: int = 128, most: int = 4096, seed: int = 1, point_id: str = "point_id") -> DataFrame:
    """(model_id, parameters, inliers, tried, certainty, met): the model with the most points nearer than the threshold.

    A batch of samples is drawn, solved and scored on all points, until the trials are enough
    for the best model's share of inliers; a later model replaces it only with more inliers. If `most`
    trials end first, `met` is false and `certainty` says what was reached. Points without a
    finite place count nowhere; there is no row if no sample fixes a model.
    """
    spark, model = points.sparkSession, MODELS[kind]
    names = [*AXES, *(f"n{c}" for c in AXES)] if model.normals else list(AXES)
    points = points.filter(finite(*names))
    n = points.count()
    pool = points.orderBy(F.xxhash64(F.lit(seed), point_id), point_id).limit(POOL).select(*(F.col(c).cast("double") for c in names)).collect()
    rng = np.random.default_rng(seed)
    columns = ", ".join(["model_id int", *(f"{'n' if c.startswith('n') else 's'}{i}{c[-1]} double" for i in range(model.size) for c in names)])
    best, tried = None, 0
    while len(pool) >= model.size and tried < most:
        size = min(batch, most - tried)
        drawn = [(tried + t, *(v for i in rng.choice(len(pool), model.size, replace=False) for v in pool[i])) for t in range(size)]
        rows = [r for r in solved(spark.createDataFrame(drawn, columns), kind).collect() if all(map(math.isfinite, r))]
        tried += size
        if rows:
            models = spark.createDataFrame(rows)
            top = fit.score_models(points.select(*AXES), models, model.residual(), threshold, most=batch).orderBy(F.desc("inliers"), "model_id").first()
            if top and (best is None or top["inliers"] > best[1]):
                best = (next(r for r in rows if r["model_id"] == top["model_id"]), top["inliers"])
        if best and certainty(best[1] / n, model.size, tried) >= certain:
            break
    params = model.params
    schema = ", ".join(["model_id int", *(f"{p} double" for p in params), "inliers long", "tried int", "certainty double", "met boolean"])
    if best is None:
        return spark.createDataFrame([], schema)
    reached = certainty(best[1] / n, model.size, tried)
    return spark.createDataFrame([(*(best[0][c] for c in ("model_id", *params)), best[1], tried, float(reached), bool(reached >= certain))], schema)


def trials_needed(share: float, size: int, certain: float = 0.99) -> int:
    """Samples for that certainty, at that share of inliers."""
    good = share**size
    return 1 if good >= 1 else math.ceil(math.log(1 - certain) / math.log1p(-good))

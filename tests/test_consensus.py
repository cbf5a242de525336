"""Planted models under half of outliers, and solvers against their defining property."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomill.functions import geometry as g
from geomill.operators import consensus, fit

COLUMNS = "point_id long, x double, y double, z double, nx double, ny double, nz double"


def _planted(kind, rng, n):
    u, v = rng.uniform(0, 2 * np.pi, n), rng.uniform(-1, 1, n)
    zero = np.zeros(n)
    if kind == "line":
        p = np.array([1, 2, 3]) + np.outer(10 * v, [1, 2, 2]) / 3
    elif kind == "plane":
        p = np.stack([10 * v, 10 * np.cos(u), 0.5 * 10 * v + 4], axis=1)
    elif kind == "circle":
        p = np.array([1, -2, 4]) + 5 * np.stack([np.cos(u), zero, np.sin(u)], axis=1)
    elif kind == "sphere":
        p = np.array([1, -2, 4]) + 5 * np.stack([np.sqrt(1 - v * v) * np.cos(u), np.sqrt(1 - v * v) * np.sin(u), v], axis=1)
    else:
        p = np.stack([3 + 2 * np.cos(u), 10 * v, -1 + 2 * np.sin(u)], axis=1)
    normal = np.stack([np.cos(u), zero, np.sin(u)], axis=1)
    return p, normal


@pytest.mark.parametrize("kind", list(consensus.MODELS))
def test_planted_model_is_found_under_half_of_outliers(spark, kind):
    rng = np.random.default_rng(7)
    p, normal = _planted(kind, rng, 300)
    noise = rng.uniform(-12, 12, (300, 3))
    off = rng.normal(size=(300, 3))
    rows = np.concatenate([np.hstack([p, normal]), np.hstack([noise, off / np.linalg.norm(off, axis=1)[:, None]])])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)] + [(900, math.nan, 0.0, 0.0, 1.0, 0.0, 0.0)], COLUMNS)
    r = consensus.consensus(df, kind, 0.01).first()
    assert r.met and r.certainty >= 0.99 and r.inliers >= 300 and r.tried <= 4096
    if kind == "sphere":
        assert (r.cx, r.cy, r.cz, r.r) == pytest.approx((1, -2, 4, 5))
    if kind == "circle":
        assert (r.px, r.py, r.pz, r.r, abs(r.dy)) == pytest.approx((1, -2, 4, 5, 1))
    if kind == "cylinder":
        assert (r.px, r.pz, r.r, abs(r.dy)) == pytest.approx((3, -1, 2, 1))
    if kind == "line":
        assert abs(r.dx / r.dy) == pytest.approx(0.5) and abs(r.dz / r.dy) == pytest.approx(1)


def test_unmet_certainty_is_reported(spark):
    p = np.random.default_rng(3).uniform(-10, 10, (300, 3))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(p)], "point_id long, x double, y double, z double")
    r = consensus.consensus(df, "sphere", 0.001, batch=16, most=40).first()
    assert not r.met and r.tried == 40 and r.certainty == pytest.approx(consensus.certainty(r.inliers / 300, 4, 40)) and r.certainty < 0.01


def test_samples_without_a_model(spark):
    same = spark.createDataFrame([(i, 1.0, 1.0, 1.0) for i in range(9)], "point_id long, x double, y double, z double")
    for kind in ("line", "plane", "circle", "sphere"):
        assert consensus.consensus(same, kind, 0.1, batch=4, most=8).count() == 0
    assert consensus.consensus(same.limit(1), "line", 0.1).count() == 0


@pytest.mark.parametrize("kind", ["line", "plane", "circle", "sphere"])
def test_models_pass_through_their_samples(spark, kind):
    size = consensus.MODELS[kind].size
    rows = [(i, *map(float, v)) for i, v in enumerate(np.random.default_rng(2).uniform(-5, 5, (50, 3 * size)))]
    names = ["model_id", *(f"s{i}{c}" for i in range(size) for c in "xyz")]
    df = spark.createDataFrame(rows, names)
    both = consensus.solved(df, kind).join(df, "model_id")
    for i in range(size):
        at = both.select("*", *(F.col(f"s{i}{c}").alias(c) for c in "xyz"))
        assert at.agg(F.max(F.abs(consensus.MODELS[kind].residual()))).first()[0] < 1e-5


def test_trials():
    assert consensus.trials_needed(0.5, 3) == 35 and consensus.trials_needed(1.0, 3) == 1
    assert consensus.certainty(0.5, 3, 35) >= 0.99 > consensus.certainty(0.5, 3, 34)
    assert consensus.certainty(1.0, 3, 0) == 0 and fit.trials(0.5, 3) == 35
    assert g.vec("s0")

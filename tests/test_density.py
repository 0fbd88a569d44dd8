"""Kernel density within its stated error of the full sum."""

import math

import numpy as np
import pytest

from heddle.operators import density as D


def full(p):
    n = len(p)
    c = np.cov(p.T) * n ** (-1 / 3)
    e = p[:, None, :] - p[None, :, :]
    return np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", e, np.linalg.inv(c), e)).sum(1) / (n * 2 * math.pi * math.sqrt(np.linalg.det(c)))


@pytest.mark.parametrize("crowd", [100_000, 40])
def test_density_is_within_its_error(spark, monkeypatch, crowd):
    """Two clouds, a far point, a third of all points at one place; crowded squares are dealt in parts."""
    monkeypatch.setattr(D, "PART_POINTS", crowd)
    rng = np.random.default_rng(3)
    p = np.vstack([rng.normal(size=(300, 2)) @ [[2, 1.2], [0, 0.4]], rng.normal(size=(200, 2)) + [9, -3], np.repeat([[1.5, 2.5]], 250, axis=0), [[60.0, -40.0]]])
    df = spark.createDataFrame([(i, float(a), float(b), "kept") for i, (a, b) in enumerate(p)] + [(-1, None, 1.0, "kept"), (-2, float("nan"), 1.0, "kept"), (-3, 1.0, float("inf"), "kept")], "id long, x double, y double, n string")
    out = {r.id: r.density for r in D.density(df).collect()}
    assert len(out) == len(p) + 3 and [out[i] for i in (-1, -2, -3)] == [None] * 3
    peak = 1 / (2 * math.pi * math.sqrt(np.linalg.det(np.cov(p.T) * len(p) ** (-1 / 3))))
    got = np.array([out[i] for i in range(len(p))])
    assert np.abs(got - full(p)).max() <= D.ERROR_SHARE * peak and D.ERROR_SHARE < 0.005
    assert np.corrcoef(got, full(p))[0, 1] > 0.9999


def test_density_without_an_area(spark):
    line = spark.createDataFrame([(float(i), 2.0 * i) for i in range(9)], "x double, y double")
    assert {r.density for r in D.density(line).collect()} == {None} and {r.density for r in D.density(line.limit(2)).collect()} == {None}
    assert D.density(line.where("x < 0")).collect() == []


def test_cells_travel_once_and_not_with_each_point(spark):
    """Before, each point was joined with the cells of nine squares (up to 220 KB) and sorted with them, so what was spilled grew as points times cells."""
    df = spark.range(4000).selectExpr("id", "cast(id % 63 as double) as x", "cast(id * 7 % 97 as double) as y")
    out = D.density(df)
    assert out.where("density > 0").count() == 4000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2  # squares with their numbers of parts, points with those of crowded squares

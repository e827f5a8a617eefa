"""Repulsion from a tree of cell sums beside the sum over all pairs."""

import numpy as np
import pytest

from embedlens.operators import farfield

PUSH = lambda sq: 1.0 / (1.0 + sq) ** 2


def brute(p):
    diff = p[:, None, :] - p[None, :, :]
    sq = (diff**2).sum(2)
    force = (PUSH(sq)[:, :, None] * diff).sum(1)
    return force / (len(p) - 1), ((1 / (1 + sq)).sum(1) - 1) / (len(p) - 1)


def clouds(n, size, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, size, (8, 3))
    return centres[rng.integers(8, size=n)] + rng.normal(0, size / 8, (n, 3))


@pytest.mark.parametrize("size", [0.01, 1.0, 30.0])
def test_error_is_below_two_percent(spark, size):
    p = clouds(900, size)
    rows = spark.createDataFrame([(i, *map(float, q), "kept") for i, q in enumerate(p)], "id long, x double, y double, z double, more string").repartition(4)
    got = {r.id: r for r in farfield.repulsion(rows, PUSH, len(p)).collect()}
    force, near = brute(p)
    mine = np.array([[got[i].px, got[i].py, got[i].pz] for i in range(len(p))])
    assert np.linalg.norm(mine - force) < 0.02 * np.linalg.norm(force)
    q = np.array([got[i].q for i in range(len(p))])
    assert np.abs(q - near).max() < 0.02 * near.max() and {r.more for r in got.values()} == {"kept"}


def test_angle_zero_gives_the_sum_over_all_pairs(spark):
    p = clouds(200, 3.0)
    rows = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id long, x double, y double, z double")
    got = {r.id: (r.px, r.py, r.pz) for r in farfield.repulsion(rows, PUSH, len(p), angle=0.0).collect()}
    assert np.allclose([got[i] for i in range(len(p))], brute(p)[0], atol=1e-12)


def test_few_cells_many_points(spark):
    """Cells that hold many points are still small beside the reach of the force."""
    p = clouds(3000, 0.3, 2)
    rows = spark.createDataFrame([(i, *map(float, q)) for i, q in enumerate(p)], "id long, x double, y double, z double")
    tree, _ = farfield.pyramid(rows, 600)
    assert len(tree.codes) <= 620 and tree.count[0][0] == 3000
    got = {r.id: (r.px, r.py, r.pz) for r in farfield.repulsion(rows, PUSH, len(p), cells=600).collect()}
    force = brute(p)[0]
    assert np.linalg.norm(np.array([got[i] for i in range(len(p))]) - force) < 0.02 * np.linalg.norm(force)


@pytest.mark.parametrize("points", [[], [(0.0, 0.0, 0.0)], [(1.0, 2.0, 3.0)] * 5, [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)]])
def test_few_and_equal_points(spark, points):
    rows = spark.createDataFrame([(i, *q) for i, q in enumerate(points)], "id long, x double, y double, z double")
    got = farfield.repulsion(rows, PUSH, len(points)).orderBy("id").collect()
    assert len(got) == len(points)
    if len(points) > 1:
        assert np.allclose([(r.px, r.py, r.pz) for r in got], brute(np.array(points))[0])

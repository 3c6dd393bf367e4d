"""Nearest neighbours against plain search: many dimensions, clusters, ties, copies, few points, odd groupings."""

import numpy as np
import pytest

from riskspark.operators import neighbours


def plain(data, k):
    square = ((data[:, None, :] - data[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(square, np.inf)
    ids = np.broadcast_to(np.arange(len(data)), square.shape)
    return np.lexsort((ids, square), axis=1)[:, : min(k, len(data) - 1)].tolist()


RNG = np.random.default_rng(0)
CASES = {
    "34 dimensions": (RNG.normal(size=(900, 34)), 5, 200),
    "clusters": (np.concatenate([RNG.normal(20 * i, 1, size=(150, 6)) for i in range(6)]), 5, 100),
    "ties": (RNG.integers(0, 4, size=(500, 3)).astype(float), 4, 90),
    "far from zero": (RNG.normal(size=(400, 3)) * 1e-4 + 1e6, 5, 100),
    "one place": (np.zeros((150, 2)), 3, 40),
    "fewer than k": (RNG.normal(size=(4, 3)), 5, 100),
    "one point": (np.zeros((1, 3)), 5, 100),
    "a point a group": (RNG.normal(size=(30, 2)), 2, 1),
}


def table(spark, data):
    rows = [(i, list(map(float, x)), 1) for i, x in enumerate(data)]
    return spark.createDataFrame(rows, "id long, x array<double>, n long")


@pytest.mark.parametrize("case", CASES)
def test_neighbours_equal_plain_search(spark, case):
    data, k, group_rows = CASES[case]
    got = {r["id"]: r["found"] for r in neighbours.nearest_neighbours(table(spark, data), k, group_rows).collect()}
    assert [[f["id"] for f in got[i]] for i in range(len(data))] == plain(data, k)
    assert all(f["x"] == data[f["id"]].tolist() for found in got.values() for f in found)


def test_no_points(spark):
    assert neighbours.nearest_neighbours(table(spark, []), 5).count() == 0


def test_bounds_send_few_points_between_far_clusters(spark, monkeypatch):
    """With clusters far apart no group receives points of another cluster."""
    data = np.concatenate([RNG.normal(1000 * i, 1, size=(200, 4)) for i in range(5)])
    pivots, radius = data[::10], np.full(100, 8.0)
    lowest = np.sort(RNG.uniform(0, 3, size=(100, 6)), axis=1)
    cells = spark.createDataFrame([(c, c // 20) for c in range(100)], "cell int, grp long").repartition("grp")
    reach = neighbours._reach(cells, pivots, radius, lowest, 5).collect()
    assert reach and all(r["cell"] // 20 == r["grp"] for r in reach)


def test_group_cells_keep_near_cells_together():
    pivots = np.array([[0.0], [100.0], [1.0], [101.0]])
    groups = neighbours.group_cells(pivots, np.array([5, 5, 5, 5]), 10)
    assert groups[0] == groups[2] != groups[1] == groups[3]

"""Leaf tables against the trees they come from, and Shapley values against their definition over all coalitions."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskspark.operators import isolation, models, trees
from riskspark.operators.features import feature_vector

NAMES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(600, 5)).round(2)
    label = ((data[:, 0] + data[:, 1] * data[:, 2] + rng.normal(scale=0.3, size=600)) > 0.4).astype(int)
    made = [(i, int(y), *map(float, x)) for i, (x, y) in enumerate(zip(data, label))]
    path = str(tmp_path_factory.mktemp("trees") / "rows")
    spark.createDataFrame(made, "id int, Class int, a double, b double, c double, d double, e double").write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def fitted(spark, rows):
    model = models.fit_boosted_trees(rows, NAMES, "Class", 2.0, maxIter=6, maxDepth=4, stepSize=0.3, featureSubsetStrategy="all")
    nodes = trees.node_table(spark, model)
    return model, nodes, trees.leaf_table(nodes).cache()


def worth(nodes, x, coalition, node=0):
    """A tree's mean score of a row whose features outside the coalition follow the covers."""
    n = nodes[node]
    if n["feature"] is None:
        return n["value"]
    left, right = n["left"], n["right"]
    if n["feature"] in coalition:
        return worth(nodes, x, coalition, left if x[n["feature"]] <= n["threshold"] else right)
    share = nodes[left]["cover"] / n["cover"]
    return share * worth(nodes, x, coalition, left) + (1 - share) * worth(nodes, x, coalition, right)


def plain_shapley(forest, x, width):
    out = np.zeros(width)
    for j in range(width):
        others = [k for k in range(width) if k != j]
        for size in range(width):
            weight = factorial(size) * factorial(width - size - 1) / factorial(width)
            for chosen in combinations(others, size):
                out[j] += weight * sum(worth(t, x, {*chosen, j}) - worth(t, x, set(chosen)) for t in forest)
    return out


def test_margin_equals_the_model(fitted, rows):
    model, _, leaves = fitted
    scored = model.transform(isolation.assemble(rows, NAMES)).select("id", vector_to_array("rawPrediction")[1].alias("want"), *NAMES)
    got = scored.select("want", trees.margin(leaves, feature_vector(NAMES)).alias("got")).collect()
    assert max(abs(r["want"] - r["got"]) for r in got) < 1e-9


def test_shapley_values_equal_their_definition(spark, fitted, rows):
    model, nodes, leaves = fitted
    forest = {}
    for r in nodes.collect():
        forest.setdefault(r["tree"], {})[r["node"]] = r
    got = rows.orderBy("id").limit(25).select(*NAMES, models.tree_contributions(model, NAMES, spark).alias("v"), trees.margin(leaves, feature_vector(NAMES)).alias("m"))
    expectation = trees.LeafArrays(leaves, len(NAMES)).expectation
    assert expectation == pytest.approx(sum(worth(t, [0] * 5, set()) for t in forest.values()))
    for r in got.collect():
        assert np.allclose(r["v"], plain_shapley(forest.values(), [r[n] for n in NAMES], 5), atol=1e-9)
        assert sum(r["v"]) == pytest.approx(r["m"] - expectation, abs=1e-9)


def test_repeated_features_become_one_interval(fitted):
    _, nodes, leaves = fitted
    rows = leaves.collect()
    assert len(rows) == nodes.filter("feature IS NULL").count()
    assert all(len({e["feature"] for e in r["path"]}) == len(r["path"]) for r in rows)
    assert all(e["low"] < e["high"] and 0 < e["share"] <= 1 for r in rows for e in r["path"])
    # The shares of a tree's leaves are those of all rows.
    for tree in {r["tree"] for r in rows}:
        assert sum(np.prod([e["share"] for e in r["path"]]) for r in rows if r["tree"] == tree) == pytest.approx(1.0)


def test_a_tree_of_one_leaf(spark, rows):
    kind = "tree int, node int, feature int, threshold double, left int, right int, value double, cover double"
    leaves = trees.leaf_table(spark.createDataFrame([(0, 0, None, None, None, None, 2.5, 10.0)], kind))
    got = rows.limit(3).select(trees.margin(leaves, feature_vector(NAMES)).alias("m"), trees.shapley_values(leaves, feature_vector(NAMES), 5).alias("v")).collect()
    assert all(r["m"] == 2.5 and r["v"] == [0.0] * 5 for r in got)


def test_a_leaf_that_no_training_row_met(spark, rows):
    nodes = trees.mean_split_nodes(rows.filter("a > 10 OR (a < 0 AND b < 0)"), NAMES[:2], "Class")
    arrays = trees.LeafArrays(trees.leaf_table(nodes), 2)
    x = np.random.default_rng(0).normal(size=(20, 2))
    assert np.isfinite(arrays.shapley(x)).all()


def test_expressions_need_no_python(spark, fitted, rows):
    plan = rows.select(trees.margin(fitted[2], feature_vector(NAMES)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and F is not None

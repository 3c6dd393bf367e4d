"""Histogram boosting against a plain version of the same sums, over blocks and tasks, with gaps and odd tables."""

import pickle

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from riskspark.operators import boosting, trees
from riskspark.operators import evaluation as E
from riskspark.operators.features import feature_vector

NAMES = ["a", "b", "c", "d"]
KIND = "id int, Class int, a double, b double, c double, d double"


def made(n=800, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)).round(1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(scale=0.5, size=n) > 0.5).astype(int)
    return x, y


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    x, y = made()
    path = str(tmp_path_factory.mktemp("boosting") / "rows")
    spark.createDataFrame([(i, int(k), *map(float, r)) for i, (r, k) in enumerate(zip(x, y))], KIND).repartition(4).write.parquet(path)
    return spark.read.parquet(path)


def plain(x, y, weight, rounds, depth, rate, l2, least):
    """Margins of boosted trees that try every cut between values at every node, no sampling."""
    margin, w = np.zeros(len(y)), np.where(y == 1, weight, 1.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)

        def grow(rows, level):
            total = g[rows].sum(), h[rows].sum()
            best = (1e-6, None, None)
            for f in range(x.shape[1]) if level < depth else ():
                for cut in np.unique(x[rows, f])[:-1]:
                    left = rows[x[rows, f] <= cut]
                    gl, hl = g[left].sum(), h[left].sum()
                    gr, hr = total[0] - gl, total[1] - hl
                    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - total[0] ** 2 / (total[1] + l2)
                    if hl >= least and hr >= least and gain > best[0] * (1 + 1e-12):
                        best = (gain, f, cut)
            if best[1] is None:
                margin[rows] -= rate * total[0] / (total[1] + l2)
                return
            left = x[rows, best[1]] <= best[2]
            grow(rows[left], level + 1)
            grow(rows[~left], level + 1)

        grow(np.arange(len(y)), 0)
    return margin


SETTINGS = {"row_share": 1.1, "column_share": 1.0, "rounds": 5, "depth": 3, "rate": 0.3}


def margins(df, model):
    return {r["id"]: r["p"] for r in df.select("id", model.probability(df.sparkSession, feature_vector(model.features)).alias("p")).collect()}


@pytest.mark.parametrize("block_rows", [50, 100_000])
def test_equals_a_plain_version(table, monkeypatch, block_rows):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(boosting, "CHECKPOINT", 2)
    monkeypatch.setattr(boosting, "WIDTH", 3)
    x, y = made()
    model = boosting.fit_histogram_trees(table, NAMES, "Class", 2.0, **SETTINGS)
    want = plain(x, y, 2.0, 5, 3, 0.3, 1.0, 2.0)
    got = margins(table, model)
    assert np.allclose([got[i] for i in range(len(y))], 1 / (1 + np.exp(-want)), atol=1e-9)


def test_the_driver_gets_splits_and_no_histograms(table, monkeypatch):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    monkeypatch.setattr(boosting, "WIDTH", 3)
    sent = []
    for name in ("collect", "take"):

        def spied(self, *args, own=getattr(RDD, name)):
            got = own(self, *args)
            sent.append(len(pickle.dumps(got)))
            return got

        monkeypatch.setattr(RDD, name, spied)
    boosting.fit_histogram_trees(table, NAMES, "Class", **SETTINGS)
    assert len(sent) >= 15 and max(sent) < 2_000  # a histogram of one node and column alone is more


def test_settings_learn_and_repeat(table):
    fit = lambda: boosting.fit_histogram_trees(table, NAMES, "Class", rounds=30, rate=0.2)
    one, two = fit(), fit()
    assert all(np.array_equal(getattr(one, n), getattr(two, n)) for n in ("feature", "threshold", "value", "cover"))
    scored = table.select(F.col("Class").alias("label"), one.probability(table.sparkSession, feature_vector(NAMES)).alias("score"))
    assert E.roc_auc(scored).first()["auc"] > 0.93
    # 0.9 of four columns rounds to all; of the rows about a tenth is left out of each tree.
    roots = one.cover[:, 0]
    assert roots[0] == pytest.approx(0.25 * 0.9 * 800, rel=0.05)


def test_node_tables_score_and_load_alike(spark, table):
    model = boosting.fit_histogram_trees(table, NAMES, "Class", rounds=6, rate=0.5)
    nodes = model.node_table(spark)
    loaded = boosting.BoostedTrees.from_nodes(nodes, NAMES)
    assert margins(table, loaded) == margins(table, model)
    leaves = trees.leaf_table(nodes)
    p = 1 / (1 + F.exp(-trees.margin(leaves, feature_vector(NAMES))))
    own = margins(table, model)
    assert all(abs(own[r["id"]] - r["p"]) < 1e-9 for r in table.select("id", p.alias("p")).collect())


def test_gaps_go_left_and_odd_tables_give_leaves(spark):
    rows = [(i, int(i % 3 == 0), None if i % 3 == 0 else 1.0, float("nan") if i % 5 else 0.0, 1.0, float(i % 2)) for i in range(90)]
    df = spark.createDataFrame(rows, KIND)
    model = boosting.fit_histogram_trees(df, NAMES, "Class", rounds=20, depth=2, rate=0.5)
    got = margins(df, model)
    assert min(got[i] for i in range(0, 90, 3)) > 0.8 > 0.2 > max(got[i] for i in range(90) if i % 3)
    for odd in (df.limit(0), df.filter("Class = 0")):
        lone = boosting.fit_histogram_trees(odd, NAMES, "Class", rounds=2)
        assert (lone.feature == -1).all() and len(margins(df, lone)) == 90


def test_best_splits_prefers_the_first_of_equal_gains():
    sums = np.zeros((1, 2, 3, 2))
    sums[0, :, 0], sums[0, :, 2] = (-5.0, 4.0), (5.0, 4.0)
    gain, column, cut, *sides = boosting.best_splits(sums, 1.0, 2.0)[0]
    assert (gain, column, cut, sides) == (10.0, 0, 0, [-5.0, 4.0, 5.0, 4.0])

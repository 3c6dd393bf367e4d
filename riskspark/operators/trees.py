"""Trees as tables: nodes, the box of feature intervals that leads to each leaf, scores and exact Shapley values from them.

A node table has (tree, node, feature, threshold, left, right, value, cover), node 0 being a tree's root, feature null in a
leaf, cover the weight of the training rows that came by. A row goes left if its value is at most the threshold. The
number of leaves is bounded by trees and depth, whatever the number of rows, so a leaf table may be sent to every task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.operators import ranks
from riskspark.session import shared_folder

BLOCK_CELLS = 4_000_000  # rows x leaves x path places held at once when explaining


def node_table(spark: SparkSession, model: GBTClassificationModel) -> DataFrame:
    """Nodes of boosted trees, leaf values times tree weights, read from the model as it is stored."""
    path = shared_folder(spark, "tree-nodes")
    model.write().save(path)
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "about", "weight").select("tree", "weight")
    stored = spark.read.parquet(f"{path}/data").toDF("tree", "n").select("tree", "n.*")
    inner = F.col("leftChild") >= 0
    return stored.join(weights, "tree").select(
        "tree",
        F.col("id").alias("node"),
        F.when(inner, F.col("split.featureIndex")).alias("feature"),
        F.when(inner, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(inner, F.col("leftChild")).alias("left"),
        F.when(inner, F.col("rightChild")).alias("right"),
        (F.col("prediction") * F.col("weight")).alias("value"),
        F.col("impurityStats")[0].alias("cover"),
    )


def leaf_table(nodes: DataFrame) -> DataFrame:
    """tree, leaf, value and path of every leaf: an entry (feature, low, high, share) for each feature on the way.

    The leaf holds rows with low < x <= high for all entries. `share` is the part of the training weight that goes the
    leaf's way where the feature is split on, multiplied over its splits; 0 where nothing came by.
    """
    nodes = ranks.work_table(nodes, "nodes")
    covers = nodes.select("tree", F.col("node").alias("child"), F.col("cover").alias("child_cover"))
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    children = []
    for side, least, most in (("left", low, F.col("threshold")), ("right", F.col("threshold"), high)):
        entry = F.struct(F.col("feature").cast("int").alias("feature"), least.alias("low"), most.alias("high"))
        children.append(nodes.filter("feature IS NOT NULL").select("tree", F.col("node").alias("parent"), F.col(side).alias("child"), "cover", entry.alias("entry")))
    share = F.when(F.col("cover") > 0, F.col("child_cover") / F.col("cover")).otherwise(0.0)
    edges = children[0].unionByName(children[1]).join(covers, ["tree", "child"])
    edges = ranks.work_table(edges.select("tree", "parent", "child", F.struct("entry.*", share.alias("share")).alias("entry")), "edges")
    at = nodes.filter("node = 0").select("tree", F.col("node").alias("parent"), F.lit([]).cast("array<struct<feature:int,low:double,high:double,share:double>>").alias("way"))
    reached = at
    while True:  # a round a level
        at = ranks.work_table(
            at.join(edges, ["tree", "parent"]).select("tree", F.col("child").alias("parent"), F.concat("way", F.array("entry")).alias("way")), "level"
        )
        if at.isEmpty():
            break
        reached = reached.unionByName(at)
    leaves = reached.withColumnRenamed("parent", "node").join(nodes.filter("feature IS NULL").select("tree", "node", "value"), ["tree", "node"])
    entries = leaves.select("tree", F.col("node").alias("leaf"), "value", F.explode_outer("way").alias("e")).select("tree", "leaf", "value", "e.*")
    merged = entries.groupBy("tree", "leaf", "value", "feature").agg(
        F.max("low").alias("low"), F.min("high").alias("high"), F.product("share").alias("share")
    )
    path = F.collect_list(F.when(F.col("feature").isNotNull(), F.struct("feature", "low", "high", "share")))
    return merged.groupBy("tree", "leaf", "value").agg(F.sort_array(path).alias("path"))


def margin(leaves: DataFrame, vector: Column) -> Column:
    """The sum of the values of the leaves that hold a row, from its feature vector; JVM expressions only.

    The leaves are a constant of the plan, in order of tree and leaf, so a row's sum has a fixed order.
    """
    rows = [r.asDict(recursive=True) for r in leaves.orderBy("tree", "leaf").select("value", "path").collect()]
    every = F.from_json(F.lit(json.dumps(rows)), "array<struct<value:double,path:array<struct<feature:int,low:double,high:double,share:double>>>>")

    def inside(entry: Column) -> Column:
        x = F.get(vector, entry["feature"])
        return (x > entry["low"]) & (x <= entry["high"])

    return F.aggregate(
        every, F.lit(0.0), lambda total, leaf: total + F.when(F.forall(leaf["path"], inside), leaf["value"]).otherwise(0.0)
    )


class LeafArrays:
    """A leaf table as arrays, paths padded to one length by entries that every row passes."""

    def __init__(self, leaves: DataFrame, width: int):
        rows = leaves.orderBy("tree", "leaf").collect()
        depth = max((len(r["path"]) for r in rows), default=0)
        shape = (len(rows), depth)
        self.width = width
        self.value = np.array([r["value"] for r in rows], dtype=float)
        self.feature = np.zeros(shape, np.int64)
        self.low, self.high = np.full(shape, -np.inf), np.full(shape, np.inf)
        self.share, self.real = np.ones(shape), np.zeros(shape, bool)
        for i, row in enumerate(rows):
            for j, entry in enumerate(row["path"]):
                self.feature[i, j], self.low[i, j], self.high[i, j] = entry["feature"], entry["low"], entry["high"]
                self.share[i, j], self.real[i, j] = entry["share"], True

    @property
    def expectation(self) -> float:
        """The mean score of the trees' training rows, as the covers have them."""
        return float((self.value * self.share.prod(axis=1)).sum())

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Shapley values (rows x features) of the game in which a feature outside a coalition follows the covers.

        In a leaf, a coalition's worth is a product over the path: whether the row passes for features inside, the share for
        those outside. The weighted sum over coalitions of the others is the integral over t in 0..1 of the product of
        (pass x t + share x (1 - t)), a polynomial of the path's length less one, which Gauss' rule gives exactly.
        """
        rows, (leaves, depth) = len(x), self.feature.shape
        out = np.zeros((rows, self.width))
        if not depth:
            return out
        places, weights = np.polynomial.legendre.leggauss((depth + 1) // 2)
        block = max(1, BLOCK_CELLS // (leaves * depth))
        for start in range(0, rows, block):
            seen = x[start : start + block][:, self.feature]
            passes = ((seen > self.low) & (seen <= self.high)).astype(float)
            passes[:, ~self.real] = 1.0
            inner = np.zeros_like(passes)
            for t, w in zip((places + 1) / 2, weights / 2):
                terms = passes * t + self.share * (1 - t)
                before, after = np.ones_like(terms), np.ones_like(terms)
                before[..., 1:] = np.cumprod(terms[..., :-1], axis=2)
                after[..., :-1] = np.cumprod(terms[..., :0:-1], axis=2)[..., ::-1]
                inner += w * before * after
            credit = inner * (passes - self.share) * self.value[:, None] * self.real
            own = out[start : start + block]
            for d in range(depth):
                for feature in np.unique(self.feature[:, d]):
                    own[:, feature] += credit[:, self.feature[:, d] == feature, d].sum(axis=1)
        return out


def shapley_values(leaves: DataFrame, vector: Column, width: int) -> Column:
    """Array of Shapley values of a feature vector. They add up to the margin less its expectation."""
    shared = leaves.sparkSession.sparkContext.broadcast(LeafArrays(leaves, width))

    @F.arrow_udf("array<double>")
    def contributions(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in batches:
            x = batch.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), width)
            ends = pa.array((np.arange(len(batch) + 1) * width).astype(np.int32))
            yield pa.ListArray.from_arrays(ends, pa.array(own.shapley(x).ravel()))

    return contributions(vector)


def mean_split_nodes(rows: DataFrame, features: Sequence[str], label: str, digits: int = 4) -> DataFrame:
    """Trees of two levels that need no search: each pair of features is split at their (rounded) means.

    A leaf's value is the mean label of its rows, 0 without any. Two passes, for a quick baseline that tables alone explain.
    """
    pairs = [(i, i + 1) for i in range(0, len(features) - 1, 2)]
    limits = rows.agg(*[F.round(F.avg(f), digits).alias(f) for f in features]).first()
    sides = []
    for tree, (a, b) in enumerate(pairs):
        for k, (left_a, left_b) in enumerate([(True, True), (True, False), (False, True), (False, False)]):
            inside = (F.col(features[a]) <= limits[a]) == F.lit(left_a)
            inside = inside & ((F.col(features[b]) <= limits[b]) == F.lit(left_b))
            sides += [F.count_if(inside).alias(f"n{tree}_{k}"), F.avg(F.when(inside, F.col(label))).alias(f"v{tree}_{k}")]
    found = rows.agg(*sides).first()
    out: list[tuple] = []
    for tree, (a, b) in enumerate(pairs):
        n = [float(found[f"n{tree}_{k}"]) for k in range(4)]
        out.append((tree, 0, a, limits[a], 1, 2, 0.0, sum(n)))
        for side in range(2):
            out.append((tree, 1 + side, b, limits[b], 3 + 2 * side, 4 + 2 * side, 0.0, n[2 * side] + n[2 * side + 1]))
        for k in range(4):
            value = found[f"v{tree}_{k}"]
            out.append((tree, 3 + k, None, None, None, None, float(value or 0.0), n[k]))
    kind = "tree int, node int, feature int, threshold double, left int, right int, value double, cover double"
    return rows.sparkSession.createDataFrame(out, kind)

"""Isolation-style anomaly detector: random split trees over small samples, path lengths as scores."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.operators.sampling import lowest_per_group, row_hash

TREES = 350
TREE_ROWS = 256
NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, depth double"
)


def contamination(fraud_rate: float) -> float:
    """Expected anomaly share, kept between 0.0005 and 0.05, recorded with the run. It shifts raw scores only, so
    the min-max scaled score does not depend on it."""
    return min(max(fraud_rate, 0.0005), 0.05)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, long))


def grow_tree(data: np.ndarray, rng: np.random.Generator) -> pd.DataFrame:
    """Split at random features and points down to the usual depth limit."""
    limit = math.ceil(math.log2(max(len(data), 2)))
    nodes: list[list[float]] = []
    pending = [(np.arange(len(data)), 0, -1, 0)]
    while pending:
        rows, depth, parent, side = pending.pop()
        number = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = number
        part = data[rows]
        low, high = (part.min(axis=0), part.max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        useful = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(useful) == 0:
            nodes.append([-1, 0.0, -1, -1, depth + float(average_path(len(rows)))])
            continue
        feature = int(rng.choice(useful))
        threshold = float(rng.uniform(low[feature], high[feature]))
        nodes.append([feature, threshold, -1, -1, depth])
        left = part[:, feature] <= threshold
        pending.append((rows[~left], depth + 1, number, 1))
        pending.append((rows[left], depth + 1, number, 0))
    table = pd.DataFrame(nodes, columns=["feature", "threshold", "left", "right", "depth"])
    return table.astype({"feature": "int32", "left": "int32", "right": "int32"})


@dataclass
class IsolationModel:
    """Scaler, forest and score bounds. The forest has at most ``trees * 2 * rows_per_tree`` nodes, whatever the
    size of the training table, so it can be sent to every executor. The bounds are those of the rows they were
    frozen on, so a row's score does not depend on the rows it is scored with."""

    features: list[str]
    scaling: list[tuple[float, float]]
    nodes: pd.DataFrame
    rows_per_tree: int
    low: float = 0.0
    high: float = 1.0

    def raw_score(self, spark: SparkSession) -> Column:
        """Anomaly score of a row, higher for rows isolated sooner."""
        forest = [
            {name: tree[name].to_numpy() for name in ("feature", "threshold", "left", "right", "depth")}
            for _, tree in self.nodes.sort_values(["tree", "node"]).groupby("tree")
        ]
        shared = spark.sparkContext.broadcast(forest)
        typical = float(average_path(self.rows_per_tree)) or 1.0

        @F.pandas_udf("double")
        def score(vectors: pd.Series) -> pd.Series:
            data = np.array(vectors.tolist(), dtype=float).reshape(len(vectors), -1)
            total = np.zeros(len(data))
            rows = np.arange(len(data))
            for tree in shared.value:
                at = np.zeros(len(data), dtype=np.int64)
                while True:
                    feature = tree["feature"][at]
                    inner = feature >= 0
                    if not inner.any():
                        break
                    goes_left = data[rows, np.maximum(feature, 0)] <= tree["threshold"][at]
                    step = np.where(goes_left, tree["left"][at], tree["right"][at])
                    at = np.where(inner, step, at)
                total += tree["depth"][at]
            return pd.Series(2.0 ** (-(total / len(shared.value)) / typical))

        return score(scaled_array(self.features, self.scaling))

    def transform(self, df: DataFrame, output: str = "raw_score") -> DataFrame:
        return df.withColumn(output, self.raw_score(df.sparkSession))

    def freeze_bounds(self, raw: DataFrame, column: str = "raw_score") -> None:
        """Keep the least and the greatest of already computed raw scores."""
        low, high = raw.agg(F.min(column), F.max(column)).first()
        self.low, self.high = float(low or 0.0), float(high or 0.0)

    def score(self, df: DataFrame, output: str = "score") -> DataFrame:
        """Anomaly scores between the frozen bounds."""
        return scale_between(self.transform(df), self.low, self.high, "raw_score", output).drop("raw_score")

    def scaler_table(self, spark: SparkSession) -> DataFrame:
        rows = [(f, mean, std) for f, (mean, std) in zip(self.features, self.scaling, strict=True)]
        return spark.createDataFrame(rows, "feature string, mean double, std double")


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def fit_scaling(df: DataFrame, features: Sequence[str]) -> list[tuple[float, float]]:
    """Mean and population deviation per feature, from one pass; a constant feature gets 1."""
    moments = [(f"avg(`{name}`)", f"mean_{name}") for name in features]
    moments += [(f"stddev_pop(`{name}`)", f"std_{name}") for name in features]
    row = df.agg(*[F.expr(f"{moment} AS `{alias}`") for moment, alias in moments]).first()
    return [(row[f"mean_{name}"] or 0.0, row[f"std_{name}"] or 1.0) for name in features]


def scaled_columns(features: Sequence[str], scaling: Sequence[tuple[float, float]]) -> list[Column]:
    return [
        F.expr(f"(`{name}` - {mean!r}D) / {std!r}D AS `{name}`")
        for name, (mean, std) in zip(features, scaling, strict=True)
    ]


def scaled_array(features: Sequence[str], scaling: Sequence[tuple[float, float]]) -> Column:
    return F.array(*scaled_columns(features, scaling))


def standardize(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features shifted to mean 0 and scaled to deviation 1; other columns are kept."""
    columns = dict(zip(features, scaled_columns(features, fit_scaling(df, features)), strict=True))
    return df.withColumns(columns)


def fit_isolation_forest(
    negatives: DataFrame,
    features: Sequence[str] = tuple(S.FEATURES),
    trees: int = TREES,
    seed: int = 42,
    key: Sequence[str] | None = None,
    rows_per_tree: int = TREE_ROWS,
) -> IsolationModel:
    """Fit on rows of the negative class.

    Each tree takes ``rows_per_tree`` rows by its own hash of the row (256 is the algorithm's usual bound). A random
    share, about twice the rows all trees need together, is offered to the trees, so the shuffle is small and does not
    grow with the table.
    """
    features = list(features)
    scaling = fit_scaling(negatives, features)
    rows = negatives.count()
    size = min(rows_per_tree, rows)
    wanted = 2 * trees * rows_per_tree
    unit = F.shiftrightunsigned(F.xxhash64("_row", F.lit("pool")), 11) / F.lit(float(2**53))
    hashed = negatives.withColumn("_row", row_hash(negatives, seed, key)).filter(unit < wanted / max(rows, 1))
    scaled = hashed.select("_row", scaled_array(features, scaling).alias("x"))
    # A row competes for a tree only with a low hash; twice the needed rows per tree come through.
    share = min(1.0, 2.0 * rows_per_tree / max(min(rows, wanted), 1) + 0.02)

    def own_hash(tree: Column) -> Column:
        return F.xxhash64("_row", tree, F.lit(seed))

    offered = F.filter(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda tree: F.shiftrightunsigned(own_hash(tree), 11) / F.lit(float(2**53)) < share,
    )
    entries = scaled.withColumn("tree", F.explode(offered)).withColumn("place", own_hash(F.col("tree")))
    entries = lowest_per_group(entries, ["tree"], "place", size, salts=4)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        number = int(pdf["tree"].iloc[0])
        table = grow_tree(np.array(pdf["x"].tolist(), dtype=float), np.random.default_rng([seed, number]))
        table.insert(0, "node", np.arange(len(table), dtype="int32"))
        table.insert(0, "tree", np.int32(number))
        return table

    nodes = entries.select("tree", "place", "x").groupBy("tree").applyInPandas(fit, NODE_SCHEMA).toPandas()
    return IsolationModel(features, scaling, nodes, size)


def min_max_scaled(df: DataFrame, raw: str = "raw_score", output: str = "score") -> DataFrame:
    """Scale a score to 0..1 by its own minimum and maximum; a constant score becomes 0."""
    bounds = df.agg(F.min(raw).alias("low"), F.max(raw).alias("high"))
    return scale_between(df, bounds.select("low").scalar(), bounds.select("high").scalar(), raw, output)


def scale_between(
    df: DataFrame, low: Column | float, high: Column | float, raw: str = "raw_score", output: str = "score"
) -> DataFrame:
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    span = high - low
    scaled = F.least(F.greatest((F.col(raw) - low) / span, F.lit(0.0)), F.lit(1.0))
    return df.withColumn(output, F.when(span > 1e-12, scaled).otherwise(F.lit(0.0)))

"""Boosted-tree training, batch scoring and per-row drivers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegressionModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.functions import risk
from riskspark.operators import trees
from riskspark.operators.alerts import top_drivers
from riskspark.operators.boosting import BoostedTrees
from riskspark.operators.features import DEFAULT_STATS, feature_vector, scoring_features
from riskspark.operators.isolation import assemble

# Boosted-tree settings.
BOOSTING = {
    "maxIter": 450,
    "maxDepth": 4,
    "stepSize": 0.04,
    "subsamplingRate": 0.9,
    "featureSubsetStrategy": "0.9",
    "minInstancesPerNode": 2,
}


@dataclass
class ScoringModel:
    """A fitted classifier with what scoring needs: feature order, frozen statistics, threshold."""

    classifier: Model | BoostedTrees
    features: list[str] = field(default_factory=lambda: list(S.FEATURES))
    stats: Mapping[str, float] = field(default_factory=lambda: dict(DEFAULT_STATS))
    threshold: float = S.MODEL_THRESHOLD
    means: list[float] | None = None


def fit_boosted_trees(
    train: DataFrame,
    features: Sequence[str] = tuple(S.FEATURES),
    label: str = S.TARGET,
    positive_weight: float = 1.0,
    seed: int = 42,
    **settings: object,
) -> GBTClassificationModel:
    """First-order boosted trees of the ML library with weighted positives; boosting.fit_histogram_trees has second-order
    gains and L2, and is what training uses. ``settings`` override the usual ones."""
    weighted = train.select(
        F.col(label).cast("double").alias("label"),
        *features,
        F.when(F.col(label) == 1, float(positive_weight)).otherwise(1.0).alias("weight"),
    )
    options = {**BOOSTING, **settings}
    trainer = GBTClassifier(
        featuresCol="features", labelCol="label", weightCol="weight", seed=seed, **options
    )
    return trainer.fit(assemble(weighted, features).select("label", "weight", "features"))


def with_probability(
    df: DataFrame, classifier: Model | BoostedTrees, features: Sequence[str], output: str = "fraud_probability"
) -> DataFrame:
    """Add the positive-class probability; the model runs on the executors."""
    if isinstance(classifier, BoostedTrees):
        p = risk.clip_probability(classifier.probability(df.sparkSession, feature_vector(features)))
        return df.withColumn(output, p).select(*[c for c in df.columns if c != output], output)
    prepared = df if isinstance(classifier, PipelineModel) else assemble(df, features)
    scored = classifier.transform(prepared)
    p = risk.clip_probability(vector_to_array("probability")[1])
    return scored.withColumn(output, p).select(*[c for c in df.columns if c != output], output)


def score_transactions(
    df: DataFrame,
    model: ScoringModel,
    save_threshold: float = S.SAVE_THRESHOLD,
    explain: bool = False,
) -> DataFrame:
    """Raw transactions to scored ones: probability, risk, decision, thresholds, action, drivers.

    One projection chain without a shuffle, the same on batch and streaming frames.
    """
    engineered = [c for c in S.ENGINEERED_FEATURES if c not in df.columns]
    scored = with_probability(scoring_features(df, model.stats), model.classifier, model.features)
    p = F.col("fraud_probability")
    threshold = min(max(float(model.threshold), 0.0), 1.0)
    drivers = (
        row_drivers(model.classifier, model.features, df.sparkSession, model.means)
        if explain
        else F.lit([]).cast(S.DRIVERS_TYPE)
    )
    block_at = max(threshold, S.FLAG_THRESHOLD)
    decision = risk.band_of(p, block_at, min(max(float(save_threshold), 0.0), 1.0))
    return scored.withColumns(
        {
            "risk_score": F.round(p * 100.0, 2),
            "threshold": F.lit(threshold),
            "block_threshold": F.lit(block_at),
            "decision": decision,
            "recommended_action": risk.action_for(decision),
            "top_shap_features": drivers,
        }
    ).drop(*engineered)


def driver_array(contributions: Column, features: Sequence[str]) -> Column:
    """Top five drivers from an array of contributions in feature order; an empty array without one."""
    pairs = [f"named_struct('feature', '{name}', 'value', CAST(`{name}` AS double))" for name in features]
    observed = F.expr(f"array({', '.join(pairs)})")

    def driver(feature: Column, contribution: Column) -> Column:
        return F.struct(
            feature["feature"].alias("feature"),
            feature["value"].alias("feature_value"),
            feature["value"].alias("value"),
            contribution.alias("shap_value"),
            F.when(contribution >= 0, "risk_increasing").otherwise("risk_decreasing").alias("direction"),
        )

    drivers = top_drivers(F.zip_with(observed, contributions, driver))
    return F.coalesce(drivers, F.lit([]).cast(S.DRIVERS_TYPE))


def linear_drivers(
    coefficients: Sequence[float], means: Sequence[float], features: Sequence[str]
) -> Column:
    """Drivers of a linear model: coefficient times the distance from the feature's mean."""
    parts = [
        f"(`{name}` - {float(mean)!r}D) * {float(weight)!r}D"
        for name, weight, mean in zip(features, coefficients, means, strict=True)
    ]
    return driver_array(F.expr(f"array({', '.join(parts)})"), features)


def tree_contributions(
    model: GBTClassificationModel | BoostedTrees, features: Sequence[str], spark: SparkSession
) -> Column:
    """Exact Shapley values of the trees' margin. A row's values add up to its margin less the mean one."""
    nodes = model.node_table(spark) if isinstance(model, BoostedTrees) else trees.node_table(spark, model)
    return trees.shapley_values(trees.leaf_table(nodes), feature_vector(features), len(features))


def row_drivers(
    classifier: Model | BoostedTrees, features: Sequence[str], spark: SparkSession, means: Sequence[float] | None = None
) -> Column:
    """Drivers for the supported classifiers; others get an empty array, as a failed explanation."""
    if isinstance(classifier, PipelineModel):
        classifier = classifier.stages[-1]
    if isinstance(classifier, GBTClassificationModel | BoostedTrees):
        return driver_array(tree_contributions(classifier, features, spark), features)
    if isinstance(classifier, LogisticRegressionModel):
        return linear_drivers(classifier.coefficients.toArray(), means or [0.0] * len(features), features)
    return F.lit([]).cast(S.DRIVERS_TYPE)

"""Trained models on disk: saving, and loading them with the threshold that is in force."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from riskspark.operators import evaluation as E
from riskspark.operators.boosting import BoostedTrees
from riskspark.operators.isolation import IsolationModel
from riskspark.operators.models import ScoringModel
from riskspark.sources import artifacts

SETTINGS = (
    "features array<string>, amount_mean double, amount_std double, rows_per_tree int, low double, high double, "
    "contamination double"
)


def save_models(
    spark: SparkSession, path: str, model: ScoringModel, forest: IsolationModel, contamination: float
) -> None:
    """The boosted trees' nodes, the forest's nodes and scaler, and one row of settings."""
    model.classifier.node_table(spark).write.mode("overwrite").parquet(f"{path}/boosted_trees")
    forest.scaler_table(spark).write.mode("overwrite").parquet(f"{path}/forest_scaler")
    spark.createDataFrame(forest.nodes).write.mode("overwrite").parquet(f"{path}/forest_nodes")
    mean, std = float(model.stats["amount_mean"]), float(model.stats["amount_std"])
    row = (list(model.features), mean, std, forest.rows_per_tree, forest.low, forest.high, contamination)
    spark.createDataFrame([row], SETTINGS).coalesce(1).write.mode("overwrite").json(f"{path}/model_settings")


def _settings(spark: SparkSession, path: str) -> dict[str, object]:
    try:
        return spark.read.schema(SETTINGS).json(f"{path}/model_settings").first().asDict()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raise FileNotFoundError(f"no trained model at {path}") from error


def load_scoring_model(spark: SparkSession, path: str) -> ScoringModel:
    """The boosted trees with the tuned threshold, else the training run's, else the default."""
    settings = _settings(spark, path)
    tuned = artifacts.read_threshold_metrics(spark, f"{path}/threshold_metrics")
    record = artifacts.latest_record(spark, f"{path}/run_metrics/training", "training")
    threshold = E.resolve_threshold(spark, None if tuned is None else E.best_f1(tuned), record).first()["threshold"]
    stats = {"amount_mean": settings["amount_mean"], "amount_std": settings["amount_std"]}
    classifier = BoostedTrees.from_nodes(spark.read.parquet(f"{path}/boosted_trees"), settings["features"])
    return ScoringModel(classifier, list(settings["features"]), stats, threshold)


def load_forest(spark: SparkSession, path: str) -> IsolationModel:
    """The anomaly detector with its frozen score bounds."""
    settings = _settings(spark, path)
    scaler = {r["feature"]: (r["mean"], r["std"]) for r in spark.read.parquet(f"{path}/forest_scaler").collect()}
    features = list(settings["features"])
    nodes = spark.read.parquet(f"{path}/forest_nodes").toPandas()
    return IsolationModel(
        features, [scaler[f] for f in features], nodes, settings["rows_per_tree"], settings["low"], settings["high"]
    )

"""Jobs: feature building, training, tuning, evaluation and alert generation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.functions import risk
from riskspark.operators import evaluation as E
from riskspark.operators import features as X
from riskspark.operators import boosting, isolation, models, reports, sampling
from riskspark.operators.alerts import above_cutoff, assemble_alerts, conform, normalize_alerts
from riskspark.operators.oversample import oversample
from riskspark.session import shared_folder
from riskspark.sources import alerts as alert_table
from riskspark.sources import artifacts, model_store, transactions

BOOSTED, ISOLATION = "boosted_trees", "isolation_forest"


def build_features(spark: SparkSession, csv_path: str, feature_path: str, stats_path: str) -> DataFrame:
    """CSV to feature table and statistics record; returns the record."""
    raw = transactions.read_transactions_csv(spark, csv_path)
    transactions.write_features(X.model_columns(X.add_features(raw)), feature_path)
    transactions.write_stats(X.dataset_statistics(spark.read.parquet(feature_path)), stats_path)
    return transactions.read_stats(spark, stats_path)


def class_lines(stats: DataFrame) -> DataFrame:
    """The record's class counts as printable lines."""
    name = F.when(F.col("class") == "1", "fraud").otherwise("legitimate")
    line = F.format_string("Class %s (%s): %,d", F.col("class"), name, F.col("rows"))
    counts = F.explode("class_distribution").alias("class", "rows")
    return stats.select(counts).select("class", line.alias("line")).orderBy("class")


@dataclass
class Training:
    """Result of a training run."""

    boosted: models.ScoringModel
    forest: isolation.IsolationModel
    comparison: DataFrame
    best_model: str
    oversampling: dict[str, object]
    holdout: DataFrame


def labelled(scored: DataFrame, score: str) -> DataFrame:
    return scored.select(F.col(S.TARGET).cast("int").alias("label"), F.col(score).alias("score"))


def train(
    spark: SparkSession,
    features: DataFrame,
    out_path: str,
    stats: DataFrame | None = None,
    use_oversampling: bool = True,
    use_weight: bool = True,
    trees: int = isolation.TREES,
    seed: int = 42,
    **settings: object,
) -> Training:
    """Split, oversample, fit both models, compare them, and store holdout, models, metrics and record.

    Oversampling and class weight both correct the imbalance; using both is the default, either can
    be switched off.
    """
    work = shared_folder(spark, "train")
    stats = stored(X.dataset_statistics(features) if stats is None else stats, f"{work}/stats")
    train_rows, test_rows = sampling.stratified_split(features, seed=seed)
    train_rows.write.parquet(f"{work}/train")
    transactions.write_holdout(test_rows, f"{out_path}/holdout")
    train_rows = spark.read.parquet(f"{work}/train")
    holdout = transactions.read_holdout(spark, f"{out_path}/holdout")

    weight = X.class_weights(train_rows).first()["scale_pos_weight"] if use_weight else 1.0
    enlarged, info = (
        oversample(train_rows, seed=seed) if use_oversampling else (train_rows, {"enabled": False})
    )
    enlarged.write.parquet(f"{work}/enlarged")
    classifier = boosting.fit_histogram_trees(
        spark.read.parquet(f"{work}/enlarged"), positive_weight=weight, seed=seed, **settings
    )
    scored = models.with_probability(holdout, classifier, S.FEATURES, "score")
    boosted_scores = stored(labelled(scored, "score"), f"{work}/boosted_scores")
    forest = isolation.fit_isolation_forest(X.only_negatives(train_rows), trees=trees, seed=seed)
    raw = stored(labelled(forest.transform(holdout), "raw_score"), f"{work}/raw_scores")
    forest.freeze_bounds(raw, "score")
    forest_scores = isolation.scale_between(raw, forest.low, forest.high, "score", "score")

    comparison, thresholds = [], {}
    for name, rows in ((BOOSTED, boosted_scores), (ISOLATION, forest_scores)):
        thresholds[name] = E.best_by(E.threshold_sweep(rows), "f1").first()["threshold"]
        comparison.append(E.model_metrics(rows, thresholds[name], name))
    table = stored(E.model_comparison(*comparison), f"{work}/comparison")
    best = E.champion(table, [BOOSTED, ISOLATION]).first()["model"]

    share = isolation.contamination(stats.first()["fraud_rate"] or 0.0)
    info = {**info, "contamination": share}
    record = artifacts.training_record(spark, table, best, thresholds[BOOSTED], stats, info)
    artifacts.append_record(record, f"{out_path}/run_metrics/training")
    model = models.ScoringModel(
        classifier, list(S.FEATURES), transactions.frozen_stats(stats), thresholds[BOOSTED]
    )
    model_store.save_models(spark, out_path, model, forest, share)
    return Training(model, forest, table, best, info, holdout)


def stored(df: DataFrame, path: str) -> DataFrame:
    """Write a result that several later steps read, and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def tune(
    holdout: DataFrame,
    model: models.ScoringModel,
    out_path: str,
    false_positive_cost: float = S.FALSE_POSITIVE_COST,
    false_negative_cost: float = S.FALSE_NEGATIVE_COST,
) -> DataFrame:
    """Sweep the thresholds over the holdout, store the table and a tuning record, and put the best
    F1 threshold into the model. Returns the two chosen rows."""
    spark = holdout.sparkSession
    scored = labelled(models.with_probability(holdout, model.classifier, model.features, "score"), "score")
    sweep = E.threshold_sweep(
        scored, false_positive_cost=false_positive_cost, false_negative_cost=false_negative_cost
    )
    artifacts.write_threshold_metrics(sweep, f"{out_path}/threshold_metrics")
    table = artifacts.read_threshold_metrics(spark, f"{out_path}/threshold_metrics")
    chosen = E.tuning_summary(table)
    artifacts.append_record(
        artifacts.tuning_record(chosen, len(E.grid_values())), f"{out_path}/run_metrics/tuning"
    )
    model.threshold = E.best_f1(table).first()["threshold"]
    return chosen


@dataclass
class Evaluation:
    """Validation figures of a model at its threshold."""

    metrics: DataFrame
    report: DataFrame
    best_thresholds: DataFrame


def evaluate(holdout: DataFrame, model: models.ScoringModel, work: str | None = None) -> Evaluation:
    """Metrics, classification report and the ten best thresholds on the holdout."""
    scored = labelled(models.with_probability(holdout, model.classifier, model.features, "score"), "score")
    scored = stored(scored, f"{work or shared_folder(holdout.sparkSession, 'evaluate')}/scores")
    return Evaluation(
        E.model_metrics(scored, model.threshold, BOOSTED),
        E.classification_report(scored, model.threshold),
        E.top_thresholds(E.threshold_sweep(scored)),
    )


def batch_score(
    df: DataFrame, model: models.ScoringModel, save_threshold: float = S.SAVE_THRESHOLD, explain: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Scored transactions and their summary."""
    scored = models.score_transactions(df, model, save_threshold, explain)
    return scored, reports.batch_score_summary(scored)


def scored_alerts(
    raw: DataFrame,
    model: models.ScoringModel,
    alert_threshold: float,
    reason: str,
    max_alerts: int | None = None,
    explain: bool = True,
    now: datetime | None = None,
    seed: int = 42,
    work: str | None = None,
    merchants: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Replayed transactions to (scored rows, alerts), in one plan.

    With ``max_alerts`` the alerts are a banded sample, without it all rows at or above the cutoff.
    Drivers are computed for the alerts only. The sample reads the scored rows several times; a
    ``work`` folder keeps them, so that the model runs once.
    """
    cutoff = min(max(alert_threshold, 0.0), 1.0)
    source = F.when(risk.finite_or_null(F.col("Amount")).isNull(), S.AMOUNT_MISSING)
    rows = raw.withColumns(
        {
            "amount_source": source.otherwise(S.AMOUNT_FROM_CSV),
            "Amount": risk.finite(F.col("Amount")),
        }
    )
    ready, _ = X.split_complete(rows)
    events = transactions.enrich_events(ready, merchants, now, seed)
    scored = models.score_transactions(events, model, cutoff)
    if work is not None:
        scored = stored(scored, f"{work}/scored")
    if max_alerts is None:
        chosen = above_cutoff(scored, cutoff, strict=False)
    else:
        chosen = sampling.banded_sample(
            scored, max_alerts, cutoff, model.threshold, seed, key=["transaction_id"]
        ).drop("position")
    if explain:
        prepared = X.scoring_features(chosen, model.stats)
        drivers = models.row_drivers(model.classifier, model.features, raw.sparkSession, model.means)
        chosen = prepared.withColumn("top_shap_features", drivers).drop(*S.ENGINEERED_FEATURES)
    return scored, assemble_alerts(chosen, cutoff, reason, now)


def generate_alerts(
    spark: SparkSession,
    csv_path: str,
    alerts_path: str,
    model: models.ScoringModel,
    max_rows: int | None = None,
    alert_threshold: float = 0.1,
    max_alerts: int = 50,
    explain: bool = True,
    now: datetime | None = None,
    seed: int = 42,
) -> DataFrame:
    """Score the transaction table, store a banded sample of alerts, summarise.

    All rows are scored unless ``max_rows`` asks for some, whichever come first.
    """
    raw = transactions.read_transactions_csv(spark, csv_path, min_rows=0, max_rows=max_rows)
    # The rows are read by several passes: write them once, so that all see the same rows.
    work = shared_folder(spark, "generated")
    raw = stored(raw, f"{work}/rows")
    scored, alerts = scored_alerts(
        raw, model, alert_threshold, "dashboard_demo_generator", max_alerts, explain, now, seed, work
    )
    alerts = stored(conform(normalize_alerts(alerts, model.threshold, alert_threshold)), f"{work}/alerts")
    alert_table.write_alerts(alerts, alerts_path, now)
    summary = reports.generation_summary(scored, alerts, alert_threshold)
    return summary.withColumn("decision_threshold", F.lit(float(model.threshold)))


def feed_alerts(
    spark: SparkSession,
    csv_path: str,
    alerts_path: str,
    model: models.ScoringModel,
    alert_threshold: float,
    now: datetime | None = None,
    max_rows: int | None = None,
) -> int:
    """Store every transaction at or above the cutoff as an alert; returns how many."""
    text = transactions.read_text_csv(spark, csv_path)
    rows = X.coerce_csv(text if max_rows is None else text.limit(max_rows))
    _, alerts = scored_alerts(rows, model, alert_threshold, "local_demo_feeder", None, False, now)
    return alert_table.write_alerts(alerts, alerts_path, now)

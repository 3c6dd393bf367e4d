"""Registered queries over stored tables: sources, sinks and whole jobs, written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.operators import evaluation as E
from riskspark.operators import models
from riskspark.operators.alerts import json_documents
from riskspark.plans import jobs, views
from riskspark.plans.alert_queries import ALERTS, NOW
from riskspark.plans.model_queries import _ENGINEERED, _ROUNDED_V, _SWEEP, _SWEEP_COLUMNS, CARDS, SCORED, _score
from riskspark.plans.registry import comparable, query
from riskspark.session import shared_folder
from riskspark.sources import alerts as alert_table
from riskspark.sources import artifacts, messages, model_store, transactions
from riskspark.streaming import alerts as streaming


def _card_csv(spark: SparkSession, sf_dir: str) -> str:
    path = shared_folder(spark, "csv")
    views.card_rows(spark, sf_dir).select(*S.RAW_COLUMNS).write.option("header", True).csv(path)
    return path


@query(
    CARDS
    + """
SELECT "Time", round(V1, 6) AS V1, round(V28, 6) AS V28, round("Amount", 6) AS "Amount", "Class" FROM cards"""
)
def csv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transactions.read_transactions_csv(spark, _card_csv(spark, sf_dir))
    return comparable(rows.select("Time", "V1", "V28", "Amount", "Class"))


@query(
    CARDS
    + ', s AS (SELECT avg("Amount") AS mean, stddev_pop("Amount") AS std FROM cards) '
    + f'SELECT "Time", {_ROUNDED_V}, "Amount", {_ENGINEERED.format(mean="mean", std="std")}, "Class" FROM cards, s'
)
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature job: CSV in, feature and statistics tables out."""
    work = shared_folder(spark, "features")

    def build() -> None:
        jobs.build_features(spark, _card_csv(spark, sf_dir), f"{work}/features", f"{work}/stats")

    return comparable(transactions.read_features(spark, f"{work}/features", build))


@query(
    CARDS
    + """
SELECT '0' AS "class", format('Class 0 (legitimate): {:,}', count(*) FILTER ("Class" = 0)) AS line FROM cards
UNION ALL SELECT '1', format('Class 1 (fraud): {:,}', count(*) FILTER ("Class" = 1)) FROM cards"""
)
def class_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = shared_folder(spark, "features")
    record = jobs.build_features(spark, _card_csv(spark, sf_dir), f"{work}/features", f"{work}/stats")
    return jobs.class_lines(record)


@query(
    ALERTS
    + """
SELECT transaction_id, merchant_name, round(amount, 6) AS "Amount", round(p, 6) AS fraud_probability, decision,
       epoch_us(stored_at) AS stored_at_utc, strftime(stored_at, '%Y-%m-%d') AS stored_day,
       count(*) OVER () AS written
FROM alerts"""
)
def alert_table_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "alerts")
    written = alert_table.write_alerts(views.alert_documents(spark, sf_dir), path, NOW)
    moment = F.to_utc_timestamp("stored_at_utc", F.current_timezone())
    rows = alert_table.read_alerts(spark, path).withColumns(
        {"stored_day": F.date_format(moment, "yyyy-MM-dd"), "written": F.lit(written).cast("long")}
    )
    columns = ["transaction_id", "merchant_name", "Amount", "fraud_probability", "decision"]
    return comparable(rows.select(*columns, "stored_at_utc", "stored_day", "written"))


@query("SELECT count(*) AS removed, 0::BIGINT AS remaining FROM events")
def cleared_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "alerts")
    alert_table.write_alerts(views.alert_documents(spark, sf_dir), path, NOW)
    removed = alert_table.clear_alerts(spark, path)
    left = alert_table.read_alerts(spark, path)
    return left.agg(F.lit(removed).cast("long").alias("removed"), F.count("*").alias("remaining"))


@query(
    ALERTS
    + """
SELECT transaction_id, merchant_name, round(p, 6) AS fraud_probability, decision,
       strftime(stored_at, '%Y-%m-%d %H:%M:%S UTC') AS stored_at_utc
FROM alerts"""
)
def exported_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "export")
    alert_table.export_alerts_csv(views.alerts(spark, sf_dir), path)
    rows = spark.read.option("header", True).csv(path)
    p = F.col("fraud_probability").cast("double").alias("fraud_probability")
    return comparable(rows.select("transaction_id", "merchant_name", p, "decision", "stored_at_utc"))


@query(SCORED + _SWEEP + _SWEEP_COLUMNS)
def threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "thresholds")
    artifacts.write_threshold_metrics(E.threshold_sweep(views.scored_events(spark, sf_dir)), path)
    return comparable(artifacts.read_threshold_metrics(spark, path))


@query(
    SCORED
    + _SWEEP
    + """
, f AS (SELECT * FROM sweep ORDER BY f DESC, c DESC, p DESC, t LIMIT 1),
k AS (SELECT * FROM sweep ORDER BY business_cost, false_negatives, false_positives, t LIMIT 1)
SELECT f.threshold, k.threshold AS cost_threshold, k.business_cost, CAST(109 AS BIGINT) AS threshold_grid_size
FROM f, k"""
)
def tuning_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "records")
    chosen = E.tuning_summary(E.threshold_sweep(views.scored_events(spark, sf_dir)))
    artifacts.append_record(artifacts.tuning_record(chosen, len(E.grid_values())), path)
    latest = artifacts.latest_record(spark, path, "tuning")
    cost = F.col("choices")["best_business_cost_threshold"]
    return comparable(
        latest.select(
            "threshold",
            cost["threshold"].alias("cost_threshold"),
            cost["business_cost"].alias("business_cost"),
            "threshold_grid_size",
        )
    )


@query(
    ALERTS
    + """
SELECT transaction_id, 'd' || (event_id % 7) AS device, CASE WHEN event_id % 3 <> 0 THEN round(p, 6) END AS second_reading,
  CASE WHEN event_id % 2 = 0 THEN 'kept' END AS note, round(amount, 6) AS amount, CASE WHEN event_id % 2 = 0 THEN 'again' END AS later, false AS has_nan
FROM alerts"""
)
def open_alert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with fields that the schema does not have, nested and with NaN in them: stored, read, added to and stored
    again, read, and exported as JSON documents."""
    documents = views.alert_documents(spark, sf_dir).withColumn("n", F.regexp_extract("transaction_id", "[0-9]+", 0).cast("long"))
    p = F.col("fraud_probability")
    reading = F.struct(p.alias("first"), F.when(F.col("n") % 3 == 0, float("nan")).otherwise(p).alias("second"))
    meta = F.struct(F.concat(F.lit("d"), F.col("n") % 7).alias("device"), F.array(reading).alias("readings"))
    open_documents = documents.withColumns({"meta": meta, "note": F.when(F.col("n") % 2 == 0, "kept")}).drop("n")
    once, twice = shared_folder(spark, "alerts"), shared_folder(spark, "alerts")
    alert_table.write_alerts(open_documents, once, NOW)
    stored = alert_table.read_alerts(spark, once)
    note = F.try_variant_get(S.MORE, "$.note", "string")
    alert_table.write_alerts(stored.withColumn("later", F.when(note == "kept", "again")), twice, NOW)
    out = json_documents(alert_table.read_alerts(spark, twice))

    # Each document is parsed once for all of its fields.
    shape = "Amount double, note string, later string, meta struct<device: string, readings: array<struct<second: double>>>"
    read = out.withColumn("d", F.from_json("document", shape))
    return comparable(
        read.select(
            "transaction_id",
            F.col("d.meta.device").alias("device"),
            F.get(F.col("d.meta.readings"), F.lit(0))["second"].alias("second_reading"),
            F.col("d.note").alias("note"),
            F.col("d.Amount").alias("amount"),
            F.col("d.later").alias("later"),
            F.contains("document", F.lit("NaN")).alias("has_nan"),
        )
    )


@query()
def boosted_tree_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five greatest Shapley values of every card row, by the stored model."""
    path, _ = _trained(spark, sf_dir)
    model = model_store.load_scoring_model(spark, path)
    scored = models.score_transactions(views.card_rows(spark, sf_dir), model, explain=True)
    return comparable(scored.select("vec_id", F.inline("top_shap_features")))


_runs: dict[tuple[str, str], tuple[str, jobs.Training]] = {}


def _trained(spark: SparkSession, sf_dir: str) -> tuple[str, jobs.Training]:
    """The training job on the card rows with its own settings, tuned and stored; one run serves a session's queries."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _runs:
        try:
            model_store.load_scoring_model(spark, _runs[key][0])
        except FileNotFoundError:  # the work folder was emptied
            del _runs[key]
    if key not in _runs:
        work = shared_folder(spark, "training")
        jobs.build_features(spark, _card_csv(spark, sf_dir), f"{work}/features", f"{work}/stats")
        features = transactions.read_features(spark, f"{work}/features")
        features = features.withColumn(S.TARGET, F.col(S.TARGET).cast("int"))
        run = jobs.train(spark, features, f"{work}/out", transactions.read_stats(spark, f"{work}/stats"))
        jobs.tune(run.holdout, run.boosted, f"{work}/out")
        _runs[key] = (f"{work}/out", run)
    return _runs[key]


@query()
def training_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole training job on the card rows: both models' metrics."""
    return comparable(_trained(spark, sf_dir)[1].comparison)


@query()
def stored_model_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics on the stored holdout of the model that was trained, tuned, stored and loaded."""
    path, _ = _trained(spark, sf_dir)
    holdout = transactions.read_holdout(spark, f"{path}/holdout")
    return comparable(jobs.evaluate(holdout, model_store.load_scoring_model(spark, path)).metrics)


@query()
def generated_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A banded sample of alerts from the CSV table, scored by the loaded model, stored and read back."""
    path, _ = _trained(spark, sf_dir)
    made = shared_folder(spark, "generated")
    model = model_store.load_scoring_model(spark, path)
    jobs.generate_alerts(spark, _card_csv(spark, sf_dir), made, model, alert_threshold=0.1, max_alerts=30, now=NOW)
    rows = alert_table.read_alerts(spark, made)
    columns = ["merchant_name", "Amount", "fraud_probability", "risk_score", "decision", "hour_of_day", "actual_class"]
    return comparable(rows.select(*columns, F.size("top_shap_features").alias("drivers")))


def _streamed(spark: SparkSession, sf_dir: str, scorer) -> str:
    """All card rows as messages in two halves, drained by a stream that is started anew for the second, and its last batch
    offered a second time, as after a crash before it was committed; returns the alert table's folder."""
    work = shared_folder(spark, "model-stream")
    rows = views.card_rows(spark, sf_dir)
    for half in (0, 1):
        part = messages.transaction_messages(rows.filter(F.col("vec_id") % 2 == half)).select("value")
        messages.publish_text(part, f"{work}/messages")
        stream = messages.text_stream(spark, f"{work}/messages")
        places = (f"{work}/alerts", f"{work}/quarantine", f"{work}/checkpoint", "cards")
        streaming.start_alert_stream(stream, scorer(), *places, trigger=None).awaitTermination()
    again = streaming.parse_messages(part)
    last = streaming.read_batch_figures(spark, f"{work}/alerts").agg(F.max("batch_id")).first()[0]
    streaming.write_batch(again, last, scorer(), f"{work}/alerts", f"{work}/quarantine", "cards")
    return f"{work}/alerts"


@query()
def stream_alerts_by_loaded_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a stream scored by the stored model, loaded at each start, over a restart and a replayed batch."""
    path, _ = _trained(spark, sf_dir)
    alerts = _streamed(spark, sf_dir, lambda: streaming.model_scorer(model_store.load_scoring_model(spark, path)))
    columns = ["Time", "Amount", "fraud_probability", "risk_score", "decision", "actual_class", "hour_of_day"]
    return comparable(streaming.read_stream_alerts(spark, alerts).select(*columns))


@query(
    CARDS
    + """
, s AS (SELECT least(greatest(V1 - V2 + 0.5::DOUBLE, 0), 1) AS p, vec_id % 2 AS half FROM cards)
SELECT count(DISTINCT half) AS batches, count(*) AS rows, count(*) AS scored, count(*) FILTER (p > 0.5) AS flagged, 0::BIGINT AS rejected,
  round(max(p), 6) AS max_probability, round(sum(p) / count(*), 6) AS avg_probability
FROM s"""
)
def stream_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of all micro-batches of such a stream, scored by what SQL can state, added up."""
    figures = streaming.read_batch_figures(spark, _streamed(spark, sf_dir, lambda: _score))
    added = [F.sum(c).alias(c) for c in ("rows", "scored", "flagged", "rejected")]
    mean = F.sum(F.col("avg_probability") * F.col("scored")) / F.sum("scored")
    return comparable(
        figures.agg(F.count("*").alias("batches"), *added, F.max("max_probability").alias("max_probability"), mean.alias("avg_probability"))
    )

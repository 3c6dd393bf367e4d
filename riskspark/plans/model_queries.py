"""Registered queries over features, evaluation, samples, models and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.functions import risk
from riskspark.operators import evaluation as E
from riskspark.operators import features as X
from riskspark.operators import boosting, isolation, models, ranks, reports, sampling, trees
from riskspark.operators.alerts import normalize_alerts
from riskspark.operators.features import feature_vector
from riskspark.operators.neighbours import nearest_neighbours
from riskspark.operators.oversample import oversample
from riskspark.plans import views
from riskspark.plans.alert_queries import _HOURLY, ALERTS
from riskspark.plans.registry import comparable, query
from riskspark.session import shared_folder
from riskspark.sources import messages
from riskspark.streaming import alerts as streaming

_V = [f"V{i}" for i in range(1, 29)]
_V_SQL = ", ".join(f"embedding[{i}]::DOUBLE AS V{i}" for i in range(1, 29))

# The rows of views.card_rows in SQL.
CARDS = f"""
WITH cards AS (
  SELECT vec_id, (vec_id * 97)::DOUBLE AS "Time", {_V_SQL},
         round(abs(embedding[29]::DOUBLE) * 400, 2) AS "Amount",
         CASE WHEN label = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS "Class"
  FROM embeddings)
"""

_ENGINEERED = """
 round(ln(1 + greatest("Amount", 0)), 6) AS amount_log,
 floor(("Time" % 86400) / 3600)::DOUBLE AS hour_of_day,
 CASE WHEN floor(("Time" % 86400) / 3600) >= 22 OR floor(("Time" % 86400) / 3600) < 6
      THEN 1 ELSE 0 END::DOUBLE AS is_night_transaction,
 round(("Amount" - {mean}) / {std}, 6) AS amount_zscore
"""
_ROUNDED_V = ", ".join(f"round(V{i}, 6) AS V{i}" for i in range(1, 29))


@query(
    CARDS
    + f', s AS (SELECT avg("Amount") AS mean, stddev_pop("Amount") AS std FROM cards) '
    + f'SELECT "Time", {_ROUNDED_V}, "Amount", {_ENGINEERED.format(mean="mean", std="std")}, "Class" FROM cards, s'
)
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(X.model_columns(X.add_features(views.card_rows(spark, sf_dir))))


@query(
    CARDS
    + f'SELECT vec_id, {_ENGINEERED.format(mean="20::DOUBLE", std="40::DOUBLE")} FROM cards'
)
def scoring_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.scoring_features(views.card_rows(spark, sf_dir), {"amount_mean": 20.0, "amount_std": 40.0})
    return comparable(rows.select("vec_id", *S.ENGINEERED_FEATURES))


_EVENT_TIME = "(epoch_us(ts) / 1000000.0::DOUBLE - 1704067200)"


@query(
    f"""
WITH t AS (SELECT event_id, {_EVENT_TIME} AS "Time", value AS "Amount" FROM events),
s AS (SELECT avg("Amount") AS mean, stddev_pop("Amount") AS std FROM t)
SELECT event_id, {_ENGINEERED.format(mean="mean", std="std")} FROM t, s"""
)
def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = X.add_features(views.event_transactions(spark, sf_dir))
    return comparable(rows.select("event_id", *S.ENGINEERED_FEATURES))


@query(
    """
WITH t AS (SELECT value AS a, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS c FROM events)
SELECT count(*) AS row_count, count(*) FILTER (c = 1) AS fraud_count, count(*) FILTER (c = 0) AS non_fraud_count,
       count(*) FILTER (c = 1) AS map_1, count(*) FILTER (c = 0) AS map_0,
       round(count(*) FILTER (c = 1) / count(*)::DOUBLE, 6) AS fraud_rate, round(avg(a), 6) AS amount_mean,
       round(stddev_pop(a), 6) AS amount_std, round(min(a), 6) AS amount_min, round(avg(a), 6) AS amount_avg,
       round(median(a), 6) AS amount_median, round(max(a), 6) AS amount_max, CAST(34 AS BIGINT) AS features
FROM t"""
)
def feature_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = X.dataset_statistics(views.event_transactions(spark, sf_dir))
    parts = {
        "map_0": F.col("class_distribution")["0"],
        "map_1": F.col("class_distribution")["1"],
        "features": F.size("feature_columns"),
    }
    return comparable(
        stats.withColumns(parts).drop("class_distribution", "feature_columns", "generated_at_utc")
    )


@query(
    """
SELECT CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS BIGINT) AS "Class", count(*) AS "count"
FROM lineitem GROUP BY 1"""
)
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.scored_lines(spark, sf_dir).withColumnRenamed("label", S.TARGET)
    return comparable(X.class_distribution(rows))


@query(
    """
SELECT count(*) FILTER (l_returnflag = 'R') AS positive_count, count(*) FILTER (l_returnflag <> 'R') AS negative_count,
       round(count(*) FILTER (l_returnflag <> 'R') / greatest(count(*) FILTER (l_returnflag = 'R'), 1)::DOUBLE, 6)
         AS scale_pos_weight
FROM lineitem"""
)
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.scored_lines(spark, sf_dir).withColumnRenamed("label", S.TARGET)
    return comparable(X.class_weights(rows))


@query(CARDS + 'SELECT vec_id FROM cards WHERE "Class" = 0')
def only_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.only_negatives(views.card_rows(spark, sf_dir)).select("vec_id")


def _text_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Card rows as CSV text, with gaps: some amounts unreadable, some fields blank or bad."""
    rows = views.card_rows(spark, sf_dir)
    n = F.col("vec_id")
    amount = F.col("Amount").cast("string")
    broken = {
        "Amount": F.when(n % 5 == 0, "").when(n % 5 == 1, "n/a").when(n % 5 == 2, "NaN").otherwise(amount),
        "V3": F.when(n % 7 == 0, "").otherwise(F.col("V3").cast("string")),
        "V9": F.when(n % 7 == 1, "NaN").otherwise(F.col("V9").cast("string")),
        "Class": F.when(n % 7 == 2, "").otherwise(F.col("Class").cast("string")),
    }
    plain = {c: F.expr(f"CAST(`{c}` AS string)") for c in S.RAW_COLUMNS if c not in broken}
    return rows.select(*[{**plain, **broken}[c].alias(c) for c in S.RAW_COLUMNS])


@query(
    CARDS
    + """
SELECT "Time", round(CASE WHEN vec_id % 5 <= 2 THEN 0 ELSE "Amount" END, 6) AS "Amount",
       CASE WHEN vec_id % 7 <> 2 THEN CAST("Class" AS BIGINT) END AS "Class",
       CASE WHEN vec_id % 5 <= 2 THEN 'fallback_missing_amount' ELSE 'raw_creditcard_csv' END AS amount_source
FROM cards WHERE vec_id % 7 > 1"""
)
def coerced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready, _ = X.split_complete(X.coerce_csv(_text_rows(spark, sf_dir)))
    return comparable(ready.select("Time", "Amount", "Class", "amount_source"))


@query(
    CARDS
    + """
SELECT "Time", CASE vec_id % 7 WHEN 0 THEN 'V3' ELSE 'V9' END AS missing FROM cards WHERE vec_id % 7 <= 1"""
)
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rejected = X.split_complete(X.coerce_csv(_text_rows(spark, sf_dir)))
    return comparable(rejected.select("Time", F.array_join("missing_fields", ",").alias("missing")))


# Scored rows in SQL: views.scored_events and views.scored_lines.
SCORED = """
WITH scored AS (
  SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
         CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 99 AS score
  FROM events)
"""
LINE_SCORED = """
WITH scored AS (
  SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label, (l_extendedprice % 1000) / 1000 AS score
  FROM lineitem)
"""
_GRID = """
, grid AS (
  SELECT 0.01::DOUBLE + i * (0.89::DOUBLE / 89) AS t FROM range(90) r(i)
  UNION SELECT 0.91::DOUBLE + i * (0.08::DOUBLE / 9) FROM range(10) r(i)
  UNION SELECT 0.991::DOUBLE + i * (0.008::DOUBLE / 8) FROM range(9) r(i))
"""
_SWEEP = (
    _GRID
    + """
, counts AS (
  SELECT t, count(*) FILTER (label = 0 AND score < t) AS tn, count(*) FILTER (label = 0 AND score >= t) AS fp,
         count(*) FILTER (label = 1 AND score < t) AS fn, count(*) FILTER (label = 1 AND score >= t) AS tp
  FROM grid, (SELECT label, score FROM scored) GROUP BY t),
r AS (
  SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS c
  FROM counts),
sweep AS (
  SELECT round(t, 6) AS threshold, round(p, 6) AS precision, round(c, 6) AS recall,
         round(coalesce(2 * p * c / nullif(p + c, 0), 0), 6) AS f1, tn AS true_negatives, fp AS false_positives,
         fn AS false_negatives, tp AS true_positives, tp + fp AS predicted_fraud_count,
         1::DOUBLE AS false_positive_cost, 20::DOUBLE AS false_negative_cost, (fp + fn * 20)::DOUBLE AS business_cost,
         coalesce(2 * p * c / nullif(p + c, 0), 0) AS f, p, c, t
  FROM r)
"""
)
_SWEEP_COLUMNS = (
    "SELECT threshold, precision, recall, f1, true_negatives, false_positives, false_negatives, true_positives, "
    "predicted_fraud_count, false_positive_cost, false_negative_cost, business_cost FROM sweep "
)


@query(SCORED + _SWEEP + _SWEEP_COLUMNS)
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(E.threshold_sweep(views.scored_events(spark, sf_dir)))


# Scores that are null or NaN lie below every threshold.
GAP_SCORED = """
WITH scored AS (
  SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
         CASE WHEN event_id % 7 <= 1 THEN -1 ELSE CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 99 END AS score
  FROM events)
"""


@query(GAP_SCORED + _SWEEP + _SWEEP_COLUMNS)
def threshold_sweep_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(E.threshold_sweep(views.scored_events_with_gaps(spark, sf_dir)))


@query(LINE_SCORED + _SWEEP + _SWEEP_COLUMNS)
def threshold_sweep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(E.threshold_sweep(views.scored_lines(spark, sf_dir)))


@query(SCORED + _SWEEP + _SWEEP_COLUMNS + "ORDER BY f DESC, c DESC, p DESC, t LIMIT 1")
def best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(E.best_f1(E.threshold_sweep(views.scored_events(spark, sf_dir))))


@query(SCORED + _SWEEP + _SWEEP_COLUMNS + "ORDER BY business_cost, false_negatives, false_positives, t LIMIT 1")
def best_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(E.best_cost(E.threshold_sweep(views.scored_events(spark, sf_dir))))


@query(SCORED + _SWEEP + _SWEEP_COLUMNS + "ORDER BY p DESC, t LIMIT 1")
def best_by_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(E.best_by(E.threshold_sweep(views.scored_events(spark, sf_dir)), "precision"))


@query(LINE_SCORED + _SWEEP + _SWEEP_COLUMNS + "ORDER BY f DESC, t LIMIT 10")
def top_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(E.top_thresholds(E.threshold_sweep(views.scored_lines(spark, sf_dir))))


_CONFUSION = """
, k AS (
  SELECT count(*) FILTER (label = 0 AND score < 0.5) AS tn, count(*) FILTER (label = 0 AND score >= 0.5) AS fp,
         count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 1 AND score >= 0.5) AS tp
  FROM scored),
m AS (SELECT *, tp / (tp + fp)::DOUBLE AS p1, tp / (tp + fn)::DOUBLE AS r1,
             tn / (tn + fn)::DOUBLE AS p0, tn / (tn + fp)::DOUBLE AS r0 FROM k)
"""


_CONFUSION_COLUMNS = """
SELECT tn AS true_negatives, fp AS false_positives, fn AS false_negatives, tp AS true_positives,
       tp + fn AS fraud_cases, tp + fn + fp + tn AS validation_rows, round(p1, 6) AS precision,
       round(r1, 6) AS recall, round(2 * p1 * r1 / (p1 + r1), 6) AS f1, tp + fp AS predicted_fraud_count,
       0.5::DOUBLE AS threshold
FROM m"""


@query(SCORED + _CONFUSION + _CONFUSION_COLUMNS)
def confusion_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(E.confusion_at(views.scored_events(spark, sf_dir), 0.5))


@query(GAP_SCORED + _CONFUSION + _CONFUSION_COLUMNS)
def confusion_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(E.confusion_at(views.scored_events_with_gaps(spark, sf_dir), 0.5))


_REPORT = """
, f AS (SELECT *, 2 * p1 * r1 / (p1 + r1) AS f1, 2 * p0 * r0 / (p0 + r0) AS f0, tn + fp AS n0, tp + fn AS n1 FROM m)
SELECT '0' AS label, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, n0 AS support FROM f
UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), n1 FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round((tn + tp) / (n0 + n1)::DOUBLE, 6), n0 + n1 FROM f
UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n0 + n1
  FROM f
UNION ALL SELECT 'weighted avg', round((p0 * n0 + p1 * n1) / (n0 + n1), 6),
  round((r0 * n0 + r1 * n1) / (n0 + n1), 6), round((f0 * n0 + f1 * n1) / (n0 + n1), 6), n0 + n1 FROM f"""


@query(GAP_SCORED + _CONFUSION + _REPORT)
def classification_report_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(E.classification_report(views.scored_events_with_gaps(spark, sf_dir), 0.5))


@query(SCORED + _CONFUSION + _REPORT)
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(E.classification_report(views.scored_events(spark, sf_dir), 0.5))


_CURVE = """
, g AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY 1),
curve AS (
  SELECT score, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM g
  WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
total AS (SELECT sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS n FROM g)
"""
_AUC = "round(sum(neg::DOUBLE * (tp - pos / 2.0::DOUBLE)) / (max(p) * max(n)), 6) AS auc"
_AP = "round(sum(pos * tp::DOUBLE / (tp + fp)) / max(p), 6) AS auprc"


@query(SCORED + _CURVE + f"SELECT {_AUC} FROM curve, total")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(E.roc_auc(views.scored_events(spark, sf_dir)))


@query(SCORED + _CURVE + f"SELECT {_AP} FROM curve, total")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(E.average_precision(views.scored_events(spark, sf_dir)))


@query(LINE_SCORED + _CURVE + f"SELECT {_AUC}, {_AP} FROM curve, total")
def ranking_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(E.ranking_quality(E.score_counts(views.scored_lines(spark, sf_dir))))


@query(LINE_SCORED + _CURVE + f"SELECT {_AUC}, {_AP} FROM curve, total")
def ranking_quality_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same figures forced through many score ranges, as a large table takes them."""
    counted = E.score_counts(views.scored_lines(spark, sf_dir), rows_per_range=2_000)
    return comparable(E.ranking_quality(counted))


@query(
    SCORED
    + _CURVE
    + """
SELECT round(score, 6) AS threshold, round(fp / n, 6) AS false_positive_rate, round(tp / p, 6) AS true_positive_rate
FROM curve, total"""
)
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(E.roc_curve(views.scored_events(spark, sf_dir)))


@query(
    LINE_SCORED
    + _CURVE
    + """
SELECT round(score, 6) AS threshold, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / p, 6) AS recall
FROM curve, total"""
)
def precision_recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(E.precision_recall_curve(views.scored_lines(spark, sf_dir)))


_PER_FLAG = """
WITH k AS (
  SELECT l_returnflag AS model, count(*) FILTER (l_linestatus = 'F' AND l_tax < 0.04) AS true_negatives,
         count(*) FILTER (l_linestatus = 'F' AND l_tax >= 0.04) AS false_positives,
         count(*) FILTER (l_linestatus <> 'F' AND l_tax < 0.04) AS false_negatives,
         count(*) FILTER (l_linestatus <> 'F' AND l_tax >= 0.04) AS true_positives
  FROM lineitem GROUP BY 1),
m AS (
  SELECT *, true_positives / nullif(true_positives + false_positives, 0)::DOUBLE AS p,
         true_positives / nullif(true_positives + false_negatives, 0)::DOUBLE AS r FROM k),
metrics AS (
  SELECT model, true_negatives, false_positives, false_negatives, true_positives, coalesce(p, 0) AS p,
         coalesce(r, 0) AS r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM m)
"""


def _counts_per_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = views.table(spark, sf_dir, "lineitem")
    legit, low = F.col("l_linestatus") == "F", F.col("l_tax") < 0.04
    return lines.groupBy(F.col("l_returnflag").alias("model")).agg(
        F.count_if(legit & low).alias("true_negatives"),
        F.count_if(legit & ~low).alias("false_positives"),
        F.count_if(~legit & low).alias("false_negatives"),
        F.count_if(~legit & ~low).alias("true_positives"),
    )


@query(
    _PER_FLAG
    + """
SELECT model, true_negatives, false_positives, false_negatives, true_positives, round(p, 6) AS precision,
       round(r, 6) AS recall, round(f, 6) AS f1, true_positives + false_positives AS predicted_fraud_count
FROM metrics"""
)
def metrics_from_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(E.metrics_from_counts(_counts_per_flag(spark, sf_dir)))


@query(
    _PER_FLAG
    + """
SELECT model, true_negatives, false_positives, false_negatives, true_positives,
       [[true_negatives, false_positives], [false_negatives, true_positives]]::VARCHAR AS matrix, TRUE AS complete
FROM metrics"""
)
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.confusion_matrix(_counts_per_flag(spark, sf_dir))
    lines = F.transform("matrix", lambda line: F.concat(F.lit("["), F.array_join(line.cast("array<string>"), ", "), F.lit("]")))
    shown = F.concat(F.lit("["), F.array_join(lines, ", "), F.lit("]"))
    return comparable(rows.withColumns({"matrix": shown, "complete": E.has_all_counts(rows)}))


@query(
    _PER_FLAG
    + """
SELECT model, 0.4::DOUBLE AS threshold,
       CASE WHEN model = 'N' THEN NULL ELSE round(p, 6) END AS precision,
       CASE WHEN model = 'N' THEN NULL ELSE true_positives END AS true_positives, 0.25::DOUBLE AS auc,
       CASE WHEN model = 'N' THEN 'stored_training_artifact' ELSE 'active_threshold_recomputed' END AS metric_source
FROM metrics"""
)
def active_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts_per_flag(spark, sf_dir)
    empty = {"precision": F.lit(None).cast("double"), "true_positives": F.lit(None).cast("bigint")}
    stored = counts.select("model").withColumns({**empty, "auc": F.lit(0.25)})
    fresh = E.metrics_from_counts(counts).filter("model <> 'N'")
    merged = E.active_metrics(stored, fresh, 0.4)
    return comparable(merged.select("model", "threshold", "precision", "true_positives", "auc", "metric_source"))


@query(
    SCORED
    + _SWEEP
    + """
, chosen AS (SELECT * FROM sweep ORDER BY f DESC, c DESC, p DESC, t LIMIT 1)
SELECT threshold, precision, recall, f1, true_positives, 'best_f1_threshold_summary' AS metric_source FROM chosen"""
)
def metrics_near_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    sweep = E.threshold_sweep(views.scored_events(spark, sf_dir))
    wanted = E.best_f1(sweep).first()["threshold"]
    found = E.metrics_near_threshold(E.tuning_summary(sweep), wanted)
    return comparable(found.select("threshold", "precision", "recall", "f1", "true_positives", "metric_source"))


def _metrics_sql(model: str) -> str:
    return f"""
SELECT '{model}' AS model, (SELECT {_AUC} FROM curve, total) AS auc, (SELECT {_AP} FROM curve, total) AS auprc"""


@query(
    "SELECT * FROM ("
    + SCORED
    + _CURVE
    + _metrics_sql("events")
    + ") UNION ALL SELECT * FROM ("
    + LINE_SCORED
    + _CURVE
    + _metrics_sql("lines")
    + ")"
)
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = E.model_metrics(views.scored_events(spark, sf_dir), 0.5, "events")
    lines = E.model_metrics(views.scored_lines(spark, sf_dir), 0.5, "lines")
    return comparable(E.model_comparison(events, lines).select("model", "auc", "auprc"))


@query(
    "SELECT model FROM (SELECT * FROM ("
    + SCORED
    + _CURVE
    + _metrics_sql("events")
    + ") UNION ALL SELECT * FROM ("
    + LINE_SCORED
    + _CURVE
    + _metrics_sql("lines")
    + ")) ORDER BY auprc DESC LIMIT 1"
)
def champion_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = E.model_metrics(views.scored_events(spark, sf_dir), 0.5, "events")
    lines = E.model_metrics(views.scored_lines(spark, sf_dir), 0.5, "lines")
    return E.champion(E.model_comparison(events, lines), ["events", "lines"]).select("model")


@query(SCORED + _SWEEP + "SELECT threshold FROM sweep ORDER BY f DESC, c DESC, p DESC, t LIMIT 1")
def resolve_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned = E.best_f1(E.threshold_sweep(views.scored_events(spark, sf_dir)))
    return comparable(E.resolve_threshold(spark, tuned))


# Samples and splits.


@query(
    ALERTS
    + """
, b AS (SELECT *, count(*) FILTER (amount > 1) OVER (PARTITION BY decision) AS large FROM alerts
        WHERE decision <> 'APPROVED'),
c AS (SELECT decision, quantile_cont(amount, 0.33) AS low, quantile_cont(amount, 0.66) AS high
      FROM b WHERE large < 3 OR amount > 1 GROUP BY 1)
SELECT b.decision, CAST(CASE WHEN large >= 3 AND amount <= 1 THEN NULL WHEN amount <= low THEN 0
                             WHEN amount <= high THEN 1 ELSE 2 END AS BIGINT) AS pool, count(*) AS alert_count
FROM b JOIN c ON b.decision = c.decision GROUP BY 1, 2"""
)
def amount_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.alerts(spark, sf_dir).filter(F.col("decision") != S.APPROVED)
    pools = sampling.amount_pools(rows, "decision", "Amount")
    return comparable(pools.groupBy("decision", "pool").agg(F.count("*").alias("alert_count")))


@query(
    ALERTS
    + """
, n AS (SELECT 40 AS m)
SELECT 'REVIEW' AS decision, CAST(round_even(m * 0.35, 0) AS BIGINT) AS alert_count FROM n
UNION ALL SELECT 'FLAGGED', CAST(round_even(m * 0.30, 0) AS BIGINT) FROM n
UNION ALL SELECT 'BLOCKED', CAST(m - round_even(m * 0.65, 0) AS BIGINT) FROM n"""
)
def banded_sample_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = _banded(spark, sf_dir)
    return sample.groupBy("decision").agg(F.count("*").alias("alert_count"))


def _banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.alerts(spark, sf_dir)
    return sampling.banded_sample(rows, 40, 0.1, views.MODEL_THRESHOLD, key=["transaction_id"])


def _quota_sql(quotas: list[int], total: int) -> str:
    """The quota rules over pooled (transaction_id, p, amount, decision, band, pool, large, saved, h), step by step."""
    own = "transaction_id, p, amount, decision, band, pool, large, saved, h, r"
    steps = ["t0 AS (SELECT *, row_number() OVER (PARTITION BY band, pool ORDER BY h) AS r, false AS taken FROM pooled)"]
    for b, quota in enumerate(quotas, start=1):
        counts = ", ".join(f"count(*) FILTER (band = {b} AND pool = {k}) OVER () AS n{k}" for k in range(3))
        inside = " OR ".join(f"(pool = {k} AND r <= k{k})" for k in range(3))
        steps += [
            f"l{b} AS (SELECT *, least({quota}, {total} - count(*) FILTER (taken) OVER ()) AS places, {counts} FROM t{b - 1})",
            f"p{b} AS (SELECT *, least(greatest(1, places // 3), places, n0) AS k0 FROM l{b})",
            f"q{b} AS (SELECT *, least(greatest(1, places // 3), places - k0, n1) AS k1 FROM p{b})",
            f"r{b} AS (SELECT *, least(greatest(1, places // 3), places - k0 - k1, n2) AS k2 FROM q{b})",
            f"s{b} AS (SELECT {own}, taken OR coalesce(band = {b} AND ({inside}), false) AS taken, places - k0 - k1 - k2 AS places FROM r{b})",
            f"e{b} AS (SELECT *, band = {b} AND NOT taken AND (large OR count(*) FILTER (band = {b} AND NOT taken AND large) OVER () = 0) AS open FROM s{b})",
            f"t{b} AS (SELECT {own}, taken OR (open AND row_number() OVER (PARTITION BY open ORDER BY h) <= places) AS taken FROM e{b})",
        ]
    steps += [
        f"f AS (SELECT *, {total} - count(*) FILTER (taken) OVER () AS places, saved AND NOT taken AS open, NOT large AND count(*) FILTER (saved AND large) OVER () > 0 AS later FROM t3)",
        "chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY open ORDER BY later, h) AS turn FROM f) WHERE taken OR (open AND turn <= places))",
    ]
    return ", ".join(steps)


@query(
    ALERTS
    + """
, b AS (SELECT transaction_id, p, amount, decision, CASE decision WHEN 'BLOCKED' THEN 3 WHEN 'FLAGGED' THEN 2 ELSE 1 END AS band,
    amount > 1 AS large, true AS saved, ('0x' || substr(md5('42|' || transaction_id), 1, 15))::BIGINT AS h,
    count(*) FILTER (amount > 1) OVER (PARTITION BY decision) AS n_large FROM alerts WHERE decision <> 'APPROVED'),
c AS (SELECT decision, quantile_cont(amount, 0.33) AS low, quantile_cont(amount, 0.66) AS high FROM b WHERE n_large < 3 OR amount > 1 GROUP BY 1),
pooled AS (SELECT b.* EXCLUDE (n_large), CASE WHEN n_large >= 3 AND amount <= 1 THEN NULL WHEN amount <= low THEN 0 WHEN amount <= high THEN 1 ELSE 2 END AS pool
  FROM b JOIN c USING (decision)),
"""
    + _quota_sql(sampling.band_quotas(40), 40)
    + """
SELECT row_number() OVER (ORDER BY large DESC, p DESC, amount DESC, h) AS position, transaction_id, round(p, 6) AS fraud_probability,
  round(amount, 6) AS "Amount", decision FROM chosen"""
)
def banded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(_banded(spark, sf_dir).select("position", "transaction_id", "fraud_probability", "Amount", "decision"))


_DRAWN = "('0x' || substr(md5('42|tx-' || event_id), 1, 15))::BIGINT"


@query(f"SELECT 'tx-' || event_id AS transaction_id, round(value, 6) AS \"Amount\" FROM events ORDER BY {_DRAWN} LIMIT 250")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = sampling.sample_rows(views.event_transactions(spark, sf_dir), 250, key=["transaction_id"])
    return comparable(sample.select("transaction_id", "Amount"))


@query(
    f"""
WITH e AS (
  SELECT 'tx-' || event_id AS transaction_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS cls, {_DRAWN} AS h FROM events),
sizes AS (SELECT cls, count(*) AS n FROM e GROUP BY 1),
shares AS (
  SELECT cls, n, ceil(round(0.2::DOUBLE * sum(n) OVER (), 9)) AS total,
         n * ceil(round(0.2::DOUBLE * sum(n) OVER (), 9)) / sum(n) OVER ()::DOUBLE AS exact FROM sizes),
parts AS (
  SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, cls)
                                     <= total - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS test FROM shares)
SELECT transaction_id, CAST(cls AS BIGINT) AS "Class",
       CAST(row_number() OVER (PARTITION BY cls ORDER BY h) <= test AS BIGINT) AS test
FROM e JOIN parts USING (cls)"""
)
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.event_transactions(spark, sf_dir)
    rows = rows.select("transaction_id", F.col("Class").cast("int").alias("Class"))
    train, test = sampling.stratified_split(rows, key=["transaction_id"])
    sides = train.withColumn("test", F.lit(0)).unionByName(test.withColumn("test", F.lit(1)))
    return comparable(sides)


@query(
    """
SELECT CASE WHEN event_type = 'error' THEN 1 ELSE 0 END::BIGINT AS cls, round(quantile_cont(value, 0.33), 6) AS low,
       round(median(value), 6) AS middle, round(quantile_cont(value, 0.66), 6) AS high
FROM events GROUP BY 1"""
)
def exact_quantiles_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles per class forced through many value ranges, as a large table takes them."""
    rows = views.event_transactions(spark, sf_dir).select(F.col("Class").cast("int").alias("cls"), "Amount")
    q = F.col("quantiles")
    cuts = ranks.exact_quantiles(rows, "Amount", [0.33, 0.5, 0.66], "cls", rows_per_range=500)
    return comparable(cuts.select(F.col("g").alias("cls"), q[0].alias("low"), q[1].alias("middle"), q[2].alias("high")))


# Models.

_STANDARD = ", ".join(
    f"round((V{i} - avg(V{i}) OVER ()) / stddev_pop(V{i}) OVER (), 6) AS V{i}" for i in range(1, 29)
)


@query(CARDS + f"SELECT vec_id, {_STANDARD} FROM cards")
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(isolation.standardize(views.card_rows(spark, sf_dir).select("vec_id", *_V), _V))


def _card_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = {"amount_mean": 20.0, "amount_std": 40.0}
    rows = X.add_features(views.card_rows(spark, sf_dir), stats)
    return rows.withColumn(S.TARGET, F.col(S.TARGET).cast("int"))


@query(
    CARDS
    + """
SELECT CAST(c AS BIGINT) AS "Class", CAST(count(*) FILTER ("Class" = 0) AS BIGINT) AS rows
FROM cards, (SELECT unnest([0, 1]) AS c) GROUP BY 1"""
)
def oversampled_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    enlarged, _ = oversample(_card_features(spark, sf_dir))
    return comparable(enlarged.groupBy(S.TARGET).agg(F.count("*").alias("rows")))


@query()
def oversampled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    enlarged, _ = oversample(_card_features(spark, sf_dir))
    return comparable(enlarged)


_UNROUNDED = """
 ln(1 + greatest("Amount", 0)), floor(("Time" % 86400) / 3600)::DOUBLE,
 CASE WHEN floor(("Time" % 86400) / 3600) >= 22 OR floor(("Time" % 86400) / 3600) < 6 THEN 1 ELSE 0 END::DOUBLE, ("Amount" - 20) / 40
"""


@query(
    CARDS
    + f"""
, m AS (SELECT vec_id, ["Time", {", ".join(_V)}, "Amount", {_UNROUNDED}] AS x FROM cards WHERE "Class" = 1),
pairs AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.x, b.x) AS distance FROM m a JOIN m b ON a.vec_id <> b.vec_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS place FROM pairs)
SELECT vec_id, place, neighbour, round(distance, 3) AS distance FROM placed WHERE place <= 5"""
)
def minority_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of each minority row, over all 34 features."""
    minority = _card_features(spark, sf_dir).filter(F.col(S.TARGET) == 1)
    points = ranks.work_table(minority.select(F.col("vec_id").alias("id"), feature_vector(S.FEATURES).alias("x"), F.lit(1).cast("long").alias("n")), "minority")
    found = nearest_neighbours(points, 5).select(F.col("id").alias("vec_id"), F.posexplode("found").alias("place", "f"))
    near = found.select("vec_id", (F.col("place") + 1).alias("place"), F.col("f.id").alias("neighbour"), F.sqrt("f.square").alias("distance"))
    return comparable(near, 3)


@query(
    CARDS
    + """
, b AS (SELECT min(V1) AS low, max(V1) AS high FROM cards)
SELECT vec_id, round((V1 - low) / (high - low), 6) AS score FROM cards, b"""
)
def min_max_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.card_rows(spark, sf_dir)
    return comparable(isolation.min_max_scaled(rows, "V1").select("vec_id", "score"))


@query()
def isolation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _card_features(spark, sf_dir)
    forest = isolation.fit_isolation_forest(X.only_negatives(rows), key=["vec_id"])
    return comparable(isolation.min_max_scaled(forest.transform(rows)).select("vec_id", "score"))


def _boosted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, models.ScoringModel]:
    rows = _card_features(spark, sf_dir)
    classifier = boosting.fit_histogram_trees(rows, positive_weight=9.0)
    return rows, models.ScoringModel(classifier, stats={"amount_mean": 20.0, "amount_std": 40.0})


@query()
def boosted_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, model = _boosted(spark, sf_dir)
    scored = models.score_transactions(rows.drop(*S.ENGINEERED_FEATURES), model)
    columns = ["vec_id", "fraud_probability", "risk_score", "threshold", "block_threshold", "decision", "recommended_action"]
    return comparable(scored.select(*columns))


# Trees that SQL can fit as well: pairs of features split at their means. Scored and explained by the same leaf tables.
_PAIRED = [f"V{i}" for i in range(1, 13)]


def _split_tree_sql() -> str:
    """Leaves of all pairs (tree, features a and b, limits, sides, value, shares) and the rows' values of both features."""
    sides = [(left_a, left_b) for left_a in ("true", "false") for left_b in ("true", "false")]
    each = []
    for tree, (a, b) in enumerate(zip(_PAIRED[::2], _PAIRED[1::2])):
        for left_a, left_b in sides:
            in_a, in_b = f"({a} <= m{a}) = {left_a}", f"({b} <= m{b}) = {left_b}"
            each.append(
                f"SELECT {tree} AS tree, '{a}' AS a, '{b}' AS b, {left_a} AS left_a, {left_b} AS left_b, coalesce(avg(\"Class\") FILTER ({in_a} AND {in_b}), 0) AS value, "
                f"count(*) FILTER ({in_a}) / count(*)::DOUBLE AS za, coalesce(count(*) FILTER ({in_a} AND {in_b}) / nullif(count(*) FILTER ({in_a}), 0)::DOUBLE, 0) AS zb FROM cards, means"
            )
    passing = [
        f"SELECT vec_id, {tree} AS tree, {a} <= m{a} AS la, {b} <= m{b} AS lb FROM cards, means" for tree, (a, b) in enumerate(zip(_PAIRED[::2], _PAIRED[1::2]))
    ]
    means = ", ".join(f"round(avg({f}), 4) AS m{f}" for f in _PAIRED)
    return (
        CARDS
        + f", means AS (SELECT {means} FROM cards), leaves AS ({' UNION ALL '.join(each)}), sides AS ({' UNION ALL '.join(passing)}), "
        + "met AS (SELECT s.vec_id, l.*, (la = left_a)::INT AS oa, (lb = left_b)::INT AS ob FROM sides s JOIN leaves l USING (tree)) "
    )


def _split_trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _card_features(spark, sf_dir)
    return rows, ranks.work_table(trees.leaf_table(trees.mean_split_nodes(rows, _PAIRED, S.TARGET)), "leaves")


@query(_split_tree_sql() + "SELECT vec_id, round(sum(value * oa * ob), 6) AS margin FROM met GROUP BY vec_id")
def split_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, leaves = _split_trees(spark, sf_dir)
    return comparable(rows.select("vec_id", trees.margin(leaves, feature_vector(_PAIRED)).alias("margin")))


@query(
    _split_tree_sql()
    + """
, parts AS (SELECT vec_id, a AS feature, value * (oa - za) * (ob + zb) / 2 AS part FROM met
  UNION ALL SELECT vec_id, b, value * (ob - zb) * (oa + za) / 2 FROM met)
SELECT vec_id, feature, round(sum(part), 6) + 0 AS shap_value FROM parts GROUP BY vec_id, feature"""
)
def split_tree_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, leaves = _split_trees(spark, sf_dir)
    values = trees.shapley_values(leaves, feature_vector(_PAIRED), len(_PAIRED))
    named = F.arrays_zip(F.array(*map(F.lit, _PAIRED)).alias("feature"), values.alias("shap_value"))
    return comparable(rows.select("vec_id", F.inline(named)))


# Streams, drained and read back.


def _margin() -> Column:
    """A stand-in score that SQL can state as well."""
    return F.least(F.greatest(F.col("V1") - F.col("V2") + 0.5, F.lit(0.0)), F.lit(1.0))


def _score(df: DataFrame) -> DataFrame:
    p = _margin()
    return df.withColumns(
        {
            "fraud_probability": p,
            "risk_score": risk.risk_score(p),
            "threshold": F.lit(0.6),
            "decision": risk.decision_band(p, 0.6),
        }
    )


def _published(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Card rows as message files, every tenth message broken; returns the folder and a work folder."""
    work = shared_folder(spark, "stream")
    rows = views.card_rows(spark, sf_dir)
    texts = messages.transaction_messages(rows).select("value")
    broken = rows.filter("vec_id % 10 = 3").select(F.lit('{"Time": 1, "V1":').alias("value"))
    messages.publish_text(texts.unionByName(broken), f"{work}/messages")
    return f"{work}/messages", work


def _drained(spark: SparkSession, sf_dir: str) -> str:
    folder, work = _published(spark, sf_dir)
    streaming.start_alert_stream(
        messages.text_stream(spark, folder),
        _score,
        f"{work}/alerts",
        f"{work}/quarantine",
        f"{work}/checkpoint",
        "cards",
        trigger=None,
    ).awaitTermination()
    return work


@query(
    CARDS
    + """
, s AS (SELECT *, least(greatest(V1 - V2 + 0.5::DOUBLE, 0), 1) AS p FROM cards)
SELECT "Time", round("Amount", 6) AS "Amount", round(p, 6) AS fraud_probability, round(round(p * 100, 2), 1) AS risk_score,
       CASE WHEN p >= 0.6 THEN 'BLOCKED' ELSE 'FLAGGED' END AS decision, CAST("Class" AS BIGINT) AS actual_class,
       CAST(floor(("Time" % 86400) / 3600) AS BIGINT) AS hour_of_day,
       'fraud_probability_above_0.5' AS alert_reason, 0.5::DOUBLE AS stream_alert_threshold
FROM s WHERE p > 0.5"""
)
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = streaming.read_stream_alerts(spark, f"{_drained(spark, sf_dir)}/alerts")
    columns = ["Time", "Amount", "fraud_probability", "risk_score", "decision", "actual_class", "hour_of_day"]
    rows = rows.withColumn("risk_score", F.round("risk_score", 1))
    return comparable(rows.select(*columns, "alert_reason", "stream_alert_threshold"))


@query("SELECT count(*) FILTER (vec_id % 10 = 3) AS rejected, 30::BIGINT AS missing FROM embeddings")
def stream_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{_drained(spark, sf_dir)}/quarantine")
    broken = rows.filter(F.col("_corrupt_record").isNotNull())
    return comparable(
        broken.agg(F.count("*").alias("rejected"), F.max(F.size("missing_fields")).alias("missing"))
    )


def _alert_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored alert documents as a stream."""
    work = shared_folder(spark, "alert-stream")
    documents = views.alert_documents(spark, sf_dir)
    documents.write.parquet(f"{work}/documents")
    stream = streaming.replay_files(spark, documents.schema, f"{work}/documents", files_per_trigger=2)
    return normalize_alerts(stream)


@query(ALERTS + _HOURLY)
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = shared_folder(spark, "hourly")
    view = streaming.start_hourly_view(
        _alert_stream(spark, sf_dir), f"{work}/table", f"{work}/checkpoint", trigger=None
    )
    view.awaitTermination()
    rows = spark.read.parquet(f"{work}/table")
    return comparable(rows.withColumn("total_amount", F.round("total_amount", 4)))


def _day_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view per day and hour over the alert documents: two halves, each drained by a stream that is started anew, and the
    last batch's changes offered a second time, as after a crash before it was committed."""
    work = shared_folder(spark, "day-hours")
    documents = views.alert_documents(spark, sf_dir)
    late = F.crc32("transaction_id") % 2 == 1
    for half in (documents.filter(~late), documents.filter(late)):
        half.write.mode("append").parquet(f"{work}/documents")
        stream = normalize_alerts(streaming.replay_files(spark, documents.schema, f"{work}/documents", files_per_trigger=2))
        streaming.start_day_hour_view(stream, f"{work}/view", f"{work}/checkpoint", trigger=None, fold_every=2).awaitTermination()
    changes = spark.read.parquet(f"{work}/view/changes")
    last = changes.agg(F.max("batch_id")).first()[0]
    again = ranks.work_table(changes.filter(F.col("batch_id") == last).drop("epoch", "batch_id"), "replayed")
    streaming.write_day_hours(again, last, f"{work}/view", fold_every=2)
    return streaming.read_day_hours(spark, f"{work}/view", fold_every=2)


@query(
    ALERTS
    + """
SELECT strftime(stored_at, '%Y-%m-%d') AS day, hour_of_day, count(*) AS fraud_alerts, round(sum(p), 4) AS total_probability,
       round(max(p), 6) AS max_probability, round(sum(risk), 4) AS total_risk_score, round(max(risk), 6) AS max_risk_score,
       round(sum(amount), 4) AS total_amount, count(*) FILTER (decision = 'BLOCKED') AS blocked_count,
       count(*) FILTER (decision IN ('REVIEW', 'FLAGGED')) AS flagged_count
FROM alerts GROUP BY 1, 2"""
)
def stream_day_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _day_hours(spark, sf_dir).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    totals = ("total_probability", "total_risk_score", "total_amount")
    return comparable(rows.withColumns({name: F.round(name, 4) for name in totals}))


@query(ALERTS + _HOURLY)
def stream_hourly_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports.hourly_profile_of_days(_day_hours(spark, sf_dir))
    return comparable(rows.withColumn("total_amount", F.round("total_amount", 4)))


@query(
    ALERTS
    + """
SELECT count(*) AS alert_count, count(*) FILTER (decision = 'REVIEW') AS review_count,
       count(*) FILTER (decision = 'FLAGGED') AS flagged_count, count(*) FILTER (decision = 'BLOCKED') AS blocked_count,
       round(sum(amount), 4) AS alerted_amount, round(sum(amount) FILTER (decision = 'BLOCKED'), 4) AS blocked_amount,
       round(avg(risk), 6) AS average_risk
FROM alerts"""
)
def stream_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = shared_folder(spark, "kpis")
    view = streaming.start_kpi_view(
        _alert_stream(spark, sf_dir), reports.kpi_summary, f"{work}/table", f"{work}/checkpoint", trigger=None
    )
    view.awaitTermination()
    rows = spark.read.parquet(f"{work}/table")
    money = {name: F.round(name, 4) for name in ("alerted_amount", "blocked_amount")}
    return comparable(rows.withColumns(money))

"""Registered queries over alerts: normalisation, display, reports and top lists."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.functions import risk, text, times
from riskspark.operators import alerts as A
from riskspark.operators import models, reports
from riskspark.plans import views
from riskspark.plans.registry import comparable, query
from riskspark.session import shared_folder
from riskspark.sources.alerts import RECORD_SEPARATOR, read_seed_alerts, storable
from riskspark.sources.transactions import enrich_events

NOW = datetime(2024, 1, 20, 15, 30, tzinfo=timezone.utc)

_CASES = "".join(f" WHEN '{d}' THEN '{a}'" for d, a in S.ACTIONS.items())

# The alerts of views.alerts in SQL.
ALERTS = f"""
WITH base AS (
  SELECT event_id, 'tx-' || event_id AS transaction_id, 'm' || (user_id % 12) AS merchant_name,
         value AS amount, ts AS event_time, ts + INTERVAL 1 MINUTE AS stored_at,
         CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 99 AS p,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS cls
  FROM events),
banded AS (
  SELECT *, round(p * 100, 2) AS risk,
         CASE WHEN p >= 0.9 THEN 'BLOCKED' WHEN p >= 0.5 THEN 'FLAGGED'
              WHEN p >= 0.1 THEN 'REVIEW' ELSE 'APPROVED' END AS decision,
         CAST(extract(hour FROM event_time) AS BIGINT) AS hour_of_day
  FROM base),
alerts AS (SELECT *, CASE decision{_CASES} END AS action FROM banded)
"""

# The alerts of views.line_alerts in SQL.
LINE_ALERTS = """
WITH base AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS merchant_name,
         l_extendedprice AS amount,
         (l_partkey % 1000) / 999.0::DOUBLE AS p,
         CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey AS transaction_id,
         l_shipdate + INTERVAL 1 SECOND * CAST(l_orderkey % 86400 AS INTEGER) AS event_time
  FROM lineitem),
alerts AS (
  SELECT *, round(p * 100, 2) AS risk, CAST(extract(hour FROM event_time) AS BIGINT) AS hour_of_day,
         CASE WHEN p >= 0.9 THEN 'BLOCKED' WHEN p >= 0.5 THEN 'FLAGGED'
              WHEN p >= 0.1 THEN 'REVIEW' ELSE 'APPROVED' END AS decision
  FROM base)
"""


@query(
    ALERTS
    + """
SELECT transaction_id, merchant_name, round(amount, 6) AS "Amount", round(p, 6) AS fraud_probability,
       round(risk, 6) AS risk_score, 0.9::DOUBLE AS threshold, 0.9::DOUBLE AS block_threshold, decision,
       action AS recommended_action, hour_of_day, epoch_us(event_time) AS event_time_utc,
       epoch_us(stored_at) AS stored_at_utc, CAST(cls AS BIGINT) AS actual_class
FROM alerts"""
)
def normalize_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(views.alerts(spark, sf_dir).drop("Time"))


_SPARSE = """
WITH base AS (
  SELECT event_id AS n, 'tx-' || event_id AS transaction_id,
         CASE WHEN event_id % 13 <> 0 THEN 'm' || (user_id % 12) END AS merchant_name, ts,
         CASE WHEN event_id % 11 <= 2 THEN 0
              ELSE CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) / 99 * 1.5 - 0.25 END AS raw_p,
         CASE WHEN event_id % 11 <= 2 THEN 0 ELSE value - 20 END AS raw_amount,
         CASE event_id % 3 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS t,
         date_trunc('second', ts) AS s
  FROM events),
clean AS (
  SELECT *, greatest(0, least(1, raw_p))::DOUBLE AS p, greatest(0, raw_amount)::DOUBLE AS amount,
         CASE n % 7 WHEN 0 THEN s - INTERVAL 2 HOUR WHEN 1 THEN s WHEN 2 THEN s END AS event_time,
         CASE n % 7 WHEN 4 THEN date_trunc('hour', s) END AS transaction_time
  FROM base),
banded AS (
  SELECT *, CASE WHEN p >= t THEN 'BLOCKED' WHEN p >= 0.5 THEN 'FLAGGED'
                 WHEN p >= 0.1 THEN 'REVIEW' ELSE 'APPROVED' END AS computed,
         CASE WHEN event_time IS NOT NULL THEN extract(hour FROM event_time)
              WHEN transaction_time IS NOT NULL THEN extract(hour FROM transaction_time)
              WHEN n % 4 = 0 THEN 7 ELSE extract(hour FROM s) END AS hour
  FROM clean),
sparse AS (
  SELECT *, CASE n % 5 WHEN 0 THEN 'BLOCKED' WHEN 2 THEN 'REVIEW' ELSE computed END AS kept
  FROM banded)
"""


@query(
    _SPARSE
    + f"""
SELECT transaction_id, merchant_name, round(p, 6) AS fraud_probability, round(amount, 6) AS "Amount",
       t AS threshold, t AS block_threshold, round(round(p * 100, 2), 6) AS risk_score,
       kept AS decision, CAST(hour AS BIGINT) AS hour_of_day,
       CASE WHEN n % 17 = 0 THEN 'Call the customer.' ELSE CASE computed{_CASES} END END AS recommended_action,
       epoch_us(event_time) AS event_time_utc, epoch_us(transaction_time) AS transaction_time_utc,
       epoch_us(s) AS stored_at_utc
FROM sparse"""
)
def normalize_sparse_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.sparse_documents(spark, sf_dir)
    return comparable(A.normalize_alerts(documents, recompute_decision=False).drop("Time"))


@query(
    ALERTS
    + """
SELECT transaction_id AS full_id, CASE WHEN length(transaction_id) > 13
         THEN substr(transaction_id, 1, 10) || '...' ELSE transaction_id END AS short_transaction_id,
       format('${:,.2f}', amount) AS amount_display,
       CASE WHEN p >= 0.9995 THEN '≥99.95%' ELSE format('{:.2f}%', p * 100) END AS probability_display,
       format('{:.0f} / 100', risk) AS risk_display, substr(action, 1, 92) AS action_short, hour_of_day
FROM alerts"""
)
def display_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = A.display_alerts(views.alert_documents(spark, sf_dir))
    return comparable(
        shown.select(
            F.col("transaction_id").alias("full_id"),
            "short_transaction_id",
            "amount_display",
            "probability_display",
            "risk_display",
            "action_short",
            "hour_of_day",
        )
    )


_SHOWN_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S UTC')"


@query(
    ALERTS
    + f"""
SELECT CASE WHEN length(transaction_id) > 13 THEN substr(transaction_id, 1, 10) || '...'
            ELSE transaction_id END AS transaction_id, merchant_name,
       format('${{:,.2f}}', amount) AS amount,
       CASE WHEN p >= 0.9995 THEN '≥99.95%' ELSE format('{{:.2f}}%', p * 100) END AS fraud_probability,
       format('{{:.0f}} / 100', risk) AS risk_score, decision, substr(action, 1, 92) AS recommended_action,
       {_SHOWN_TIME.format("event_time")} AS event_time_utc,
       {_SHOWN_TIME.format("stored_at")} AS stored_at_utc
FROM alerts"""
)
def feed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.feed_table(A.display_alerts(views.alert_documents(spark, sf_dir)))


@query(
    ALERTS
    + f"""
SELECT transaction_id, merchant_name, round(amount, 6) AS "Amount", round(p, 6) AS fraud_probability,
       round(risk, 6) AS risk_score, decision, action AS recommended_action, hour_of_day,
       {_SHOWN_TIME.format("stored_at")} AS stored_at_utc
FROM alerts"""
)
def export_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(A.export_columns(views.alerts(spark, sf_dir)))


@query(
    ALERTS
    + f"""
SELECT transaction_id, transaction_id AS doc_id, round(amount, 6) AS doc_amount,
       {_SHOWN_TIME.format("event_time")} AS doc_event_time
FROM alerts"""
)
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = A.json_documents(views.alerts(spark, sf_dir))
    return comparable(
        documents.select(
            "transaction_id",
            F.get_json_object("document", "$.transaction_id").alias("doc_id"),
            F.get_json_object("document", "$.Amount").cast("double").alias("doc_amount"),
            F.get_json_object("document", "$.event_time_utc").alias("doc_event_time"),
        )
    )


@query(
    ALERTS
    + """
SELECT transaction_id, merchant_name, round(p, 6) AS fraud_probability, decision, hour_of_day
FROM alerts WHERE transaction_id = (SELECT max(transaction_id) FROM alerts)"""
)
def alert_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = views.alert_documents(spark, sf_dir)
    wanted = documents.agg(F.max("transaction_id")).first()[0]
    found = A.alert_by_id(documents, wanted)
    return comparable(found.select("transaction_id", "merchant_name", "fraud_probability", "decision", "hour_of_day"))


@query(
    ALERTS
    + """
SELECT transaction_id, 'strict' AS kind FROM alerts WHERE p > 50 / 99::DOUBLE
UNION ALL SELECT transaction_id, 'inclusive' AS kind FROM alerts WHERE p >= 50 / 99::DOUBLE"""
)
def alert_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.alert_documents(spark, sf_dir)
    cutoff = 50 / 99
    strict = A.above_cutoff(rows, cutoff, strict=True).select("transaction_id", F.lit("strict").alias("kind"))
    inclusive = A.above_cutoff(rows, cutoff, strict=False)
    return strict.unionByName(inclusive.select("transaction_id", F.lit("inclusive").alias("kind")))


@query(
    ALERTS
    + f"""
SELECT transaction_id, 0.5::DOUBLE AS stream_alert_threshold, 'fraud_probability_above_0.5' AS alert_reason,
       CAST(epoch_us(TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}') AS BIGINT) AS scored_at_utc,
       CAST(cls AS BIGINT) AS actual_class
FROM alerts WHERE p > 0.5"""
)
def alert_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.above_cutoff(views.event_transactions(spark, sf_dir), 0.5, strict=True)
    made = A.assemble_alerts(rows, 0.5, "fraud_probability_above_0.5", NOW)
    return comparable(
        made.select("transaction_id", "stream_alert_threshold", "alert_reason", "scored_at_utc", "actual_class")
    )


@query(
    ALERTS
    + f"""
SELECT transaction_id, merchant_name, round(amount, 6) AS "Amount", round(p, 6) AS fraud_probability, decision,
       CAST(epoch_us(TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}') AS BIGINT) AS stored_at_utc
FROM alerts"""
)
def storable_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = storable(views.alert_documents(spark, sf_dir).drop("stored_at_utc"), NOW)
    return comparable(
        rows.select("transaction_id", "merchant_name", "Amount", "fraud_probability", "decision", "stored_at_utc")
    )


@query("SELECT event_type, count(*) AS events, count(*) AS ids, max(value) AS highest FROM events GROUP BY event_type")
def event_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replayed events get ids that tell all of them apart."""
    rows = views.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    made = enrich_events(rows, now=NOW)
    return made.groupBy("event_type").agg(
        F.count("*").alias("events"), F.count_distinct("transaction_id").alias("ids"), F.max("value").alias("highest")
    )


@query(
    ALERTS
    + """
SELECT transaction_id, merchant_name, round(amount, 6) AS "Amount", round(p, 6) AS fraud_probability,
       CASE WHEN event_id % 2 = 0 THEN 'REVIEW' END AS decision, epoch_us(event_time) AS event_time_utc
FROM alerts"""
)
def seed_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packaged alerts read from JSON arrays, with either spelling of the amount."""
    path = shared_folder(spark, "seeds")
    rows = views.event_transactions(spark, sf_dir)
    even = F.col("event_id") % 2 == 0
    moment = F.to_utc_timestamp("event_time_utc", F.current_timezone())
    documents = rows.select(
        F.floor(F.col("event_id") / 50).alias("file"),
        F.struct(
            "transaction_id",
            "merchant_name",
            F.when(even, F.col("Amount")).alias("Amount_"),
            F.when(~even, F.col("Amount")).alias("amount"),
            "fraud_probability",
            F.when(even, F.lit("REVIEW")).alias("decision"),
            F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("event_time_utc"),
        ).alias("document"),
    )
    arrays = documents.groupBy("file").agg(F.to_json(F.collect_list("document")).alias("value"))
    arrays = arrays.withColumn("value", F.replace("value", F.lit('"Amount_"'), F.lit('"Amount"')))
    # Many arrays a file, each behind a record separator: a file per array is a folder per fifty alerts.
    arrays.select("value").write.option("lineSep", RECORD_SEPARATOR).text(path)
    columns = ["transaction_id", "merchant_name", "Amount", "fraud_probability", "decision", "event_time_utc"]
    return comparable(read_seed_alerts(spark, path).select(*columns))


_HOURLY = """
SELECT CAST(h.hour_of_day AS BIGINT) AS hour_of_day, count(a.p) AS fraud_alerts,
       round(count(a.p) / (SELECT count(*) FROM alerts)::DOUBLE, 6) AS fraud_rate,
       round(coalesce(avg(a.p), 0), 6) AS avg_probability, round(coalesce(max(a.p), 0), 6) AS max_probability,
       round(coalesce(avg(a.risk), 0), 6) AS avg_risk_score, round(coalesce(max(a.risk), 0), 6) AS max_risk_score,
       round(coalesce(sum(a.amount), 0), 4) AS total_amount,
       count(*) FILTER (a.decision = 'BLOCKED') AS blocked_count,
       count(*) FILTER (a.decision IN ('REVIEW', 'FLAGGED')) AS flagged_count
FROM (SELECT unnest(range(24)) AS hour_of_day) h LEFT JOIN alerts a USING (hour_of_day) GROUP BY 1"""


def _money(df: DataFrame, *names: str) -> DataFrame:
    return comparable(df.withColumns({name: F.round(name, 4) for name in names}))


@query(ALERTS + _HOURLY)
def hourly_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(reports.hourly_profile(views.alerts(spark, sf_dir)), "total_amount")


@query(LINE_ALERTS + _HOURLY)
def hourly_profile_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(reports.hourly_profile(views.line_alerts(spark, sf_dir)), "total_amount")


@query(ALERTS + "SELECT count(DISTINCT hour_of_day) AS active_hours FROM alerts")
def active_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.active_hours(reports.hourly_profile(views.alerts(spark, sf_dir)))


@query(
    ALERTS
    + """
SELECT round(coalesce(sum(amount), 0), 4) AS total_amount FROM alerts
WHERE stored_at >= TIMESTAMP '2024-01-20 00:00:00'"""
)
def amount_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(reports.amount_since_midnight(views.alert_documents(spark, sf_dir), NOW), "total_amount")


_MERCHANTS = """
SELECT {name} AS merchant_name, count(*) AS alert_count,
       count(*) FILTER (decision = 'REVIEW') AS review_count,
       count(*) FILTER (decision = 'FLAGGED') AS flagged_count,
       count(*) FILTER (decision = 'BLOCKED') AS blocked_count,
       round(avg(p), 6) AS avg_probability, round(max(p), 6) AS max_probability,
       round(avg(risk), 6) AS avg_risk_score, round(median(risk), 6) AS median_risk_score,
       round(max(risk), 6) AS max_risk_score, round(sum(amount), 4) AS total_amount,
       epoch_us(max({time})) AS last_alert_time,
       round(count(*) FILTER (decision = 'BLOCKED') / count(*)::DOUBLE, 6) AS block_rate
FROM {source} GROUP BY 1"""


@query(ALERTS + _MERCHANTS.format(name="merchant_name", time="event_time", source="alerts"))
def merchant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = reports.merchant_summary(views.alerts(spark, sf_dir))
    return _money(reports.rank_merchants(summary), "total_amount")


@query(LINE_ALERTS + _MERCHANTS.format(name="merchant_name", time="event_time", source="alerts"))
def merchant_summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(reports.merchant_summary(views.line_alerts(spark, sf_dir)), "total_amount")


_RAW_SCORE = "((l_partkey * 7919 + l_orderkey) % 99991) / 999.91::DOUBLE"


@query(
    LINE_ALERTS.replace("(l_partkey % 1000) / 999.0::DOUBLE AS p,", f"(l_partkey % 1000) / 999.0::DOUBLE AS p, {_RAW_SCORE} AS raw,")
    + ", raw_alerts AS (SELECT * REPLACE (CASE WHEN merchant_name::BIGINT % 2 = 0 THEN 'most' ELSE merchant_name END AS merchant_name, raw AS risk) FROM alerts)"
    + _MERCHANTS.format(name="merchant_name", time="event_time", source="raw_alerts")
)
def merchant_summary_raw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores that are not rounded, and one merchant with half of all alerts."""
    alerts = views.line_alerts(spark, sf_dir)
    part, order = (F.split("transaction_id", "-")[i].cast("long") for i in (2, 0))
    most = F.when(F.col("merchant_name").cast("long") % 2 == 0, "most").otherwise(F.col("merchant_name"))
    raw = ((part * 7919 + order) % 99991) / F.lit(999.91)
    return _money(reports.merchant_summary(alerts.withColumns({"risk_score": raw, "merchant_name": most})), "total_amount")


@query(
    _SPARSE
    + ", risky AS (SELECT *, computed AS decision, round(p * 100, 2) AS risk FROM sparse), ranked AS ("
    + _MERCHANTS.format(
        name="coalesce(merchant_name, 'UNKNOWN')",
        time="coalesce(event_time, transaction_time, s)",
        source="risky",
    )
    + """)
SELECT * FROM ranked
ORDER BY blocked_count DESC, block_rate DESC, avg_risk_score DESC, total_amount DESC, merchant_name LIMIT 10"""
)
def high_risk_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.normalize_alerts(views.sparse_documents(spark, sf_dir))
    return _money(reports.high_risk_merchants(rows, 10), "total_amount")


_KPIS = """
SELECT count(*) AS alert_count, count(*) FILTER (decision = 'REVIEW') AS review_count,
       count(*) FILTER (decision = 'FLAGGED') AS flagged_count,
       count(*) FILTER (decision = 'BLOCKED') AS blocked_count,
       round(coalesce(sum(amount), 0), 4) AS alerted_amount,
       round(coalesce(sum(amount) FILTER (decision = 'BLOCKED'), 0), 4) AS blocked_amount,
       round(coalesce(avg(risk), 0), 6) AS average_risk
FROM alerts"""


@query(ALERTS + _KPIS)
def kpi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(reports.kpi_summary(views.alerts(spark, sf_dir)), "alerted_amount", "blocked_amount")


@query(LINE_ALERTS + _KPIS)
def kpi_summary_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(reports.kpi_summary(views.line_alerts(spark, sf_dir)), "alerted_amount", "blocked_amount")


@query(
    ALERTS
    + """
SELECT decision, count(transaction_id) AS alert_count, round(avg(risk), 6) AS avg_risk_score,
       round(sum(amount), 4) AS total_amount FROM alerts GROUP BY 1"""
)
def decision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _money(reports.decision_summary(views.alerts(spark, sf_dir)), "total_amount")


@query(
    ALERTS
    + """
SELECT d.decision, count(a.decision) AS alert_count
FROM (SELECT unnest(['REVIEW', 'FLAGGED', 'BLOCKED']) AS decision) d LEFT JOIN alerts a USING (decision)
GROUP BY 1"""
)
def decision_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.decision_split(views.alerts(spark, sf_dir))


@query(
    ALERTS
    + """
SELECT round(count(*) FILTER (decision = 'BLOCKED') / count(*)::DOUBLE * 100, 6) AS blocked_pct,
       count(*) FILTER (hour_of_day >= 22 OR hour_of_day < 6) AS night_count,
       round(count(*) FILTER (hour_of_day >= 22 OR hour_of_day < 6) / count(*)::DOUBLE * 100, 6) AS night_pct,
       round(max(risk), 6) AS max_risk
FROM alerts"""
)
def insight_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(reports.insight_ratios(views.alerts(spark, sf_dir)))


@query(
    _SPARSE
    + """
SELECT transaction_id,
       coalesce(extract(hour FROM coalesce(event_time, transaction_time)) >= 22
                OR extract(hour FROM coalesce(event_time, transaction_time)) < 6, FALSE) AS is_night
FROM sparse"""
)
def night_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.normalize_alerts(views.sparse_documents(spark, sf_dir))
    return reports.night_flags(rows).select("transaction_id", "is_night")


@query(
    ALERTS
    + """
, binned AS (SELECT decision, CAST(least(floor(risk / 4), 24) AS BIGINT) AS bin FROM alerts)
SELECT decision, bin, round(bin * 4.0::DOUBLE, 6) AS bin_start, count(*) AS alert_count FROM binned GROUP BY 1, 2"""
)
def risk_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(reports.risk_histogram(views.alerts(spark, sf_dir)))


_AMOUNT_BINS = """
, x AS (SELECT decision, {scale}(greatest(amount, 0.01::DOUBLE)) AS x FROM alerts),
b AS (SELECT min(x) AS low, max(x) AS high, (max(x) - min(x)) / 35 AS width FROM x),
binned AS (SELECT decision, CAST(least(floor((x - low) / width), 34) AS BIGINT) AS bin, low, width FROM x, b)
SELECT decision, bin, round(low + bin * width, 6) AS bin_start, count(*) AS alert_count
FROM binned GROUP BY 1, 2, 3"""


@query(ALERTS + _AMOUNT_BINS.format(scale=""))
def amount_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(reports.amount_histogram(views.alerts(spark, sf_dir)))


@query(ALERTS + _AMOUNT_BINS.format(scale="log10"))
def amount_histogram_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(reports.amount_histogram(views.alerts(spark, sf_dir), log_scale=True))


_RUNNING = """
, timeline AS (
  SELECT transaction_id, epoch_us(event_time) AS event_time, decision, round(amount, 6) AS "Amount",
         round(sum(amount) OVER (ORDER BY event_time, transaction_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS cum_amount
  FROM alerts)
SELECT * FROM timeline"""


def _timeline(df: DataFrame) -> DataFrame:
    rows = df.select("transaction_id", F.col("_event_time").alias("event_time"), "decision", "Amount", "cum_amount")
    return _money(rows, "cum_amount")


@query(ALERTS + _RUNNING)
def cumulative_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(reports.cumulative_amount(views.alerts(spark, sf_dir)))


@query(ALERTS + _RUNNING)
def cumulative_amount_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report forced through many key ranges, as a large table takes it."""
    return _timeline(reports.cumulative_amount(views.alerts(spark, sf_dir), rows_per_range=1_000))


_LINE_RUNNING = LINE_ALERTS + _RUNNING.replace("FROM alerts", "FROM months").replace(
    ", timeline AS",
    """, months AS (
  SELECT * REPLACE (transaction_id || '-' || merchant_name AS transaction_id, date_trunc('month', event_time) AS event_time) FROM alerts)
, timeline AS""",
)


def _line_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as alerts of whole months: many share a moment, and the id tells all of them apart."""
    return views.line_alerts(spark, sf_dir).withColumns(
        {
            "transaction_id": F.concat_ws("-", "transaction_id", "merchant_name"),
            "event_time_utc": F.date_trunc("month", "event_time_utc"),
        }
    )


@query(_LINE_RUNNING)
def cumulative_amount_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _timeline(reports.cumulative_amount(_line_months(spark, sf_dir)))


@query(_LINE_RUNNING)
def cumulative_amount_lines_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forced through so many ranges that every month is cut by sampled ids."""
    return _timeline(reports.cumulative_amount(_line_months(spark, sf_dir), rows_per_range=300))


@query(ALERTS + _RUNNING + " WHERE decision = 'BLOCKED'")
def blocked_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    timeline = reports.cumulative_amount(views.alerts(spark, sf_dir))
    return _timeline(reports.blocked_points(timeline))


_TOP = 'SELECT transaction_id, round(risk, 6) AS risk_score, round(amount, 6) AS "Amount", decision FROM alerts '
_TOP_COLUMNS = ["transaction_id", "risk_score", "Amount", "decision"]


@query(ALERTS + _TOP + "ORDER BY stored_at DESC, transaction_id LIMIT 100")
def recent_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(A.recent_alerts(views.alert_documents(spark, sf_dir), 100).select(*_TOP_COLUMNS))


@query(ALERTS + _TOP + "ORDER BY event_time DESC NULLS LAST, transaction_id LIMIT 24")
def recent_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(reports.recent_mixed(views.alerts(spark, sf_dir)).select(*_TOP_COLUMNS))


@query(ALERTS + _TOP + "ORDER BY risk DESC, amount DESC, transaction_id LIMIT 20")
def highest_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparable(reports.highest_risk(views.alerts(spark, sf_dir)).select(*_TOP_COLUMNS))


@query(
    ALERTS
    + """
SELECT count(*) AS transaction_count, count(*) FILTER (decision = 'APPROVED') AS approved,
       count(*) FILTER (decision = 'REVIEW') AS review, count(*) FILTER (decision = 'FLAGGED') AS flagged,
       count(*) FILTER (decision = 'BLOCKED') AS blocked,
       count(*) FILTER (decision <> 'APPROVED') AS flagged_or_blocked_count,
       round(count(*) FILTER (decision <> 'APPROVED') / count(*)::DOUBLE, 6) AS estimated_fraud_rate,
       round(avg(p), 6) AS average_fraud_probability, round(max(p), 6) AS max_fraud_probability,
       round(avg(risk), 6) AS average_risk_score
FROM alerts"""
)
def batch_score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = reports.batch_score_summary(views.alerts(spark, sf_dir))
    counts = {d.lower(): F.col("decision_counts")[d] for d in S.DECISIONS}
    return comparable(summary.withColumns(counts).drop("decision_counts"))


@query(
    ALERTS
    + """
SELECT count(*) AS scanned, count(*) FILTER (p >= 0.1) AS candidates,
       count(*) FILTER (p >= 0.6) AS inserted, 0.1::DOUBLE AS alert_threshold, round(max(p), 6) AS max_probability,
       count(*) FILTER (p >= 0.6 AND decision = 'FLAGGED') AS flagged,
       count(*) FILTER (p >= 0.6 AND decision = 'BLOCKED') AS blocked
FROM alerts"""
)
def generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.alerts(spark, sf_dir)
    summary = reports.generation_summary(rows, A.above_cutoff(rows, 0.6, strict=False), 0.1)
    mix = {name: F.col("decision_mix")[name] for name in ("flagged", "blocked")}
    return comparable(summary.withColumns(mix).drop("decision_mix"))


# A linear model with a fixed rule for its weights, so that SQL can state the drivers too.
_WEIGHTS = [((i * 37) % 11 - 5) / 5 for i in range(1, 29)]
_WEIGHT_SQL = "((((i * 37) % 11) - 5) / 5::DOUBLE)"
_DRIVERS = f"""
WITH parts AS (
  SELECT vec_id, i, embedding[i]::DOUBLE AS v, (embedding[i]::DOUBLE - 0.01::DOUBLE) * {_WEIGHT_SQL} AS c
  FROM embeddings, (SELECT unnest(range(1, 29)) AS i)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(c) DESC, 'V' || i) AS place FROM parts)
"""


def _with_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with their drivers, stored first: breakdowns read the alert table."""
    features = [f"V{i}" for i in range(1, 29)]
    drivers = models.linear_drivers(_WEIGHTS, [0.01] * 28, features)
    rows = views.card_rows(spark, sf_dir)
    rows = rows.select(F.col("vec_id").cast("string").alias("transaction_id"), drivers.alias("top_shap_features"))
    path = shared_folder(spark, "drivers")
    rows.write.parquet(path)
    return spark.read.parquet(path)


@query(
    _DRIVERS
    + """
SELECT CAST(vec_id AS VARCHAR) AS transaction_id, place AS place, 'V' || i AS feature, round(v, 6) AS feature_value,
       round(c, 6) AS shap_value, CASE WHEN c >= 0 THEN 'risk_increasing' ELSE 'risk_decreasing' END AS direction
FROM ranked WHERE place <= 5"""
)
def top_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_drivers(spark, sf_dir)
    rows = rows.select("transaction_id", F.posexplode("top_shap_features").alias("place", "driver"))
    return comparable(
        rows.select(
            "transaction_id",
            (F.col("place") + 1).alias("place"),
            *[F.col(f"driver.{name}") for name in ("feature", "feature_value", "shap_value", "direction")],
        )
    )


_BREAKDOWN = """
SELECT CAST(vec_id AS VARCHAR) AS transaction_id, 'V' || i AS feature, round(v, 4) AS feature_value,
       round(c, 4) AS shap_value, CASE WHEN c >= 0 THEN 'risk_increasing' ELSE 'risk_decreasing' END AS direction
FROM ranked WHERE place <= 5 """


@query(_DRIVERS + _BREAKDOWN)
def driver_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.driver_breakdown(_with_drivers(spark, sf_dir))


@query(_DRIVERS + _BREAKDOWN + "AND c >= 0")
def increasing_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.increasing_drivers(A.driver_breakdown(_with_drivers(spark, sf_dir)))


@query(_DRIVERS + _BREAKDOWN + "AND c < 0")
def decreasing_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.decreasing_drivers(A.driver_breakdown(_with_drivers(spark, sf_dir)))


@query(
    """
SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 1
                            ELSE least(1, value / 100) END::DOUBLE, 6) AS probability,
       round(CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 100
                  ELSE least(100, value) END::DOUBLE, 6) AS risk,
       CASE WHEN event_id % 3 = 0 THEN '$0.00' WHEN event_id % 3 = 1 THEN '$1,234,567.50'
            ELSE format('${:,.2f}', value) END AS money,
       CASE WHEN event_id % 3 = 0 THEN '0.0%' WHEN event_id % 3 = 1 THEN '123456750.0%'
            ELSE format('{:.1f}%', value * 100) END AS share,
       'models/' || event_type || '/roc.png' AS path
FROM events"""
)
def scalar_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "events")
    n = F.col("event_id") % 3
    raw = F.when(n == 0, "n/a").when(n == 1, "1234567.5").otherwise(F.col("value").cast("string"))
    percent = F.when(n == 2, (F.col("value") / 100).cast("string")).otherwise(raw)
    path = F.concat(F.lit("models\\"), "event_type", F.lit("\\roc.png"))
    return comparable(
        events.select(
            "event_id",
            risk.clip_probability(percent).alias("probability"),
            risk.clip_risk_score(raw).alias("risk"),
            text.currency(raw).alias("money"),
            text.percent(raw).alias("share"),
            text.artifact_path(path).alias("path"),
        ),
        6,
    )


@query(
    """
SELECT event_id, CASE event_id % 6
         WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(ts)
         WHEN 2 THEN epoch_us(date_trunc('second', ts) - INTERVAL 90 MINUTE)
         WHEN 3 THEN epoch_us(date_trunc('day', ts)) WHEN 4 THEN epoch_us(date_trunc('minute', ts)) END AS moment
FROM events"""
)
def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = views.table(spark, sf_dir, "events")
    wall = F.to_utc_timestamp(times.time_column(events, "ts"), F.current_timezone())
    n = F.col("event_id") % 6

    def shown(pattern: str, suffix: str = "") -> Column:
        return F.concat(F.date_format(wall, pattern), F.lit(suffix))

    written = (
        F.when(n == 0, shown("yyyy-MM-dd HH:mm:ss"))
        .when(n == 1, shown("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "Z"))
        .when(n == 2, shown("yyyy-MM-dd'T'HH:mm:ss", "+01:30"))
        .when(n == 3, shown("yyyyMMdd"))
        .when(n == 4, shown("yyyyMMdd'T'HHmm"))
        .otherwise(shown("yyyy-MM"))
    )
    return comparable(events.select("event_id", times.parse_timestamp(written).alias("moment")))

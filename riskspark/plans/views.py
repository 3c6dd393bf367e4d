"""The given tables seen as transactions, alerts and scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.functions.times import time_column
from riskspark.operators.alerts import normalize_alerts

EPOCH_SECONDS = 1_704_067_200  # 2024-01-01 UTC, where the events start
MODEL_THRESHOLD = 0.9


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per event."""
    events = table(spark, sf_dir, "events")
    moment = time_column(events, "ts")
    return events.select(
        "event_id",
        F.concat(F.lit("tx-"), "event_id").alias("transaction_id"),
        F.concat(F.lit("m"), F.col("user_id") % 12).alias("merchant_name"),
        (F.unix_micros(moment) / 1e6 - EPOCH_SECONDS).alias("Time"),
        F.col("value").alias("Amount"),
        F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("Class"),
        # props is {"k": n}: stripping everything but the number is much cheaper than parsing JSON.
        (F.btrim("props", F.lit('{"k": }')).cast("double") / 99).alias("fraud_probability"),
        moment.alias("event_time_utc"),
        F.timestamp_micros(F.unix_micros(moment) + 60_000_000).alias("stored_at_utc"),
    )


def alert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw alert documents, one per event."""
    rows = event_transactions(spark, sf_dir).withColumn("actual_class", F.col("Class").cast("int"))
    return rows.withColumn("threshold", F.lit(MODEL_THRESHOLD)).drop("event_id", "Class")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_alerts(alert_documents(spark, sf_dir))


def sparse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with gaps and broken values, everything as text as it may come from a store."""
    rows = event_transactions(spark, sf_dir)
    n = F.col("event_id")
    moment = F.date_format(F.to_utc_timestamp("event_time_utc", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss")
    bad_number = F.when(n % 11 == 0, "NaN").when(n % 11 == 1, "n/a").when(n % 11 == 2, "Infinity")
    return rows.select(
        "transaction_id",
        F.when(n % 13 != 0, F.col("merchant_name")).alias("merchant_name"),
        F.coalesce(bad_number, (F.col("fraud_probability") * 1.5 - 0.25).cast("string")).alias("fraud_probability"),
        F.when(n % 3 != 0, F.when(n % 3 == 1, "0.3").otherwise("0.8")).alias("threshold"),
        F.coalesce(bad_number, (F.col("Amount") - 20).cast("string")).alias("Amount"),
        F.when(n % 5 == 0, F.lit("blocked")).when(n % 5 == 1, "unknown").when(n % 5 == 2, "REVIEW").alias("decision"),
        F.when(n % 17 == 0, "Call the customer.").alias("recommended_action"),
        F.when(n % 7 == 0, F.concat(moment, F.lit("+02:00")))
        .when(n % 7 == 1, F.concat(moment, F.lit("Z")))
        .when(n % 7 == 2, moment)
        .when(n % 7 == 3, F.lit("2024"))
        .alias("event_time_utc"),
        F.when(n % 7 == 4, F.substring(moment, 1, 13)).when(n % 7 == 5, "yesterday").alias("transaction_time_utc"),
        F.when(n % 4 == 0, "7").when(n % 4 == 1, "31").when(n % 4 == 2, "x").alias("hour_of_day"),
        F.when(n % 2 == 0, F.col("Time").cast("string")).alias("Time"),
        F.concat(moment, F.lit("Z")).alias("stored_at_utc"),
    )


def line_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger alert table: one document per order line, suppliers as merchants."""
    lines = table(spark, sf_dir, "lineitem")
    shipped = time_column(lines, "l_shipdate")
    rows = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("transaction_id"),
        F.col("l_suppkey").cast("string").alias("merchant_name"),
        F.col("l_extendedprice").alias("Amount"),
        ((F.col("l_partkey") % 1000) / 999.0).alias("fraud_probability"),
        F.lit(MODEL_THRESHOLD).alias("threshold"),
        F.timestamp_micros(F.unix_micros(shipped) + (F.col("l_orderkey") % 86400) * 1_000_000).alias("event_time_utc"),
    )
    return normalize_alerts(rows)


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, score) per event; 100 distinct scores, so heavy ties."""
    rows = event_transactions(spark, sf_dir)
    return rows.select(F.col("Class").cast("int").alias("label"), F.col("fraud_probability").alias("score"))


def scored_events_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, score) per event, two of seven scores unusable: null or NaN."""
    rows = event_transactions(spark, sf_dir)
    n = F.col("event_id") % 7
    score = F.when(n == 1, float("nan")).when(n != 0, F.col("fraud_probability"))
    return rows.select(F.col("Class").cast("int").alias("label"), score.alias("score"))


def scored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, score) per order line, with many distinct scores."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        ((F.col("l_extendedprice") % 1000) / 1000).alias("score"),
    )


def card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full card transactions with V1 to V28, one per embedding; label 0 is the fraud class."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(
        "vec_id",
        (F.col("vec_id") * 97.0).alias("Time"),
        *[F.expr(f"CAST(embedding[{i - 1}] AS double) AS V{i}") for i in range(1, 29)],
        F.round(F.abs(F.col("embedding")[28].cast("double")) * 400, 2).alias("Amount"),
        F.when(F.col("label") == 0, 1.0).otherwise(0.0).alias(S.TARGET),
    )

"""The alert table: append, scan, clear, export, and packaged seed alerts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark import schema as S
from riskspark.functions import times
from riskspark.operators.alerts import conform, export_columns, normalize_alerts, unknown_fields
from riskspark.operators.features import null_nans
from riskspark.sources.transactions import read_or_none

RECORD_SEPARATOR = "\x1e"  # of JSON text sequences


def storable(df: DataFrame, now: datetime | None = None) -> DataFrame:
    """Alerts as they are stored: normalised, NaN as null, with a stored time, in the full schema and a variant of all
    other fields."""
    rows = null_nans(normalize_alerts(df))
    alerts = conform(rows.withColumn(S.MORE, unknown_fields(rows)), S.STORED_ALERT_SCHEMA)
    moment = F.lit(now) if now else F.current_timestamp()
    return alerts.withColumn("stored_at_utc", F.coalesce("stored_at_utc", moment))


def write_alerts(df: DataFrame, path: str, now: datetime | None = None) -> int:
    """Append alerts, partitioned by stored day; returns how many were written.

    The count is observed by the write itself, so the alerts are computed once.
    """
    written = Observation()
    rows = storable(df, now).withColumn("stored_date", F.to_date("stored_at_utc"))
    rows = rows.observe(written, F.count(F.lit(1)).alias("rows"))
    rows.write.mode("append").partitionBy("stored_date").parquet(path)
    return written.get["rows"]


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """All stored alerts, normalised, their unknown fields in the variant `more`; an absent table reads as empty."""
    rows = read_or_none(lambda: spark.read.schema(S.STORED_ALERT_SCHEMA).parquet(path))
    if rows is None:
        rows = spark.createDataFrame([], S.STORED_ALERT_SCHEMA)
    return normalize_alerts(rows)


def clear_alerts(spark: SparkSession, path: str) -> int:
    """Empty the table and return how many alerts it held."""
    rows = read_or_none(lambda: spark.read.schema(S.ALERT_SCHEMA).parquet(path))
    if rows is None:
        return 0
    held = rows.count()
    spark.createDataFrame([], S.ALERT_SCHEMA).write.mode("overwrite").parquet(path)
    return held


def export_alerts_csv(df: DataFrame, path: str) -> None:
    export_columns(df).write.mode("overwrite").option("header", True).csv(path)


def read_seed_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Packaged alerts from JSON arrays, in the order of their array (``position``); non-objects are dropped.

    A file holds one array over any lines, or several apart by RECORD_SEPARATOR, which valid JSON never has inside, so
    that large files are split and small ones need not be many; all in UTF-8. Documents are read as variants, so either
    spelling of the amount and any set of fields works. An empty or unreadable file is an error.
    """
    document = spark.read.option("lineSep", RECORD_SEPARATOR).option("singleVariantColumn", "doc").json(path)
    items = F.posexplode(F.col("doc").try_cast("array<variant>")).alias("position", "item")
    records = document.select(items)
    if records.isEmpty():
        raise ValueError(f"seed alerts at {path} are empty or invalid")

    def field(name: str, dtype: str) -> Column:
        return F.try_variant_get("item", f"$.{name}", dtype)

    drivers = S.DRIVERS_TYPE.simpleString()
    columns = {
        f.name: field(f.name, "string" if isinstance(f.dataType, T.TimestampType) else f.dataType.simpleString())
        for f in S.ALERT_SCHEMA.fields
    }
    columns["Amount"] = F.coalesce(field("Amount", "double"), field("amount", "double"))
    columns["top_shap_features"] = F.coalesce(
        *[field(name, drivers) for name in ("top_shap_features", "shap_top_features", "shap_features")],
        F.lit([]).cast(S.DRIVERS_TYPE),
    )
    objects = records.filter(F.schema_of_variant("item").startswith("OBJECT"))
    typed = objects.select("position", *[c.alias(name) for name, c in columns.items()])
    return times.with_parsed_times(typed, S.ALERT_TIMES)

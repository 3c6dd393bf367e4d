"""Alert documents: assembly, normalisation, display and lookup."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark import schema as S
from riskspark.functions import risk, text, times


def _row_id(df: DataFrame) -> Column:
    """A hash of all a row holds, the same whenever its partition is computed again. Maps are hashed as text.

    Both halves share one expression over the seeds, for the reason with_parsed_times gives: two hashes of all columns
    written out make a method that the JVM does not compile.
    """
    kinds = [(F.col(f"`{f.name}`"), f.dataType.simpleString()) for f in df.schema.fields]
    held = [F.to_json(c) if "map<" in kind else c for c, kind in kinds if "variant" not in kind]
    halves = F.transform(F.array(F.lit(1), F.lit(2)), lambda seed: F.lpad(F.hex(F.xxhash64(seed, *held)), 16, "0"))
    return F.lower(F.array_join(halves, ""))


def _one_amount(df: DataFrame) -> DataFrame:
    """One amount column: where both spellings are given, the first of them that is not null (upper case first)."""
    places = [i for i, c in enumerate(df.columns) if c.lower() == "amount"]
    if len(places) < 2:
        return df
    names = df.columns
    placed = df.toDF(*[f"_c{i}" for i in range(len(names))])
    first, *rest = sorted(places, key=lambda i: names[i])
    kept = [F.col(f"_c{i}").alias(c) for i, c in enumerate(names) if i not in rest and i != first]
    both = F.coalesce(*[F.col(f"_c{i}").try_cast("double") for i in (first, *rest)])
    return placed.select(*kept, both.alias("Amount"))


def normalize_alerts(
    df: DataFrame,
    default_threshold: float = S.MODEL_THRESHOLD,
    save_threshold: float = S.SAVE_THRESHOLD,
    recompute_decision: bool = True,
) -> DataFrame:
    """Clip the numbers, settle decision and action, and parse the times of sparse alert rows.

    Fields the frame lacks count as absent. Everything is a projection, so the operator runs the
    same on batch and streaming frames and adds no shuffle.
    """
    df = _one_amount(df)
    df = df.withColumn("_own_id", _row_id(df))
    texts = {name for name, kind in df.dtypes if kind == "string"}
    numbers = ["fraud_probability", "hour_of_day", *[name for name in df.columns if name.lower() == "amount"]]
    parsed = {name: F.col(name).try_cast("double") for name in numbers if name in texts}
    df = times.with_parsed_times(df, S.ALERT_TIMES).withColumns(parsed)

    def field(name: str, dtype: str) -> Column:
        return risk.column_or_null(df, name, dtype)

    threshold = risk.normalize_threshold(
        F.coalesce(field("threshold", "double"), F.lit(float(default_threshold))), S.FLAG_THRESHOLD
    )
    given_id = field("transaction_id", "string").cast("string")
    given_action = field("recommended_action", "string")
    # Texts are parsed first, then fields are cleaned on their own, then come those derived from clean
    # ones: an expensive input is then evaluated once, not once for each place that uses it.
    clean = {
        "transaction_id": F.coalesce(F.when(given_id != "", given_id), F.col("_own_id")),
        "fraud_probability": risk.clip_probability(field("fraud_probability", "double")),
        "threshold": threshold,
        "Amount": risk.normalize_amount(risk.amount_column(df)),
        "hour_of_day": F.coalesce(times.document_hour(df), F.lit(0)),
        "_given": F.upper(field("decision", "string")),
        "recommended_action": F.when(given_action != "", given_action),
    }
    derived = ["risk_score", "block_threshold", "decision"]
    kept = [n for n in df.columns if n.lower() not in ("amount", "_own_id") and n not in clean and n not in derived]
    rows = df.select(*kept, *[c.alias(name) for name, c in clean.items()])

    p = F.col("fraud_probability")
    computed = risk.band_of(p, F.col("threshold"), min(max(float(save_threshold), 0.0), 1.0))
    given = F.when(F.col("_given").isin(S.DECISIONS), F.col("_given"))
    decision = computed if recompute_decision else F.coalesce(given, computed)
    action = F.coalesce(F.col("recommended_action"), risk.action_for(computed))
    return rows.select(
        *kept,
        *[name for name in clean if name not in ("_given", "recommended_action")],
        F.round(p * 100.0, 2).alias("risk_score"),
        F.col("threshold").alias("block_threshold"),
        decision.alias("decision"),
        action.alias("recommended_action"),
    )


def conform(df: DataFrame, schema: T.StructType = S.ALERT_SCHEMA) -> DataFrame:
    """The full alert schema, absent fields null; other columns go (stored alerts keep them, see unknown_fields)."""
    present = set(df.columns)
    return df.selectExpr(
        *[
            f"TRY_CAST({f'`{f.name}`' if f.name in present else 'NULL'} AS {f.dataType.simpleString()}) AS `{f.name}`"
            for f in schema.fields
        ]
    )


def above_cutoff(df: DataFrame, cutoff: float, strict: bool, column: str = "fraud_probability") -> DataFrame:
    """Alert cutoff: streams keep rows strictly above it, batch jobs rows at or above it."""
    return df.filter(F.col(column) > cutoff if strict else F.col(column) >= cutoff)


def assemble_alerts(
    scored: DataFrame,
    alert_threshold: float,
    reason: str,
    scored_at: datetime | None = None,
) -> DataFrame:
    """Add the alert metadata to scored transactions and drop the label from the model fields."""
    columns = {
        "stream_alert_threshold": F.lit(float(alert_threshold)),
        "alert_reason": F.lit(reason),
        "scored_at_utc": F.lit(scored_at) if scored_at else F.current_timestamp(),
    }
    if S.TARGET in scored.columns:
        columns["actual_class"] = F.col(S.TARGET).try_cast("int")
    return scored.withColumns(columns)


def display_alerts(
    df: DataFrame,
    model_threshold: float = S.MODEL_THRESHOLD,
    save_threshold: float = S.SAVE_THRESHOLD,
) -> DataFrame:
    """Normalised alerts with the display columns of the analyst views."""
    alerts = normalize_alerts(df, model_threshold, save_threshold)
    return alerts.withColumns(
        {
            "hour_of_day": F.least(F.greatest(F.col("hour_of_day"), F.lit(0)), F.lit(23)),
            "short_transaction_id": text.short_id(F.col("transaction_id")),
            "amount_display": text.currency(F.col("Amount")),
            "probability_display": text.probability_text(F.col("fraud_probability")),
            "risk_display": text.risk_text(F.col("risk_score")),
            "action_short": text.action_text(F.col("recommended_action")),
        }
    )


def export_columns(df: DataFrame) -> DataFrame:
    """The exported columns that the frame has, with formatted times."""
    chosen = df.select(*[name for name in S.EXPORT_COLUMNS if name in df.columns])
    return times.format_time_columns(chosen, S.DISPLAYED_TIMES)


def feed_table(df: DataFrame) -> DataFrame:
    """The alert feed: display texts under their short names, formatted times."""
    shown = {
        "short_transaction_id": "transaction_id",
        "merchant_name": "merchant_name",
        "amount_display": "amount",
        "probability_display": "fraud_probability",
        "risk_display": "risk_score",
        "decision": "decision",
        "action_short": "recommended_action",
        "event_time_utc": "event_time_utc",
        "stored_at_utc": "stored_at_utc",
    }
    chosen = df.select(*[F.col(c).alias(name) for c, name in shown.items() if c in df.columns])
    return times.format_time_columns(chosen, S.DISPLAYED_TIMES)


def alert_by_id(df: DataFrame, transaction_id: str) -> DataFrame:
    """One alert by id, normalised; the filter is applied first so that it reaches the scan."""
    return normalize_alerts(df.filter(F.col("transaction_id") == transaction_id).limit(1))


def recent_alerts(df: DataFrame, limit: int = 100) -> DataFrame:
    """Latest stored alerts, normalised after the cut."""
    stored = times.time_column(df, "stored_at_utc")
    return normalize_alerts(df.orderBy(stored.desc_nulls_last(), F.col("transaction_id")).limit(limit))


def driver_breakdown(df: DataFrame) -> DataFrame:
    """One row per stored driver of an alert with its direction and its place in that direction."""
    rows = df.select("transaction_id", F.inline("top_shap_features"))
    contribution = F.round(risk.finite(F.col("shap_value")), 4)
    observed = F.round(F.coalesce(F.col("feature_value"), F.col("value")).try_cast("double"), 4)
    rows = rows.select(
        "transaction_id",
        "feature",
        observed.alias("feature_value"),
        contribution.alias("shap_value"),
        F.when(contribution >= 0, "risk_increasing").otherwise("risk_decreasing").alias("direction"),
    )
    return rows.orderBy("transaction_id", "direction", F.abs("shap_value").desc(), "feature")


def increasing_drivers(breakdown: DataFrame) -> DataFrame:
    return breakdown.filter(F.col("shap_value") >= 0).orderBy(
        "transaction_id", F.col("shap_value").desc(), "feature"
    )


def decreasing_drivers(breakdown: DataFrame) -> DataFrame:
    return breakdown.filter(F.col("shap_value") < 0).orderBy("transaction_id", "shap_value", "feature")


def top_drivers(drivers: Column, n: int = 5) -> Column:
    """The n drivers with the largest absolute contribution, largest first."""

    def larger_first(a: Column, b: Column) -> Column:
        x, y = F.abs(a["shap_value"]), F.abs(b["shap_value"])
        return F.when(x > y, -1).when(x < y, 1).when(a["feature"] < b["feature"], -1).otherwise(1)

    return F.slice(F.array_sort(drivers, larger_first), 1, n)


def without_nans(value: Column, dtype: T.DataType) -> Column:
    """A value with NaN as null at every depth."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return risk.null_if_nan(value)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda item: without_nans(item, dtype.elementType))
    if isinstance(dtype, T.StructType):
        fields = [without_nans(value.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.MapType):
        return F.transform_values(value, lambda _, item: without_nans(item, dtype.valueType))
    return value


def joined_objects(first: Column, second: Column) -> Column:
    """One JSON object text from two that share no field; null or `{}` adds nothing."""
    empty = lambda text: text.isNull() | (text == "{}")
    both = F.concat(F.left(first, F.char_length(first) - 1), F.lit(","), F.substring(second, 2, 2**31 - 1))
    return F.when(empty(second), first).when(empty(first), second).otherwise(both)


def unknown_fields(df: DataFrame) -> Column:
    """The columns that the alert schema does not have, with those a variant `more` already holds, as one variant.

    NaN is null at every depth; a document without such fields has null. Labels and the marks of streams are left out.
    """
    known = {name.lower() for name in [*S.ALERT_SCHEMA.names, S.MORE, S.TARGET, "amount", "stored_date", "stream_name", "batch_id"]}
    fields = [f for f in df.schema.fields if f.name.lower() not in known and not f.name.startswith("_")]
    held = F.lit(None).cast("string")
    if S.MORE in df.columns and isinstance(df.schema[S.MORE].dataType, T.VariantType):
        held = F.to_json(S.MORE)
    if fields:
        own = F.to_json(F.struct(*[without_nans(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in fields]))
        held = joined_objects(held, own)
    return F.parse_json(F.when(held != "{}", held))


def json_documents(df: DataFrame) -> DataFrame:
    """Each alert as a JSON document: NaN as null at every depth, times as display text, unknown fields beside the others."""
    fields = [f for f in df.schema.fields if f.name != S.MORE]
    more = F.to_json(S.MORE) if S.MORE in df.columns else F.lit(None).cast("string")
    rows = df.select(*[without_nans(F.col(f.name), f.dataType).alias(f.name) for f in fields], more.alias("_more"))
    moments = [f.name for f in fields if isinstance(f.dataType, T.TimestampType)]
    shown = times.format_time_columns(rows, moments)
    own = text.compact_json(*[f.name for f in fields])
    return shown.select("transaction_id", joined_objects(own, F.col("_more")).alias("document"))

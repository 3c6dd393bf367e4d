"""Column lists, schemas and fixed values shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

TARGET = "Class"
BASE_FEATURES = ["Time", *[f"V{i}" for i in range(1, 29)], "Amount"]
ENGINEERED_FEATURES = ["amount_log", "hour_of_day", "is_night_transaction", "amount_zscore"]
FEATURES = BASE_FEATURES + ENGINEERED_FEATURES
RAW_COLUMNS = BASE_FEATURES + [TARGET]

# Decision bands, default thresholds, costs and action texts.
APPROVED, REVIEW, FLAGGED, BLOCKED = "APPROVED", "REVIEW", "FLAGGED", "BLOCKED"
DECISIONS = [APPROVED, REVIEW, FLAGGED, BLOCKED]
SAVE_THRESHOLD = 0.10
MODEL_THRESHOLD = 0.50
FLAG_THRESHOLD = 0.50
STREAM_CUTOFF = 0.5
FALSE_POSITIVE_COST = 1.0
FALSE_NEGATIVE_COST = 20.0
ACTIONS = {
    APPROVED: "Approve the transaction and continue passive monitoring.",
    REVIEW: "Route to the review queue and monitor related customer activity.",
    FLAGGED: "Hold for step-up authentication or manual analyst review before approval.",
    BLOCKED: "Block the transaction, notify the customer, and open a high-priority fraud investigation.",
}
AMOUNT_FROM_CSV = "raw_creditcard_csv"
AMOUNT_MISSING = "fallback_missing_amount"

# Column choices of the two alert tables shown to analysts.
EXPORT_COLUMNS = [
    "transaction_id",
    "merchant_name",
    "Amount",
    "fraud_probability",
    "risk_score",
    "decision",
    "recommended_action",
    "hour_of_day",
    "stored_at_utc",
]
DISPLAYED_TIMES = ["event_time_utc", "transaction_time_utc", "stored_at_utc", "last_alert_time"]


def _doubles(names: list[str]) -> list[T.StructField]:
    return [T.StructField(name, T.DoubleType(), True) for name in names]


def _strings(names: list[str]) -> list[T.StructField]:
    return [T.StructField(name, T.StringType(), True) for name in names]


def transaction_schema(include_target: bool = True) -> T.StructType:
    """Raw card transaction: 31 nullable doubles, 30 without the label."""
    return T.StructType(_doubles(RAW_COLUMNS if include_target else BASE_FEATURES))


def event_schema(include_target: bool = True) -> T.StructType:
    """Transaction event on the wire: metadata strings, the transaction, the amount's origin."""
    metadata = _strings(["transaction_id", "processing_timestamp", "merchant_name"])
    return T.StructType(
        metadata + transaction_schema(include_target).fields + _strings(["amount_source"])
    )


DRIVER_TYPE = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("feature_value", T.DoubleType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("shap_value", T.DoubleType()),
        T.StructField("direction", T.StringType()),
    ]
)
DRIVERS_TYPE = T.ArrayType(DRIVER_TYPE)

ALERT_TIMES = [
    "event_time_utc",
    "transaction_time_utc",
    "processing_timestamp",
    "scored_at_utc",
    "stored_at_utc",
]

ALERT_SCHEMA = T.StructType(
    _strings(["transaction_id", "merchant_name"])
    + _doubles(BASE_FEATURES)
    + _strings(["amount_source"])
    + _doubles(["fraud_probability", "risk_score", "threshold", "block_threshold"])
    + _strings(["decision", "recommended_action"])
    + [T.StructField("hour_of_day", T.IntegerType(), True)]
    + [T.StructField("top_shap_features", DRIVERS_TYPE, True)]
    + _doubles(["stream_alert_threshold"])
    + _strings(["alert_reason"])
    + [T.StructField("actual_class", T.IntegerType(), True)]
    + [T.StructField(name, T.TimestampType(), True) for name in ALERT_TIMES]
)

# Stored alerts keep the fields that this schema does not know, at any depth, in one variant.
MORE = "more"
STORED_ALERT_SCHEMA = T.StructType([*ALERT_SCHEMA.fields, T.StructField(MORE, T.VariantType(), True)])

SCORED_SCHEMA = T.StructType(
    [T.StructField("label", T.IntegerType()), T.StructField("score", T.DoubleType())]
)

CONFUSION_COUNTS = ["true_negatives", "false_positives", "false_negatives", "true_positives"]

THRESHOLD_METRICS_SCHEMA = T.StructType(
    _doubles(["threshold", "precision", "recall", "f1"])
    + [T.StructField(name, T.LongType(), True) for name in CONFUSION_COUNTS + ["predicted_fraud_count"]]
    + _doubles(["false_positive_cost", "false_negative_cost", "business_cost"])
)

MODEL_METRICS_SCHEMA = T.StructType(
    _strings(["model"])
    + _doubles(["precision", "recall", "f1", "auc", "auprc", "threshold"])
    + [
        T.StructField(name, T.LongType(), True)
        for name in CONFUSION_COUNTS + ["predicted_fraud_count", "fraud_cases", "validation_rows"]
    ]
    + _strings(["metric_source"])
)

FEATURE_STATS_SCHEMA = T.StructType(
    [
        T.StructField("generated_at_utc", T.TimestampType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("class_distribution", T.MapType(T.StringType(), T.LongType())),
        T.StructField("fraud_count", T.LongType()),
        T.StructField("non_fraud_count", T.LongType()),
        *_doubles(
            [
                "fraud_rate",
                "amount_mean",
                "amount_std",
                "amount_min",
                "amount_avg",
                "amount_median",
                "amount_max",
            ]
        ),
        T.StructField("feature_columns", T.ArrayType(T.StringType())),
    ]
)

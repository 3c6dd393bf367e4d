"""Numeric clean-up and decision bands as column expressions.

Text and numbers go through :func:`finite`, so NaN and infinities never reach a comparison:
Spark sorts NaN above every number, which would otherwise turn a broken value into a maximum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import schema as S

INFINITY = float("inf")


def finite_or_null(value: Column) -> Column:
    """Number, or null for unreadable text, NaN and infinities (NaN is not below infinity)."""
    number = value.try_cast("double")
    return F.when(F.abs(number) < INFINITY, number)


def finite(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(finite_or_null(value), F.lit(float(default)))


def _within(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(finite(value), F.lit(low)), F.lit(high))


def clip_probability(value: Column) -> Column:
    return _within(value, 0.0, 1.0)


def clip_risk_score(value: Column) -> Column:
    return _within(value, 0.0, 100.0)


def risk_score(probability: Column) -> Column:
    """Probability as a 0-100 score with two decimals."""
    return F.round(clip_probability(probability) * 100.0, 2)


def normalize_amount(value: Column) -> Column:
    return F.greatest(finite(value), F.lit(0.0))


def normalize_threshold(value: Column, minimum: float = 0.0) -> Column:
    return F.greatest(clip_probability(value), F.lit(float(minimum)))


def as_column(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def block_threshold(model_threshold: Column | float) -> Column:
    """Probability from which a transaction is blocked: the model threshold, at least 0.5."""
    return normalize_threshold(as_column(model_threshold), S.FLAG_THRESHOLD)


def band_of(probability: Column, block_at: Column | float, save_at: Column | float) -> Column:
    """Decision band of a probability and thresholds that are already clean."""
    return (
        F.when(probability >= block_at, S.BLOCKED)
        .when(probability >= S.FLAG_THRESHOLD, S.FLAGGED)
        .when(probability >= save_at, S.REVIEW)
        .otherwise(S.APPROVED)
    )


def decision_band(
    probability: Column,
    model_threshold: Column | float = S.MODEL_THRESHOLD,
    save_threshold: Column | float = S.SAVE_THRESHOLD,
) -> Column:
    return band_of(
        clip_probability(probability),
        block_threshold(model_threshold),
        clip_probability(as_column(save_threshold)),
    )


def action_for(decision: Column) -> Column:
    """Recommended action of a decision band."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in S.ACTIONS.items() for x in pair]), decision)


def classify(
    probability: Column,
    model_threshold: Column | float = S.MODEL_THRESHOLD,
    save_threshold: Column | float = S.SAVE_THRESHOLD,
) -> Column:
    """Struct of decision, block threshold and recommended action."""
    decision = decision_band(probability, model_threshold, save_threshold)
    return F.struct(
        decision.alias("decision"),
        block_threshold(model_threshold).alias("block_threshold"),
        action_for(decision).alias("recommended_action"),
    )


def column_or_null(df: DataFrame, name: str, dtype: str) -> Column:
    """The column when the frame has it, else a typed null: alert documents are sparse."""
    return F.col(name) if name in df.columns else F.lit(None).cast(dtype)


def amount_column(df: DataFrame) -> Column:
    """``Amount``, or the lower-case spelling when only that one is given."""
    return F.col("amount") if "amount" in df.columns else column_or_null(df, "Amount", "double")


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)

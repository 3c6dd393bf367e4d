"""Display texts, paths and JSON as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskspark.functions.risk import finite_or_null


def short_id(value: Column, width: int = 10) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    shortened = F.concat(F.substring(text, 1, width), F.lit("..."))
    return F.when(F.length(text) > width + 3, shortened).otherwise(text)


def currency(value: Column) -> Column:
    amount = F.format_string("$%,.2f", finite_or_null(value))
    return F.when(finite_or_null(value).isNull(), "$0.00").otherwise(amount)


def percent(value: Column) -> Column:
    text = F.format_string("%.1f%%", finite_or_null(value) * 100)
    return F.when(finite_or_null(value).isNull(), "0.0%").otherwise(text)


def risk_text(value: Column) -> Column:
    text = F.format_string("%.0f / 100", F.bround(finite_or_null(value), 0))
    return F.when(finite_or_null(value).isNull(), "0 / 100").otherwise(text)


def probability_text(value: Column) -> Column:
    """``N/A`` without a number, a capped text from 0.9995 up, else two decimals."""
    number = value.try_cast("double")
    p = F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0))
    return (
        F.when(number.isNull() | F.isnan(number), "N/A")
        .when(p >= 0.9995, "≥99.95%")
        .otherwise(F.format_string("%.2f%%", p * 100))
    )


def action_text(value: Column, length: int = 92) -> Column:
    return F.substring(F.coalesce(value, F.lit("")), 1, length)


def artifact_path(value: Column, fallback: Column | None = None) -> Column:
    """Path with forward slashes; the fallback replaces a missing or empty path."""
    given = F.when(value != "", value)
    chosen = given if fallback is None else F.coalesce(given, fallback)
    return F.replace(chosen, F.lit("\\"), F.lit("/"))


def compact_json(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns))

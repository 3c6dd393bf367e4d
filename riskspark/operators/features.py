"""Feature columns and dataset statistics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.functions.risk import finite_or_null, normalize_amount
from riskspark.functions.times import hour_of_seconds, is_night
from riskspark.operators.ranks import exact_quantiles

DEFAULT_STATS = {"amount_mean": 0.0, "amount_std": 1.0}


def require_columns(df: DataFrame, names: list[str], what: str) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns: {missing}")
    return df


def add_features(df: DataFrame, stats: Mapping[str, float] | None = None) -> DataFrame:
    """Add the four engineered columns.

    With ``stats`` the frozen mean and deviation are used, which also works on a streaming frame.
    Without it the statistics are a scalar subquery over the same rows, so the plan stays lazy.
    """
    amount = F.col("Amount")
    if stats is None:
        moments = df.agg(
            F.coalesce(F.avg("Amount"), F.lit(0.0)).alias("mean"),
            F.coalesce(F.stddev_pop("Amount"), F.lit(0.0)).alias("std"),
        )
        mean, std = moments.select("mean").scalar(), moments.select("std").scalar()
    else:
        mean = F.lit(float(stats.get("amount_mean") or 0.0))
        std = F.lit(float(stats.get("amount_std") or 0.0))
    hour = hour_of_seconds(F.col("Time"))
    return df.withColumns(
        {
            "amount_log": F.log1p(F.greatest(amount, F.lit(0.0))),
            "hour_of_day": hour.cast("double"),
            "is_night_transaction": F.when(is_night(hour), 1.0).otherwise(0.0),
            "amount_zscore": (amount - mean) / F.when(std > 0, std).otherwise(F.lit(1.0)),
        }
    )


def feature_vector(features: Sequence[str]) -> Column:
    """The features as an array of doubles."""
    return F.expr(f"array({', '.join(f'CAST(`{name}` AS double)' for name in features)})")


def scoring_features(df: DataFrame, stats: Mapping[str, float] | None = None) -> DataFrame:
    """Features for rows about to be scored: raw fields required, amounts never negative."""
    require_columns(df, S.BASE_FEATURES, "transaction")
    return add_features(df.withColumn("Amount", normalize_amount(F.col("Amount"))), stats or DEFAULT_STATS)


def model_columns(df: DataFrame) -> DataFrame:
    """The 34 features in model order, then the label."""
    return df.select(*S.FEATURES, S.TARGET)


def coerce_csv(df: DataFrame) -> DataFrame:
    """Text rows to typed transactions, recording where the amount came from."""
    amount = F.coalesce(
        *[finite_or_null(F.col(name)) for name in df.columns if name.lower() == "amount"],
        F.lit(None).cast("double"),
    )
    # Wide column lists are written as SQL text, which is much quicker to build than call by call.
    columns = {}
    for name in S.RAW_COLUMNS:
        kind = "int" if name == S.TARGET else "double"
        if name in df.columns:
            number = f"try_cast(CASE WHEN trim(`{name}`) <> '' THEN `{name}` END AS double)"
            columns[name] = F.expr(f"try_cast({number} AS {kind})")
        else:
            columns[name] = F.expr(f"CAST(NULL AS {kind})")
    columns["Amount"] = F.coalesce(amount, F.lit(0.0))
    columns["amount_source"] = F.when(amount.isNull(), S.AMOUNT_MISSING).otherwise(S.AMOUNT_FROM_CSV)
    return df.select(*[column.alias(name) for name, column in columns.items()])


def null_nans(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """NaN to null in the double columns."""
    doubles = [name for name, kind in df.dtypes if kind in ("double", "float")]
    chosen = doubles if names is None else [name for name in names if name in doubles]
    cleaned = {name: F.expr(f"CASE WHEN NOT isnan(`{name}`) THEN `{name}` END") for name in chosen}
    return df.withColumns(cleaned)


def complete(names: list[str] = S.BASE_FEATURES) -> Column:
    """True when every required field carries a number."""
    return F.expr(" AND ".join(f"(`{name}` IS NOT NULL AND NOT isnan(`{name}`))" for name in names))


def split_complete(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be scored, and the rejected rest with the names of the fields they lack.

    The test is on the fields as they come, so it can go down to the scan; only rejected rows need
    their NaN replaced.
    """
    require_columns(df, S.BASE_FEATURES, "transaction")
    absent = ", ".join(f"CASE WHEN `{name}` IS NULL THEN '{name}' END" for name in S.BASE_FEATURES)
    lacking = F.expr(f"array_compact(array({absent}))")
    rejected = null_nans(df.filter(~complete()), S.BASE_FEATURES)
    return df.filter(complete()), rejected.withColumn("missing_fields", lacking)


def only_negatives(df: DataFrame) -> DataFrame:
    return df.filter(F.col(S.TARGET) == 0)


def class_distribution(df: DataFrame) -> DataFrame:
    """Rows per class, missing class dropped, ordered by class."""
    return (
        df.filter(F.col(S.TARGET).isNotNull())
        .groupBy(F.col(S.TARGET).try_cast("int").alias(S.TARGET))
        .agg(F.count("*").alias("count"))
        .orderBy(S.TARGET)
    )


def _joined_deviation() -> Column:
    """Deviation over the records of all classes, joined by counts, means and squared differences.

    Differences are taken from means, never between large squares, so large amounts lose no digits.
    """
    part = F.struct(F.col("amounts").cast("double").alias("n"), "mean", (F.col("amounts") * F.col("variance")).alias("m2"))
    parts = F.array_sort(F.collect_list(F.when(F.col("amounts") > 0, part)))
    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def join(a: Column, b: Column) -> Column:
        n, apart = a["n"] + b["n"], b["mean"] - a["mean"]
        return F.struct(
            n.alias("n"), (a["mean"] + apart * b["n"] / n).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["n"] * b["n"] / n).alias("m2")
        )

    return F.aggregate(parts, none, join, lambda s: F.sqrt(F.try_divide(s["m2"], s["n"])))


def dataset_statistics(df: DataFrame, approximate_median: bool = False) -> DataFrame:
    """One record: counts, class map, amount summary and the feature list.

    Rows are first reduced to one partial record per class, so the class map and every other figure
    come from a single pass; the exact median is a rank selection (see ``ranks``), not a sort of
    all amounts in one task.
    """
    amount = F.col("Amount")
    per_class = df.groupBy(F.col(S.TARGET).try_cast("int").cast("string").alias("cls")).agg(
        F.count("*").alias("n"),
        F.count(amount).alias("amounts"),
        F.sum(amount).alias("total"),
        F.avg(amount).alias("mean"),
        F.var_pop(amount).alias("variance"),
        F.min(amount).alias("low"),
        F.max(amount).alias("high"),
    )
    counts = F.map_from_entries(
        F.array_sort(F.collect_list(F.when(F.col("cls").isNotNull(), F.struct("cls", "n"))))
    )

    def of_class(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("cls") == name, F.col("n"))), F.lit(0))

    mean = F.sum("total") / F.sum("amounts")
    if approximate_median:
        median = df.agg(F.percentile_approx(amount, 0.5).alias("value")).select("value").scalar()
    else:
        median = exact_quantiles(df, "Amount", [0.5]).select(F.col("quantiles")[0].alias("value")).scalar()

    def or_zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0))

    return (
        per_class.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
            counts.alias("class_distribution"),
            of_class("1").alias("fraud_count"),
            of_class("0").alias("non_fraud_count"),
            or_zero(mean).alias("amount_mean"),
            or_zero(_joined_deviation()).alias("amount_std"),
            or_zero(F.min("low")).alias("amount_min"),
            or_zero(F.max("high")).alias("amount_max"),
        )
        .withColumns(
            {
                "generated_at_utc": F.current_timestamp(),
                "fraud_rate": F.coalesce(F.try_divide("fraud_count", "row_count"), F.lit(0.0)),
                "amount_avg": F.col("amount_mean"),
                "amount_median": or_zero(median),
                "feature_columns": F.array(*[F.lit(name) for name in S.FEATURES]),
            }
        )
        .select(*S.FEATURE_STATS_SCHEMA.fieldNames())
    )


def class_weights(df: DataFrame) -> DataFrame:
    """Positive and negative training rows and the weight that balances them."""
    positives = F.count_if(F.col(S.TARGET) == 1)
    negatives = F.count_if(F.col(S.TARGET) == 0)
    return df.agg(
        positives.alias("positive_count"),
        negatives.alias("negative_count"),
        (negatives / F.greatest(positives, F.lit(1))).alias("scale_pos_weight"),
    )

"""Card transactions: CSV and parquet tables, statistics, holdout data, event enrichment."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.operators.features import DEFAULT_STATS, require_columns

MIN_ROWS = 100


def read_or_none(read: Callable[[], DataFrame]) -> DataFrame | None:
    """The frame, or None when its path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV table; only the header line is read."""
    return spark.read.option("header", True).csv(path).columns


def read_transactions_csv(
    spark: SparkSession, path: str, min_rows: int = MIN_ROWS, max_rows: int | None = None
) -> DataFrame:
    """Typed CSV scan of the 31 columns, checked for columns and for a plausible row count.

    The header is read once for the check, then the data with a fixed schema in the file's own
    column order; at most ``min_rows`` rows are read to check the size.
    """
    names = csv_header(spark, path)
    missing = [name for name in S.RAW_COLUMNS if name not in names]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    columns = ", ".join(f"`{name}` {'double' if name in S.RAW_COLUMNS else 'string'}" for name in names)
    rows = spark.read.schema(columns).option("header", True).csv(path).select(*S.RAW_COLUMNS)
    if min_rows and rows.limit(min_rows).count() < min_rows:
        raise ValueError(f"The dataset has fewer than {min_rows} rows.")
    return rows if max_rows is None else rows.limit(max_rows)


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV rows as text, for coercion with recorded amount origin."""
    return spark.read.option("header", True).csv(path)


def write_features(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_features(
    spark: SparkSession, path: str, build: Callable[[], None] | None = None
) -> DataFrame:
    """Feature table with its column check; ``build`` is called first when the table is absent."""
    rows = read_or_none(lambda: spark.read.parquet(path))
    if rows is None and build is not None:
        build()
        rows = spark.read.parquet(path)
    if rows is None:
        raise FileNotFoundError(f"no feature table at {path}")
    require_columns(rows, [*S.FEATURES, S.TARGET], "feature table")
    return rows.select(*S.FEATURES, S.TARGET)


def write_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").json(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """The statistics record, or mean 0 and deviation 1 when none was written."""
    found = read_or_none(lambda: spark.read.schema(S.FEATURE_STATS_SCHEMA).json(path))
    if found is not None:
        return found
    names = F.array(*[F.lit(name) for name in S.FEATURES])
    default = {**{k: F.lit(v) for k, v in DEFAULT_STATS.items()}, "feature_columns": names}
    return spark.range(1).select(
        *[
            default.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in S.FEATURE_STATS_SCHEMA.fields
        ]
    )


def frozen_stats(stats: DataFrame) -> Mapping[str, float]:
    """Mean and deviation as numbers; the record has one row."""
    return stats.select("amount_mean", "amount_std").first().asDict()


def write_holdout(df: DataFrame, path: str) -> None:
    df.select(*S.FEATURES, S.TARGET).write.mode("overwrite").parquet(path)


def read_holdout(spark: SparkSession, path: str) -> DataFrame:
    rows = read_or_none(lambda: spark.read.parquet(path))
    if rows is None:
        raise FileNotFoundError(f"no validation table at {path}")
    require_columns(rows, [*S.FEATURES, S.TARGET], "validation table")
    features = [F.col(name).cast("double").alias(name) for name in S.FEATURES]
    return rows.select(*features, F.col(S.TARGET).cast("int").alias(S.TARGET))


def enrich_events(
    df: DataFrame,
    merchants: Sequence[str] = (),
    now: datetime | None = None,
    seed: int = 42,
    key: Sequence[str] | None = None,
) -> DataFrame:
    """Give replayed transactions an id and a processing time, and a merchant of the caller's list, if there is one.

    All choices come from a seeded hash of the row (or of ``key``), so a recomputed partition yields
    the same events.
    """
    names = [F.col(name) for name in (key or df.columns)]
    draw = F.xxhash64(F.lit(seed), *names)
    other = F.xxhash64(F.lit(seed + 1), *names)
    merchant = F.lit(None).cast("string")
    if merchants:
        merchant = F.array(*[F.lit(m) for m in merchants])[F.pmod(draw, F.lit(len(merchants))).cast("int")]
    columns = {
        "transaction_id": F.lower(F.concat(F.lpad(F.hex(draw), 16, "0"), F.lpad(F.hex(other), 16, "0"))),
        "processing_timestamp": F.lit(now) if now else F.current_timestamp(),
        "merchant_name": merchant,
    }
    return df.withColumns(columns)

"""Threshold tables and run records of training and tuning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.sources.transactions import read_or_none


def write_threshold_metrics(sweep: DataFrame, path: str) -> None:
    sweep.orderBy("threshold").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_threshold_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """The threshold table, or None when tuning has not run."""
    return read_or_none(
        lambda: spark.read.schema(S.THRESHOLD_METRICS_SCHEMA).option("header", True).csv(path)
    )


def append_record(record: DataFrame, path: str) -> None:
    """Append one run record; records are never changed, the latest one counts."""
    stamped = record.withColumn("recorded_at_utc", F.current_timestamp())
    stamped.coalesce(1).write.mode("append").option("mergeSchema", True).parquet(path)


def latest_record(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """The latest run record of a kind (``training``, ``tuning``)."""
    rows = read_or_none(lambda: spark.read.option("mergeSchema", True).parquet(path))
    if rows is None:
        return None
    return rows.filter(F.col("kind") == kind).orderBy(F.desc("recorded_at_utc")).limit(1)


def training_record(
    spark: SparkSession,
    comparison: DataFrame,
    best_model: str,
    threshold: float,
    dataset: DataFrame,
    oversampling: dict[str, object],
) -> DataFrame:
    """One row about a training run: models, champion, threshold, dataset and oversampling."""
    models = comparison.agg(
        F.map_from_entries(F.collect_list(F.struct("model", F.struct(*comparison.columns)))).alias("m")
    )
    data = dataset.select(F.struct(*dataset.columns).alias("d"))
    notes = [x for k, v in oversampling.items() for x in (F.lit(k), F.lit(str(v)))]
    return spark.range(1).select(
        F.lit("training").alias("kind"),
        F.lit(best_model).alias("best_model"),
        F.lit(float(threshold)).alias("threshold"),
        models.select("m").scalar().alias("models"),
        data.select("d").scalar().alias("dataset"),
        F.create_map(*notes).alias("oversampling"),
    )


def tuning_record(chosen: DataFrame, grid_size: int) -> DataFrame:
    """One row about a tuning run: both chosen threshold rows, the costs and the grid size."""

    def of(choice: str, name: str) -> Column:
        return F.max(F.when(F.col("choice") == choice, F.col(name)))

    row = F.struct(*[name for name in chosen.columns if name != "choice"])
    by_choice = F.map_from_entries(F.collect_list(F.struct(F.col("choice"), row)))
    return chosen.agg(
        F.lit("tuning").alias("kind"),
        of("best_f1_threshold", "threshold").alias("threshold"),
        by_choice.alias("choices"),
        F.max("false_positive_cost").alias("false_positive_cost"),
        F.max("false_negative_cost").alias("false_negative_cost"),
        F.lit(grid_size).alias("threshold_grid_size"),
    )

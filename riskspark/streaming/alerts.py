"""Scoring a transaction stream into the alert table, and live views over alerts."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskspark import schema as S
from riskspark.operators.alerts import above_cutoff, assemble_alerts
from riskspark.operators.features import split_complete
from riskspark.operators.models import ScoringModel, score_transactions
from riskspark.operators.reports import day_hour_figures, fill_hours, hourly_counts
from riskspark.sources.alerts import storable
from riskspark.sources.transactions import read_or_none

TRIGGER = "10 seconds"
CORRUPT = "_corrupt_record"
ROWS_PER_FILE = 1_000_000
FOLD_EVERY = 50  # batches between two whole copies of the view per day and hour
DAY_HOUR_SCHEMA = (
    "day date, hour_of_day int, fraud_alerts long, total_probability double, max_probability double, "
    "total_risk_score double, max_risk_score double, total_amount double, blocked_count long, flagged_count long"
)
log = logging.getLogger(__name__)


def parse_messages(messages: DataFrame) -> DataFrame:
    """JSON message texts to typed transaction events; unreadable text is kept beside null fields."""
    schema = T.StructType([*S.event_schema().fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    return messages.select(F.from_json("value", schema, options).alias("data")).select("data.*")


Scorer = Callable[[DataFrame], DataFrame]


# Figures of a micro-batch, as a table.
FIGURES_SCHEMA = "batch_id long, rows long, scored long, rejected long, flagged long, avg_probability double, max_probability double"
FIGURES = [column.split()[0] for column in FIGURES_SCHEMA.split(", ")]


def _batch_moment(spark: SparkSession, path: str) -> datetime:
    """When the batch was first tried: recorded once, and found again by a replay."""
    found = read_or_none(lambda: spark.read.schema("moment long").parquet(path))
    row = found.first() if found is not None else None
    if row is None:
        now = datetime.now(timezone.utc)
        row = (int(now.timestamp() * 1_000_000),)
        spark.createDataFrame([row], "moment long").coalesce(1).write.mode("overwrite").parquet(path)
    return datetime.fromtimestamp(row[0] / 1_000_000, timezone.utc)


def write_batch(
    batch: DataFrame,
    batch_id: int,
    score: Scorer,
    path: str,
    quarantine_path: str,
    stream_name: str,
    alert_threshold: float = S.STREAM_CUTOFF,
) -> dict[str, object]:
    """Score one micro-batch, store its alerts, set unscorable rows aside, return its figures.

    Alerts lie by the day the batch was first tried, stream and batch; quarantined rows by stream and batch. Both
    folders are overwritten on a replay, and a replay finds the recorded moment of its batch, so that a repeated
    batch leaves no duplicates. The figures are kept as a table beside the alerts (see read_batch_figures).
    """
    folder = f"stream_name={stream_name}/batch_id={batch_id}"
    moment = _batch_moment(batch.sparkSession, f"{path}_batches/started/{folder}")
    kept = batch.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ready, rejected = split_complete(kept)
        figures = Observation()
        scored = score(ready.drop(CORRUPT)).observe(
            figures,
            F.count(F.lit(1)).alias("scored"),
            F.count_if(F.col("fraud_probability") > alert_threshold).alias("flagged"),
            F.coalesce(F.avg("fraud_probability"), F.lit(0.0)).alias("avg_probability"),
            F.coalesce(F.max("fraud_probability"), F.lit(0.0)).alias("max_probability"),
        )
        reason = f"fraud_probability_above_{alert_threshold}"
        alerts = assemble_alerts(above_cutoff(scored, alert_threshold, strict=True), alert_threshold, reason)
        storable(alerts, moment).write.mode("overwrite").parquet(f"{path}/stored_date={moment:%Y-%m-%d}/{folder}")
        aside = Observation()
        rejected = rejected.observe(aside, F.count(F.lit(1)).alias("rejected"))
        rejected.write.mode("overwrite").parquet(f"{quarantine_path}/{folder}")
        result = {"batch_id": batch_id, **figures.get, **aside.get}
        result["rows"] = result["scored"] + result["rejected"]
        record = kept.sparkSession.createDataFrame([tuple(result[name] for name in FIGURES)], FIGURES_SCHEMA)
        record.coalesce(1).write.mode("overwrite").parquet(f"{path}_batches/figures/{folder}")
        log.info("%s", result)
        return result
    finally:
        kept.unpersist()


def start_alert_stream(
    messages: DataFrame,
    score: Scorer,
    path: str,
    quarantine_path: str,
    checkpoint: str,
    stream_name: str,
    alert_threshold: float = S.STREAM_CUTOFF,
    trigger: str | None = TRIGGER,
) -> StreamingQuery:
    """Score a message stream into the alert table. ``trigger=None`` drains what is there and stops.

    A new checkpoint restarts batch numbers, so give it a new stream name.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, score, path, quarantine_path, stream_name, alert_threshold)

    writer = (
        parse_messages(messages)
        .writeStream.foreachBatch(sink)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    return writer.start()


def read_stream_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alerts stored by streams, with their stream name and batch."""
    rows = read_or_none(lambda: spark.read.schema(S.ALERT_SCHEMA).parquet(path))
    return spark.createDataFrame([], S.ALERT_SCHEMA) if rows is None else rows


def read_batch_figures(spark: SparkSession, path: str) -> DataFrame:
    """Figures of all micro-batches written to the alert table at path, with their stream name."""
    rows = read_or_none(lambda: spark.read.schema(f"{FIGURES_SCHEMA}, stream_name string").parquet(f"{path}_batches/figures"))
    return spark.createDataFrame([], f"{FIGURES_SCHEMA}, stream_name string") if rows is None else rows


def compact_day(spark: SparkSession, path: str, out_path: str, stored_date: str) -> int:
    """Copy one day's many small alert folders into files of up to about ROWS_PER_FILE alerts of a compacted table; returns its alerts."""
    day = read_stream_alerts(spark, path).filter(F.col("stored_date") == F.lit(stored_date).cast("date"))
    files = max(1, math.ceil(day.count() / ROWS_PER_FILE))
    day.drop("stored_date").repartition(files).write.mode("overwrite").parquet(f"{out_path}/stored_date={stored_date}")
    return spark.read.parquet(f"{out_path}/stored_date={stored_date}").count()


def model_scorer(model: ScoringModel) -> Scorer:
    """Scoring of a stream by a trained model."""
    return lambda rows: score_transactions(rows, model)


def _start_view(
    counts: DataFrame, finish: Scorer, path: str, checkpoint: str, trigger: str | None
) -> StreamingQuery:
    def replace(batch: DataFrame, batch_id: int) -> None:
        finish(batch).repartition(1).write.mode("overwrite").parquet(path)

    writer = (
        counts.writeStream.foreachBatch(replace)
        .outputMode("complete")
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    return writer.start()


def start_hourly_view(
    alerts: DataFrame, path: str, checkpoint: str, trigger: str | None = TRIGGER
) -> StreamingQuery:
    """Keep the 24-hour profile of an alert stream up to date in a table."""
    return _start_view(hourly_counts(alerts), fill_hours, path, checkpoint, trigger)


def write_day_hours(batch: DataFrame, batch_id: int, path: str, fold_every: int = FOLD_EVERY) -> None:
    """Store the keys (day, hour) that a micro-batch changed, with their new figures; after every fold_every batches the whole view.

    A batch has a folder of its own, which a replay overwrites with the same rows. Rows are 24 a day at most. They are
    shuffled into their one file: coalesced, one task would hold the memory of all partitions of the aggregation.
    """
    epoch = batch_id // fold_every
    batch.repartition(1).write.mode("overwrite").parquet(f"{path}/changes/epoch={epoch}/batch_id={batch_id}")
    if (batch_id + 1) % fold_every == 0:
        whole = _day_hours(batch.sparkSession, path, epoch, fold_every)
        whole.repartition(1).write.mode("overwrite").parquet(f"{path}/whole/epoch={epoch}")


def _day_hours(spark: SparkSession, path: str, epoch: int, fold_every: int) -> DataFrame:
    """The view of the epochs before this one, with the changes of this one merged in by key."""

    def rows(folder: str, schema: str) -> DataFrame:
        found = read_or_none(lambda: spark.read.schema(schema).parquet(folder))
        return spark.createDataFrame([], schema) if found is None else found

    changes = rows(f"{path}/changes/epoch={epoch}", f"{DAY_HOUR_SCHEMA}, batch_id long")
    before = rows(f"{path}/whole/epoch={epoch - 1}", DAY_HOUR_SCHEMA).withColumn("batch_id", F.lit(-1).cast("long"))
    figures = F.struct(*[c for c in changes.columns if c not in ("day", "hour_of_day", "batch_id")])
    latest = before.unionByName(changes).groupBy("day", "hour_of_day").agg(F.max_by(figures, "batch_id").alias("f"))
    return latest.select("day", "hour_of_day", "f.*")


def read_day_hours(spark: SparkSession, path: str, fold_every: int = FOLD_EVERY) -> DataFrame:
    """Figures per day and hour of all alerts that the view at path has seen; of each key what its last batch wrote.

    Only the last whole copy and the changes after it are read. fold_every must be that of the writer; no view has no rows.
    """
    folds = read_or_none(lambda: spark.read.schema("day date, epoch long").parquet(f"{path}/whole"))
    last = None if folds is None else folds.agg(F.max("epoch")).first()[0]
    return _day_hours(spark, path, 0 if last is None else last + 1, fold_every)


def start_day_hour_view(
    alerts: DataFrame, path: str, checkpoint: str, trigger: str | None = TRIGGER, fold_every: int = FOLD_EVERY
) -> StreamingQuery:
    """Keep figures per day and hour of an alert stream up to date (see read_day_hours), writing only what a batch changed.

    The stream's state holds the figures of every key, so a changed key is written with its new totals, never with a
    difference that a replay could add twice. A new checkpoint counts from nothing, so give it a new path.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        write_day_hours(batch, batch_id, path, fold_every)

    writer = (
        day_hour_figures(alerts)
        .writeStream.foreachBatch(merge)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    return writer.start()


def start_kpi_view(
    alerts: DataFrame,
    summary: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    trigger: str | None = TRIGGER,
) -> StreamingQuery:
    """Keep a one-row summary of an alert stream up to date in a table."""
    return _start_view(summary(alerts), lambda batch: batch, path, checkpoint, trigger)


def replay_files(spark: SparkSession, schema: T.StructType, path: str, files_per_trigger: int) -> DataFrame:
    """A stored table as a stream, some files at a time."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )

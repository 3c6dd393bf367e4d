"""Transaction messages: JSON text in a Kafka topic, or in text files of the same lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.functions.text import compact_json
from riskspark.operators.features import split_complete
from riskspark.sources.transactions import enrich_events


def kafka_stream(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Message texts of a topic from the latest offset on. Needs Spark's Kafka package."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "latest")
        .options(**options)
    )
    return reader.load().select(F.col("value").cast("string").alias("value"))


def text_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same messages from a folder of text files, one message per line."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path)


def transaction_messages(
    transactions: DataFrame, max_messages: int | None = None, seed: int = 42
) -> DataFrame:
    """Compact JSON messages of the transactions that carry every required field.

    Rows with NaN or missing fields are refused: JSON has no NaN. The cap is optional.
    """
    rows = transactions if max_messages is None else transactions.limit(max_messages)
    ready, _ = split_complete(rows)
    events = enrich_events(ready, seed=seed)
    names = [name for name in S.event_schema().fieldNames() if name in events.columns]
    return events.select(F.col("transaction_id").alias("key"), compact_json(*names).alias("value"))


def publish_kafka(messages: DataFrame, servers: str, topic: str) -> None:
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def publish_text(messages: DataFrame, path: str) -> None:
    messages.select("value").write.mode("append").text(path)

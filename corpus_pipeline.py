"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, byte-level BPE.

Each stage works on the stored result of the one before; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import byte_bpe, decontaminate, line_dedup, near_dedup, quality
from riskspark.llm.common import in_place, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is long enough and not too repetitive; null and empty texts go, repeated rows are judged alike."""
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that equal or nearly equal an earlier one; documents that lose all lines go. n_chars is set anew.

    Every non-blank line that equals an earlier one goes, however short, so an exact copy leaves nothing behind. Null and empty texts stay (n_chars of null is null); of repeated rows the first keeps its lines.
    """
    kept = line_dedup.drop_repeated_lines(docs, every_line=True)
    kind = docs.schema["n_chars"].dataType
    return in_place(kept, lambda df: df.withColumn("n_chars", F.char_length("text").cast(kind)), text="text", n_chars="n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the smallest id; texts without words stay."""
    return near_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a notable share of benchmark passages; texts without words stay."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe_coding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (packed, little-endian, 32 bits each), and digests of them and of what they decode to.

    Null and empty texts have no ids; repeated rows each give a row.
    """
    coded = byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte-level BPE", byte_bpe_coding),
]

ORACLE_SQL = None  # near-duplicate classes and BPE ids are beyond SQL; tests hold all stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, with all its columns up to the last stage; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *filters, (_, last) = STAGES
    for name, stage in filters:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return last(spark, docs, sf_dir)

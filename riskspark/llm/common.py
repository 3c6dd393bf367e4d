"""Helpers of the text operators: picking columns, work tables, sub-batches inside a task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.session import shared_folder

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns of df under new names (new=old), and nothing else.

    Columns are found by place: first by exact name, then without regard to case. So other columns of any name,
    also such as differ from these by case alone or equal names used inside an operator, cannot clash.
    """
    own = df.columns
    chosen = {}
    for new, old in columns.items():
        places = [i for i, c in enumerate(own) if c == old] or [i for i, c in enumerate(own) if c.lower() == old.lower()]
        if not places:
            raise ValueError(f"no column {old!r} among {own}")
        chosen[new] = places[0]
    placed = df.toDF(*[f"c{i}" for i in range(len(own))])
    return placed.select(*[F.col(f"c{i}").alias(new) for new, i in chosen.items()])


def in_place(docs: DataFrame, work: Callable[[DataFrame], DataFrame], **columns: str) -> DataFrame:
    """work(docs) with docs' own columns, where work may change the named columns (new=old) and drop rows.

    The named columns are found as pick does; all others have names that nothing else has while work runs, so a column of
    any name is kept, also such as work uses itself.
    """
    own = docs.columns
    held = [f"c{i}" for i in range(len(own))]
    for new, old in columns.items():
        places = [i for i, c in enumerate(own) if c == old] or [i for i, c in enumerate(own) if c.lower() == old.lower()]
        if not places:
            raise ValueError(f"no column {old!r} among {own}")
        held[places[0]] = new
    return work(docs.toDF(*held)).select(*held).toDF(*own)


_holders: dict[str, Callable[[], None]] = {}


def holds_cache(operator: str, release: Callable[[], None]) -> None:
    """Say in a Python worker that an operator fills a cache there; what other operators left is let go first."""
    for other in [name for name in _holders if name != operator]:
        _holders.pop(other)()
    _holders[operator] = release


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds by bytes, so long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared work folder and read again: lineage ends there and survives lost executors.

    Shuffle files of the writing job are given back when it ends; nothing reads them again.
    """
    spark = df.sparkSession
    path = shared_folder(spark, f"llm-{name}")
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def with_row_id(df: DataFrame, name: str = "row") -> DataFrame:
    """df with a number for each row, the same whenever the same scan is computed again.

    It is made from the scan's partition and the place in it, so equal rows stay apart. df must read tables or files
    (or be stored first): rows that come out of a shuffle have no fixed order.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def text_blocks(texts: Iterable[str | None], most: int) -> Iterator[list[str]]:
    """Lists of texts of at most `most` characters together; a longer text is a list of its own. Null becomes empty."""
    block: list[str] = []
    held = 0
    for text in texts:
        text = text or ""
        if block and held + len(text) > most:
            yield block
            block, held = [], 0
        block.append(text)
        held += len(text)
    if block:
        yield block

"""Token counts by a map-side lookup of two tiers.

The tokenizer splits a text into pre-tokens and each pre-token into tokens, so a text's count is the sum over its
pre-tokens. Tier one is a compact table of frequent pre-tokens and their token counts, broadcast to all workers
(FREQUENT entries at most). Tier two is a cache in each Python worker: what tier one lacks is encoded by the library
once and kept, up to a bound. The counts are one pass over the texts that shuffles nothing.

Tier one is found by a pass of its own over all texts that shuffles no pre-tokens either: each task keeps a Misra-Gries
summary of SUMMARY counters, and summaries, one row a task, are merged MERGED at a time in a tree, each merge again cut to
SUMMARY counters. A pre-token that makes up more than one in SUMMARY of all is surely in the last summary, and its
counter is too low by at most that share. The table only saves work and never changes a count.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import pick, small_batches, stored
from riskspark.llm.pretokens import Splitter, is_plain

FREQUENT = 32_768
SUMMARY = 4 * FREQUENT  # counters of a summary
MERGED = 16  # summaries that one task merges
CACHED_ENTRIES = 1_000_000
CACHED_CHARS = 64

#: The vocabulary file's special strings (each one token) and its pre-token pattern.
SPECIAL = re.compile(r"<\|startoftext\|>|<\|endoftext\|>")
PRE_TOKEN = Splitter(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

_loaded: dict[str, "Lengths"] = {}


class Lengths(dict):
    """Worker cache: token counts by pre-token, encoded by the library on a miss."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __missing__(self, word: str) -> int:
        n = len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_ENTRIES:
                self.clear()
            self[word] = n
        return n

    def words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings, normalized."""
        # Plain texts need no composition, and Python and the library agree on their lower case.
        return PRE_TOKEN(text.lower() if is_plain(text) else self.tokenizer.normalizer.normalize_str(text))

    def pieces(self, text: str) -> list[str]:
        """The text between special strings."""
        return SPECIAL.split(text) if "text|>" in text else [text]


class Frequent(dict):
    """Tier one; what it lacks is asked of the worker's cache."""

    def __init__(self, table: dict[str, int], rest: Lengths):
        super().__init__(table)
        self.rest = rest

    def __missing__(self, word: str) -> int:
        return self.rest[word]


def lengths(path: str) -> Lengths:
    """One per Python worker, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = Lengths(path)
    return _loaded[path]


def shrink(counts: Counter, most: int) -> None:
    """Cut a Misra-Gries summary to at most `most` counters: all lose the largest count that has no place, the rest go."""
    if len(counts) > most:
        lost = sorted(counts.values(), reverse=True)[most]
        kept = {w: n - lost for w, n in counts.items() if n > lost}
        counts.clear()
        counts.update(kept)


SUMMARIES = "place long, words array<string>, ns array<long>"


def _summary_row(place: int, counts: Counter) -> pa.RecordBatch:
    words, ns = pa.array([list(counts)], pa.list_(pa.string())), pa.array([list(counts.values())], pa.list_(pa.int64()))
    return pa.record_batch({"place": pa.array([place], pa.int64()), "words": words, "ns": ns})


def task_summaries(texts: DataFrame, path: str, counters: int) -> DataFrame:
    """place (0, 1, ... by task), words and ns: a summary of the pre-tokens of each task's texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = lengths(path), Counter()
        for batch in batches:
            for text in batch.column("text"):
                for piece in own.pieces(text.as_py() or ""):
                    seen.update(w for w in own.words(piece) if len(w) <= CACHED_CHARS)
                if len(seen) > 2 * counters:
                    shrink(seen, counters)
        shrink(seen, counters)
        yield _summary_row(TaskContext.get().partitionId(), seen)

    return texts.select("text").mapInArrow(count, SUMMARIES)


def merge_summaries(summaries: DataFrame, counters: int, merged: int = MERGED) -> DataFrame:
    """One summary of all (no row if there are none), merged `merged` at a time."""

    def merge(rows: pa.Table) -> pa.Table:
        seen: Counter = Counter()
        for words, ns in zip(rows.column("words"), rows.column("ns")):
            for word, n in zip(words.as_py(), ns.as_py()):
                seen[word] += n
            if len(seen) > 2 * counters:
                shrink(seen, counters)
        shrink(seen, counters)
        return pa.Table.from_batches([_summary_row(rows.column("place")[0].as_py() // merged, seen)])

    held = stored(summaries, "summaries")
    while held.count() > 1:
        grouped = held.groupBy((F.col("place") / merged).cast("long"))
        held = stored(grouped.applyInArrow(merge, SUMMARIES), "summaries")
    return held


def frequent_lengths(texts: DataFrame, path: str, most: int = FREQUENT, counters: int = SUMMARY) -> dict[str, int]:
    """Token counts of the `most` most frequent pre-tokens in all of column `text`, by a summary of `counters` counters."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lengths(path)
        for batch in batches:
            for words, ns in zip(batch.column("words"), batch.column("ns")):
                top = [w for _, w in sorted((-n, w) for w, n in zip(words.as_py(), ns.as_py()))[:most]]
                yield pa.record_batch({"word": pa.array(top, pa.string()), "tokens": pa.array([own[w] for w in top], pa.int32())})

    summary = merge_summaries(task_summaries(texts, path, counters), counters)
    return {r.word: r.tokens for r in summary.mapInArrow(encode, "word string, tokens int").collect()}


def count_tokens(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every text, as the library counts it without begin or end tokens.

    Null is the empty text: no bytes, no tokens. Special strings inside a text are one token each, as the library has
    them. Equal rows each give a row, a null id stays null, an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = pick(docs, doc_id=id_column, text=text_column)
    table = spark.sparkContext.broadcast(frequent_lengths(rows.select("text"), path))

    @F.arrow_udf("long")
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = lengths(path)
        size = Frequent(table.value, own).__getitem__
        for batch in batches:
            counts = []
            for text in batch:
                pieces = own.pieces(text.as_py() or "")
                counts.append(len(pieces) - 1 + sum(map(size, chain.from_iterable(map(own.words, pieces)))))
            yield pa.array(counts, pa.int64())

    return rows.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        tokens("text").alias("n_tokens"),
    )

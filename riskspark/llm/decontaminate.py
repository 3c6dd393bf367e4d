"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts are lower-cased (A-Z), everything but words becomes one space, and every window of a benchmark item is a byte
string ` w1 w2 ... ` that is searched for in the texts. The shift table of a pattern class says, for the block of bytes
at the end of the search window, how far the window may move without passing an occurrence; only where the shift is
zero does the hash of the block select a bucket of patterns, which are compared byte by byte. Many windows move at a
time, one in each lane of a buffer of texts, so the search is array work.

Patterns are put into classes by length, so that a few short ones do not make the shifts of all short. Windows of the
benchmark are dealt into blocks of bounded size; each block is broadcast and searched for in all texts, one block after
the other, and what the blocks found is united. So the benchmark may be of any size, and texts are never shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import in_place, pick, small_batches

WINDOW_WORDS = 13
BLOCK_BYTES = 64 << 20  # most bytes of windows broadcast at a time
BUFFER_BYTES = 4 << 20
LANES = 4096
SEARCH_BYTES = 256  # most of a pattern's first bytes that the shift table covers
TABLE_BITS = 20
CLASSES = (24, 12, 6, 3)  # least pattern length of each class; a pattern is a word and two spaces at least

#: Fixed value: what a word is (over lower-cased text).
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
FOUND = "struct<n_words:bigint,spans:array<struct<first:bigint,end:bigint>>,items:array<string>>"


def spaced_words(text: str) -> tuple[bytes, int]:
    """The words of a text with one space before, between and after them, and their number."""
    words = text.encode().translate(_TO_WORDS).split()
    return (b" " + b" ".join(words) + b" " if words else b""), len(words)


class PatternClass:
    """Shift table and buckets of patterns that are at least `self.m` bytes long."""

    def __init__(self, patterns: list[bytes]):
        self.m = m = min(SEARCH_BYTES, min(map(len, patterns)))
        self.block = block = min(8, max(2, m // 2))
        self.mask = np.uint64((1 << 8 * block) - 1)
        heads = np.frombuffer(b"".join(p[:m] + b"\0" * 8 for p in patterns), np.uint8).reshape(len(patterns), m + 8)
        self.shift = np.full(1 << TABLE_BITS, m - block + 1, np.uint16)
        for j in range(m - block + 1):
            values = np.ascontiguousarray(heads[:, j : j + 8]).view("<u8").ravel()
            np.minimum.at(self.shift, self.slot(values & self.mask), np.uint16(m - block - j))
        self.buckets: dict[tuple[int, int], list[bytes]] = defaultdict(list)
        firsts = np.ascontiguousarray(heads[:, :8]).view("<u8").ravel() & self.mask
        lasts = np.ascontiguousarray(heads[:, m - block : m - block + 8]).view("<u8").ravel() & self.mask
        for pattern, first, last in zip(patterns, firsts.tolist(), lasts.tolist()):
            self.buckets[last, first].append(pattern)

    @staticmethod
    def slot(values: np.ndarray) -> np.ndarray:
        return ((values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, buffer: bytes, end: int) -> list[tuple[int, bytes]]:
        """(place, pattern) of every occurrence in buffer[:end]; the buffer has eight bytes more."""
        m, block = self.m, self.block
        if end < m:
            return []
        words = np.ndarray(shape=(end,), dtype="<u8", buffer=buffer, strides=(1,))  # eight bytes from each place on
        places = end - m + 1  # starts of a search window
        lane = max(256, -(-places // LANES))
        at = np.arange(0, places, lane, dtype=np.int64)
        stop = np.minimum(at + lane, places)
        found = []
        while at.size:
            last = words[at + (m - block)] & self.mask
            step = self.shift[self.slot(last)].astype(np.int64)
            hit = np.flatnonzero(step == 0)
            if hit.size:
                starts = at[hit]
                firsts = words[starts] & self.mask
                for start, key in zip(starts.tolist(), zip(last[hit].tolist(), firsts.tolist())):
                    for pattern in self.buckets.get(key, ()):
                        if buffer.startswith(pattern, start):
                            found.append((start, pattern))
                step[hit] = 1
            at += step
            more = at < stop
            if not more.all():
                at, stop = at[more], stop[more]
        return found


class Matcher:
    """All patterns of a block; each has its number of words and the items it comes from."""

    def __init__(self, windows: list[tuple[str, list[str]]]):
        self.items: dict[bytes, tuple[int, list[str]]] = {}
        classes: dict[int, list[bytes]] = defaultdict(list)
        for window, items in windows:
            pattern = b" " + window.encode() + b" "
            self.items[pattern] = (window.count(" ") + 1, items)
            classes[next(c for c in CLASSES if len(pattern) >= c)].append(pattern)
        self.classes = [PatternClass(patterns) for patterns in classes.values()]

    def find(self, texts: list[bytes]) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """By text: hit spans of words and items."""
        starts, size = [], 0
        for text in texts:
            starts.append(size)
            size += len(text) + 1
        buffer = b"\0".join(texts) + b"\0" * 9
        hits = sorted(hit for own in self.classes for hit in own.search(buffer, size))
        out: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        places = np.searchsorted(np.array(starts), [place for place, _ in hits], side="right") - 1 if hits else []
        known = (-1, 0, 0)  # text, place in it, spaces before that place
        for (place, pattern), k in zip(hits, map(int, places)):
            offset = place - starts[k]
            before = known if known[0] == k else (k, 0, 0)
            first = before[2] + texts[k].count(b" ", before[1], offset)
            known = (k, offset, first)
            n, items = self.items[pattern]
            spans, seen = out.setdefault(k, ([], set()))
            seen.update(items)
            if spans and first <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], first + n))
            else:
                spans.append((first, first + n))
        return out


def item_windows(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text", words: int = WINDOW_WORDS) -> DataFrame:
    """window, items (sorted ids as text) of every window of the benchmark. Null ids count as one item, the empty id."""
    rows = pick(benchmark, item=id_column, text=text_column).select(
        F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"),
        F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("w"),
    )
    rows = rows.filter(F.size("w") > 0)
    windows = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("w") - (words - 1), F.lit(1))),
        lambda i: F.array_join(F.slice(F.col("w"), i, words), " "),
    )
    return rows.select("item", F.explode(windows).alias("window")).groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((first, end))
    return out


def _search(text: Column, so_far: Column, windows: list[tuple[str, list[str]]], spark) -> Column:
    shared = spark.sparkContext.broadcast(windows)
    ready: dict[int, Matcher] = {}

    @F.arrow_udf(FOUND)
    def found(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        if 0 not in ready:
            ready[0] = Matcher(shared.value)
        matcher = ready[0]
        for texts, earlier in batches:
            rows: list[dict] = []
            held: list[bytes] = []
            counts: list[int] = []

            def flush() -> None:
                hits = matcher.find(held)
                for k, n in enumerate(counts):
                    spans, items = hits.get(k, ([], set()))
                    rows.append({"n_words": n, "spans": spans, "items": items})
                held.clear()
                counts.clear()

            size = 0
            for text in texts:
                spaced, n = spaced_words(text.as_py() or "")
                if held and size + len(spaced) > BUFFER_BYTES:
                    flush()
                    size = 0
                held.append(spaced)
                counts.append(n)
                size += len(spaced) + 1
            flush()
            for row, old in zip(rows, earlier):
                if old.is_valid and (old := old.as_py())["items"]:
                    row["spans"] = _united(row["spans"] + [(s["first"], s["end"]) for s in old["spans"]])
                    row["items"] = row["items"] | set(old["items"])
                row["spans"] = [{"first": a, "end": b} for a, b in row["spans"]]
                row["items"] = sorted(row["items"])
            kind = pa.struct(
                {"n_words": pa.int64(), "spans": pa.list_(pa.struct({"first": pa.int64(), "end": pa.int64()})), "items": pa.list_(pa.string())}
            )
            yield pa.array(rows, kind)

    return found(text, so_far).alias("found")


def search(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a column `found`: n_words, spans (first word, end) that occurring windows cover, items they belong to.

    docs must not have a column of that name.
    """
    spark = docs.sparkSession
    small_batches(spark)
    windows = item_windows(benchmark).persist()
    size = windows.agg(F.sum(F.octet_length("window") + 64 + 16 * F.size("items"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    rows = docs.withColumn("found", F.lit(None).cast(FOUND))
    for block in range(blocks):
        own = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == block)
        listed = [(r["window"], r["items"]) for r in own.select("window", "items").toLocalIterator()]
        rows = rows.withColumn("found", _search(rows[text_column], rows["found"], listed, spark))
        if block < blocks - 1:
            rows = rows.checkpoint()
    windows.unpersist()
    return rows


def hit_words(found: Column) -> Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])


def is_contaminated(found: Column) -> Column:
    """Some word is hit, and hit words are at least a twentieth of all."""
    hit = hit_words(found)
    return (hit > 0) & (20 * hit >= found["n_words"])


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, spans, items and contaminated of every document.

    Windows are 13 consecutive words of an item, or all of a shorter one. Null and empty texts have no words and no
    hits; items without words have no windows; with an empty benchmark nothing is hit. Equal rows each give a row.
    """
    rows = search(pick(docs, doc_id=id_column, text=text_column), benchmark)
    found = F.col("found")
    return rows.select(
        "doc_id",
        "found.n_words",
        hit_words(found).alias("n_hit"),
        "found.spans",
        "found.items",
        is_contaminated(found).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns.

    A null or empty text has no words, so it stays. Repeated rows are judged alike; ids do not matter. An empty table
    gives no rows, an empty benchmark drops none. Columns may have any names.
    """
    return in_place(docs, lambda df: search(df, benchmark, "text").filter(~is_contaminated(F.col("found"))), text=text_column)

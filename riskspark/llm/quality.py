"""Quality rules by suffix-array repetition.

The words of a text are numbered and their suffixes sorted by prefix doubling; adjacent suffixes give the longest
common prefixes. The intervals of equal prefixes are the text's maximal repeated substrings: the longest repeat that
starts at a word is the larger of its two neighbouring prefixes. The spans of repeats of a least length are united, and
a text is rejected if they cover too large a share of its words or if one repeat is too long.

Many texts are sorted together: words are numbered anew in each text and texts end with a number of their own, so no
repeat crosses texts. Only suffixes that still share a prefix with another are sorted again.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import in_place, pick, small_batches, text_blocks

MIN_REPEAT = 8  # words
MAX_COVERED = 0.4  # share of the words inside repeats of at least MIN_REPEAT words
MAX_LONGEST = 200  # words of one repeat
BLOCK_CHARS = 2 << 20

#: Fixed values of the base figures.
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\v\f\r"

FIGURES = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "covered_words": pa.int64(),
    "longest_repeat": pa.int64(),
}
SCHEMA = "struct<" + ",".join(f"{name}:bigint" for name in FIGURES) + ">"


def suffix_repeats(ids: np.ndarray) -> np.ndarray:
    """For each place, the length of the longest substring that starts there and anywhere else.

    `ids` are numbers from 0 on, of which the last occurs once. A substring never holds a number that occurs once.
    """
    n = len(ids)
    counts = np.bincount(ids)
    start = np.cumsum(counts) - counts
    rank = start[ids]
    active = np.flatnonzero(counts[ids] > 1)
    split = np.zeros(n, np.int64)  # by place in the sorted order: doubling round that told a suffix from the one before
    levels = []
    while active.size:
        width = 1 << len(levels)
        levels.append(rank.astype(np.int32))
        key = rank[active] * n + rank[active + width]
        order = np.argsort(key)
        active, key = active[order], key[order]
        old, at = rank[active], np.arange(active.size)
        new_group = np.empty(active.size, bool)
        new_group[0] = True
        new_group[1:] = old[1:] != old[:-1]
        new_part = np.empty(active.size, bool)
        new_part[0] = True
        new_part[1:] = key[1:] != key[:-1]
        place = old + at - np.maximum.accumulate(np.where(new_group, at, 0))
        split[place[new_part & ~new_group]] = len(levels)
        rank[active] = place[np.maximum.accumulate(np.where(new_part, at, 0))]
        shared = ~new_part
        shared[:-1] |= ~new_part[1:]
        active = active[shared]
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    after = np.flatnonzero(split)
    common = np.zeros(n + 1, np.int64)
    left, right, length = suffixes[after - 1], suffixes[after], np.zeros(after.size, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        some = split[after] > k
        same = some.copy()
        same[some] = level[left[some] + length[some]] == level[right[some] + length[some]]
        length += same * (1 << k)
    common[after] = length
    longest = np.empty(n, np.int64)
    longest[suffixes] = np.maximum(common[:-1], common[1:])
    return longest


def _covered(longest: np.ndarray, least: int, exactly: bool) -> np.ndarray:
    """Places inside a repeated substring of at least `least` numbers (or of exactly so many, which is the same union)."""
    at = np.arange(len(longest))
    ends = np.where(longest >= least, at + (least if exactly else longest), 0)
    return np.maximum.accumulate(ends) > at


def measure(texts: list[str], min_repeat: int) -> dict[str, list[int]]:
    """The figures of each text."""
    number = count()
    ids: list[int] = []
    bounds = [0]
    out: dict[str, list[int]] = {name: [] for name in FIGURES}
    for text in texts:
        words = text.encode().split()  # bytes are split at exactly the six ASCII white spaces
        own: defaultdict[bytes, int] = defaultdict(number.__next__)
        ids.extend(map(own.__getitem__, words))
        ids.append(next(number))
        bounds.append(len(ids))
        out["n_words"].append(len(words))
        out["word_chars"].append(len(text) - sum(map(text.count, WHITE)))
        out["n_symbols"].append(sum(map(text.count, SYMBOLS)))
        lines = text.split("\n")
        held = 0
        if len(lines) > 1:
            full = [x for x in lines if x.strip(WHITE)]
            held = len(full) - len(set(full))
        out["n_dup_lines"].append(held)
    longest = suffix_repeats(np.array(ids, np.int64))
    low, high = np.array(bounds[:-1]), np.array(bounds[1:])
    for name, least, exactly in (("n_repeat_words", 3, True), ("covered_words", min_repeat, False)):
        total = np.concatenate(([0], np.cumsum(_covered(longest, least, exactly))))
        out[name] = (total[high] - total[low]).tolist()
    out["longest_repeat"] = np.maximum.reduceat(longest, low).tolist() if len(low) else []
    return out


def figures(text: Column, min_repeat: int = MIN_REPEAT) -> Column:
    """Struct of the figures of a text column."""

    @F.arrow_udf(SCHEMA)
    def measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            blocks = [measure(block, min_repeat) for block in text_blocks((t.as_py() for t in batch), BLOCK_CHARS)]
            columns = [pa.array([x for b in blocks for x in b[name]], kind) for name, kind in FIGURES.items()]
            yield pa.StructArray.from_arrays(columns, names=list(FIGURES))

    return measured(text)


def base_failed(f: Column) -> Column:
    """Too few words, or more than half of them inside repeated windows of three."""
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def passes(f: Column, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST) -> Column:
    """The verdict on repeats: a bounded covered share and a bounded longest repeat."""
    return (f["covered_words"] <= max_covered * f["n_words"]) & (f["longest_repeat"] <= max_longest)


def quality(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_repeat: int = MIN_REPEAT,
    max_covered: float = MAX_COVERED,
    max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """doc_id, the figures, base_failed and kept of every document. One pass, no shuffle.

    Words are runs without ASCII white space. n_dup_lines counts lines with a word that equal an earlier line of the
    text; n_repeat_words the words inside 3-word windows found twice or more; covered_words those inside repeats of at
    least `min_repeat` words. A null or empty text has no words and fails; equal rows each give a row; an empty table
    gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_column, text=text_column).select("doc_id", figures(F.col("text"), min_repeat).alias("f"))
    f = F.col("f")
    failed = base_failed(f)
    return rows.select("doc_id", "f.*", failed.alias("base_failed"), (~failed & passes(f, max_covered, max_longest)).alias("kept"))


def keep_good(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of docs whose text passes the base rule and the rule on repeats, with all their columns.

    A null or empty text has too few words and goes. Repeated rows are judged each for itself and alike; ids do not
    matter. An empty table gives no rows. Columns may have any names.
    """
    small_batches(docs.sparkSession)
    f = figures(F.col("text"))
    return in_place(docs, lambda df: df.withColumn("_kept", ~base_failed(f) & passes(f)).filter("_kept"), text=text_column)

"""Line deduplication by a segment-partition edit join, with DataFrame and SQL functions only.

A line is dropped if it equals an earlier line of the corpus, or is within `max_edits` edits of one. For the second,
a line of n characters is split into max_edits + 1 even segments; if another line is within max_edits edits, one of the
segments occurs in it unchanged, near its own place. So segments are indexed by length and number, and every line
probes, for each length it may match, the few substrings at the places a segment can have moved to. Lines that share
such a key are compared by a banded bit-parallel automaton.

With one edit, the unmatched rest of a line is split again, and all but one piece must be equal: once for all lines that
share a key, and again as long as a key is crowded. So few lines are left to compare, and a crowd of variants of one
line meets only in ever smaller groups, down to lines that differ in a character. (With more edits, lines that share a
segment are compared as they are.)

Lines travel as hashes of 128 bits; texts of lines are shuffled only for lines that share a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import in_place, pick, stored, with_row_id

MAX_EDITS = 1
MIN_CHARS = 20  # shorter lines are always kept, unless every line is asked for
CROWDED = 1_000  # pairs of one key from which its lines are split once more
PIECES = 16
BROADCAST_ROWS = 1_000_000  # of eight bytes
NOT_BLANK = "[^\\x20\\x09-\\x0D]"


def lines_of(docs: DataFrame, min_chars: int, every_line: bool = False) -> DataFrame:
    """row, doc_id, pos, line, h1, h2 of every line of at least min_chars characters; of every non-blank line if asked."""
    lines = docs.select("row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    wanted = F.char_length("line") >= min_chars
    lines = lines.filter(wanted | F.col("line").rlike(NOT_BLANK) if every_line else wanted)
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _keys(max_edits: int) -> Column:
    """All keys of a line: of its own segments (indexed), and of substrings that may be a segment of another line."""
    n, line = F.char_length("line"), F.col("line")
    out = []
    for less in range(max_edits + 1):
        length = n - less
        for i in range(max_edits + 1):
            begin = F.floor(length * i / (max_edits + 1)).cast("int")
            size = F.floor(length * (i + 1) / (max_edits + 1)).cast("int") - begin
            for shift in range(max(-i, less - max_edits + i), min(i, less + max_edits - i) + 1):
                segment = F.substring(line, begin + (shift + 1), size)
                out.append(
                    F.struct(
                        F.xxhash64(F.lit(i), length, segment).alias("key"),
                        F.lit(i).alias("i"),
                        F.lit(less).alias("less"),
                        F.lit(less == 0 and shift == 0).alias("indexed"),
                    )
                )
    return F.array(*out)


def within_edits(a: Column, b: Column, max_edits: int, a_from: Column, a_size: Column, b_from: Column, b_size: Column) -> Column:
    """Whether a part of the characters a and a part of the characters b are within max_edits edits.

    One machine word for each number of edits, a bit for each diagonal of the band. After j characters of b, bit i of
    word d says that the first j + i - max_edits characters of a can be turned into them by d edits. A step compares
    the characters in the band, then lets states go on along their diagonal where characters are equal, and to the
    next word by a replacement, an insertion or a deletion. a and b are arrays that must be columns of a table: an
    expression would be computed again in every step.
    """
    k = max_edits
    start = F.array(*[F.lit(sum(1 << (k + r) for r in range(d + 1))) for d in range(k + 1)])

    def step(words: Column, j: Column) -> Column:
        char = F.get(b, b_from + j)
        equal = F.lit(0)
        for i in range(2 * k + 1):
            place = j + (i - k)
            same = (place >= 0) & (place < a_size) & (F.get(a, a_from + place) == char)
            equal = equal.bitwiseOR(F.when(same, 1 << i).otherwise(0))
        made: list[Column] = []
        for d in range(k + 1):
            own = F.get(words, F.lit(d)).bitwiseAND(equal)
            if d:
                fewer = F.get(words, F.lit(d - 1))
                own = own.bitwiseOR(fewer).bitwiseOR(F.shiftright(fewer, 1)).bitwiseOR(F.shiftleft(made[-1], 1))
            made.append(own.bitwiseAND((1 << (2 * k + 1)) - 1))
        return F.array(*made)

    columns = F.when(b_size > 0, F.sequence(F.lit(0), b_size - 1)).otherwise(F.array().cast("array<int>"))
    words = F.aggregate(columns, start, step)
    last = F.get(words, F.lit(k))
    reached = F.getbit(last, F.greatest(a_size - b_size + k, F.lit(0))) == 1
    return F.when(F.abs(a_size - b_size) <= k, reached).otherwise(False)


def _small(df: DataFrame, rows: Column | None = None) -> DataFrame:
    """df with a hint to broadcast it, if its rows (or what `rows` counts in each) were counted and are few."""
    held = df.count() if rows is None else df.agg(F.sum(rows)).first()[0] or 0
    return F.broadcast(df) if held <= BROADCAST_ROWS else df


def _pairs(rows: DataFrame, *region: str | Column) -> DataFrame:
    """Pairs (r, s) of lines that share a key of which r is indexed, each pair once from one key."""
    r = rows.filter("indexed").select("key", F.col("h1").alias("r"), *region)
    s = rows.select("key", F.col("h1").alias("s"), F.col("indexed").alias("both"))
    return r.join(s, "key").filter("r <> s AND (NOT both OR r < s)").drop("key", "both")


def _crowded(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.col("indexed").cast("long")).alias("m"))
    return counts.filter(F.col("n") * F.col("m") > CROWDED).select("key")


def _split_further(rows: DataFrame) -> DataFrame:
    """Rows (h1, line, length, first, end, indexed): a row for each piece of the unmatched part [first, end)."""
    t = F.sequence(F.lit(0), F.lit(PIECES - 1))
    cut = rows.withColumn("t", F.explode(t)).selectExpr(
        "h1",
        "line",
        "length",
        "indexed",
        f"int(first + floor((end - first) * t / {PIECES})) AS begin",
        f"int(first + floor((end - first) * (t + 1) / {PIECES})) AS stop",
    )
    cut = cut.filter("begin < stop")
    before = F.substring(F.col("line"), F.lit(1), F.col("begin"))
    after = F.substring(F.col("line"), F.char_length("line") - F.col("length") + F.col("stop") + 1, F.col("length") - F.col("stop"))
    key = F.xxhash64("length", "begin", "stop", before, after)
    return cut.select("h1", "line", "length", "indexed", F.col("begin").alias("first"), F.col("stop").alias("end"), key.alias("key"))


def near_lines(lines: DataFrame, firsts: DataFrame, max_edits: int) -> DataFrame:
    """h1, h2 of every distinct line that is within max_edits edits of an earlier, different line."""
    keyed = lines.select("h1", F.explode(_keys(max_edits)).alias("k")).select("h1", "k.*")
    shared = keyed.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high"), F.max("indexed").alias("any"))
    shared = stored(shared.filter("low <> high AND any").select("key"), "shared-keys")
    rows = stored(keyed.join(_small(shared), "key", "left_semi").distinct(), "keyed-lines")
    wanted = stored(rows.select("h1").distinct(), "candidates")
    texts = lines.join(_small(wanted), "h1", "left_semi").groupBy("h1", "h2").agg(F.first("line").alias("line"))
    texts = stored(texts.join(firsts, ["h1", "h2"]).withColumn("chars", F.split("line", "")), "candidate-lines")
    if max_edits > 1:
        # Nothing but a segment is known to be equal: the whole lines are compared.
        pairs = _pairs(rows).select("r", "s", F.lit(0).alias("first"), F.lit(0).alias("after")).distinct()
    else:
        half = "floor(length / 2)"
        open_rows = rows.join(texts.select("h1", "line"), "h1").withColumn("length", F.char_length("line") - F.col("less"))
        open_rows = open_rows.withColumns({"first": F.expr(f"int(if(i = 0, {half}, 0))"), "end": F.expr(f"int(if(i = 0, length, {half}))")})
        found = []
        while True:
            made = stored(_split_further(open_rows), "pieces")
            crowded = stored(_crowded(made.filter("end - first > 1")), "crowded")
            found.append(_pairs(made.join(crowded, "key", "left_anti"), "first", (F.col("length") - F.col("end")).alias("after")))
            if crowded.isEmpty():
                break
            open_rows = made.join(crowded, "key", "left_semi")
        # A pair met at several pieces is compared at one of them: its lines are equal before and after each.
        pairs = reduce(DataFrame.unionByName, found).groupBy("r", "s").agg(F.max(F.struct("first", "after")).alias("g"))
        pairs = pairs.select("r", "s", "g.first", "g.after")
    left = texts.select(F.col("h1").alias("r"), F.col("h2").alias("r2"), F.col("line").alias("a"), F.col("chars").alias("ca"), F.col("at").alias("a_at"))
    right = texts.select(F.col("h1").alias("s"), F.col("h2").alias("s2"), F.col("line").alias("b"), F.col("chars").alias("cb"), F.col("at").alias("b_at"))
    both = pairs.join(left, "r").join(right, "s")
    first, after = F.col("first"), F.col("after")
    equal_outside = (F.substring("a", F.lit(1), first) == F.substring("b", F.lit(1), first)) & (
        F.substring(F.col("a"), F.size("ca") - after + 1, after) == F.substring(F.col("b"), F.size("cb") - after + 1, after)
    )
    parts = F.size("ca") - first - after, F.size("cb") - first - after
    close = within_edits(F.col("ca"), F.col("cb"), max_edits, first, parts[0], first, parts[1])
    earlier = F.col("a_at") < F.col("b_at")
    later = F.when(earlier, F.struct(F.col("s").alias("h1"), F.col("s2").alias("h2"))).otherwise(F.struct(F.col("r").alias("h1"), F.col("r2").alias("h2")))
    return both.filter(equal_outside & close).select(later.alias("f")).select("f.*").distinct()


def dropped_lines(docs: DataFrame, max_edits: int, min_chars: int, every_line: bool = False) -> DataFrame:
    """row, pos (array) of the lines that are dropped, of (row, doc_id, text)."""
    lines = lines_of(docs, min_chars, every_line)
    firsts = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "row", "pos")).alias("at"), F.count("*").alias("n"))
    firsts = stored(firsts, "first-lines")
    compared = lines.filter(F.char_length("line") >= min_chars) if every_line else lines
    near = stored(near_lines(compared, firsts.select("h1", "h2", "at"), max_edits).withColumn("near", F.lit(True)), "near-lines")
    judged = firsts.join(near, ["h1", "h2"], "left").filter("n > 1 OR near").select("h1", "h2", "at", "near")
    met = lines.select("h1", "h2", "row", "pos").join(judged, ["h1", "h2"])
    gone = met.filter(F.col("near").isNotNull() | (F.col("row") != F.col("at.row")) | (F.col("pos") != F.col("at.pos")))
    return gone.groupBy("row").agg(F.collect_list("pos").alias("gone"))


def without_repeated_lines(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    max_edits: int = MAX_EDITS,
    min_chars: int = MIN_CHARS,
    every_line: bool = False,
) -> DataFrame:
    """row, doc_id, n_lines, n_removed and kept (text) of every document; docs must be a scan (see with_row_id).

    Lines are what is between line feeds, and are ordered by (doc_id, row, place). A line of at least min_chars
    characters is dropped if an earlier line equals it or is within max_edits edits of it (whether or not that one is
    kept). With every_line, a shorter non-blank line is dropped too, if an earlier line equals it. A null text has no
    lines and stays null; an empty text has one empty line. Null ids come first. Of equal rows the first keeps its
    lines. An empty table gives no rows.
    """
    base = with_row_id(pick(docs, doc_id=id_column, text=text_column))
    gone = stored(dropped_lines(base, max_edits, min_chars, every_line), "dropped")
    joined = base.join(_small(gone, F.size("gone") + 2), "row", "left")
    lines = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    kept = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return joined.withColumn("lines", lines).select(
        "row",
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        kept.alias("kept"),
    )


def drop_repeated_lines(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", every_line: bool = False) -> DataFrame:
    """docs with the lines that stay as text; a document that had lines and loses all of them goes. docs must be a scan.

    Without every_line a copy that holds a short line stays as a stub of its short lines. A null or empty text stays as it
    is. Earlier lines are those of smaller ids (null first), of repeated rows those of the first. An empty table gives no
    rows. Columns may have any names.
    """
    base = with_row_id(pick(docs, doc_id=id_column, text=text_column))
    gone = stored(dropped_lines(base, MAX_EDITS, MIN_CHARS, every_line), "dropped")
    few = _small(gone, F.size("gone") + 2).withColumnsRenamed({"row": "_row", "gone": "_gone"})
    lines = F.split("text", "\n", -1)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_gone"), lambda i: F.get(lines, i))
    kept = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    emptied = F.col("_gone").isNotNull() & ~F.col("_kept").rlike(NOT_BLANK)

    def cut(df: DataFrame) -> DataFrame:
        marked = with_row_id(df, "_row").join(few, "_row", "left").withColumn("_kept", kept)
        return marked.filter(~emptied).withColumn("text", F.col("_kept"))

    return in_place(docs, cut, text=text_column)

"""Removal of repeated byte strings by bucket-pointer refinement.

Two places belong to one bucket as long as the bytes compared so far are equal. Places are put into initial buckets by
a q-gram, and a bucket is refined by sorting its places on the bucket identifiers of later offsets; a bucket of one
place is finished, and what a refinement finds is used by all later ones.

So that not every byte of the corpus is a row, places are handled in cells around anchors. The anchor of a string of
`length` bytes is its least 8-byte gram by hash, so equal strings have their anchors at equal offsets, and the
neighbouring strings of one anchor are handled together, cut into cells of offsets. A cell has two identifiers: that of
its core, the bytes that all its strings share (the q-gram of its initial bucket), and that of its context, the bytes
that any of them has (the later offsets on both sides). Cells alone in their core's bucket hold no repeated string;
cells whose contexts share a bucket repeat wholly; all others are cut into smaller cells, whose longer cores refine the
bucket, down to single strings, where core and context are the string itself. Each round refines only what the round
before left open, with one place for every bucket of equal contexts, so crowds of copies are rows of counts.

Identifiers are hashes, two of 64 bits each, so buckets need no numbering by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import pick, small_batches, stored, with_row_id
from riskspark.llm.near_dedup import mix

LENGTH = 200
GRAM = 8
CELLS = (100, 25, 5, 1)  # offsets in a cell, by round
BLOCK_BYTES = 1 << 20

_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_powers: list[np.ndarray] = []
PLACES = "row long, spot long, core long, ctx long"


def cell_sizes(length: int) -> list[int]:
    return [c for c in CELLS if c <= length // 2]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, kept by the worker."""
    if not _powers or len(_powers[0]) < n:
        tables = []
        for factor in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(n, factor, np.uint64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers[:] = tables
    return _powers[0], _powers[1]


def _window_minimum(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive keys."""
    count = len(keys) - width + 1
    rows = np.concatenate((keys, np.full(-len(keys) % width, np.uint64(2**64 - 1)))).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def anchor_cells(texts: list[bytes], length: int, cell: int) -> dict[str, np.ndarray]:
    """Cells of the first round: text, anchor (place in it), first and last offset, core and context identifiers.

    A string at p with the anchor a has the offset a - p.
    """
    width = length - GRAM + 1
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    total = int(sizes.sum())
    keep = sizes >= length
    if not keep.any():
        none = np.empty(0, np.int64)
        return dict.fromkeys(("text", "anchor", "first", "last", "core", "ctx"), none)
    buffer = b"".join(texts) + b"\0" * GRAM
    grams = mix(np.ndarray(shape=(total,), dtype="<u8", buffer=buffer, strides=(1,)) + np.uint64(0x2545F4914F6CDD1D))
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(total, dtype=np.uint64)
    anchors = (_window_minimum(keys, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begins = np.ones(len(anchors), bool)
    begins[1:] = anchors[1:] != anchors[:-1]
    begins[starts[keep]] = True
    ends = starts + sizes - length + 1  # first place of a text without a whole string
    stops = ends[keep]
    begins[stops[stops < len(begins)]] = True
    low = np.flatnonzero(begins)
    high = np.append(low[1:], len(anchors)) - 1
    text = np.searchsorted(starts, low, side="right") - 1
    inside = low < ends[text]
    low, high, text = low[inside], high[inside], text[inside]
    anchor = anchors[low]
    least, most = anchor - high, anchor - low
    first_cell = least // cell
    n = most // cell - first_cell + 1
    owner = np.repeat(np.arange(len(low)), n)
    number = first_cell[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    anchor, text = anchor[owner], text[owner]
    first, last = np.maximum(least[owner], number * cell), np.minimum(most[owner], number * cell + cell - 1)
    power, inverse = _power_tables(total + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(grams * power[:total])))

    def identify(begin: np.ndarray, end: np.ndarray, *tags: np.ndarray) -> np.ndarray:
        out = (sums[end - GRAM + 1] - sums[begin]) * inverse[begin]
        for tag in tags:
            out = mix(out + tag.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out.view(np.int64)

    core_end = np.minimum(number * cell + cell - 1, width - 1)
    return {
        "text": text,
        "anchor": anchor - starts[text],
        "first": first,
        "last": last,
        "core": identify(anchor - number * cell, anchor - core_end + length, number + 1),
        "ctx": identify(anchor - last, anchor - first + length, first + 1, last + 1),
    }


def _segments(rows: Iterator[tuple[int, str | None]], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Blocks of (row, place, bytes); a long text is cut into segments that overlap by one string less a byte."""
    block: list[tuple[int, int, bytes]] = []
    held = 0
    step = max(BLOCK_BYTES, length)
    for row, text in rows:
        data = (text or "").encode()
        for at in range(0, len(data), step):
            part = data[at : at + step + length - 1]
            if len(part) < length:
                continue
            if block and held + len(part) > 2 * BLOCK_BYTES:
                yield block
                block, held = [], 0
            block.append((row, at, part))
            held += len(part)
    if block:
        yield block


def first_cells(docs: DataFrame, length: int, cell: int) -> DataFrame:
    """The cells of the first round of (row, text); `spot` holds anchor, first and last offset."""
    width = length - GRAM + 1

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("row").to_pylist(), (t.as_py() for t in batch.column("text")))
            for block in _segments(rows, length):
                found = anchor_cells([b for _, _, b in block], length, cell)
                row, place = (np.array([x[i] for x in block], np.int64)[found["text"]] for i in (0, 1))
                spot = ((place + found["anchor"]) * width + found["first"]) * width + found["last"]
                yield pa.record_batch({"row": row, "spot": spot, "core": found["core"], "ctx": found["ctx"]})

    return docs.select("row", "text").mapInArrow(cells, PLACES)


def _refine(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of places (row, spot, whole, open, core, ctx): the open ones that repeat wholly, and what the next round refines.

    The next round gets one place for every bucket of equal contexts, where a core has several and one is still open.
    """
    buckets = stored(
        places.groupBy("core", "ctx").agg(F.count("*").alias("n"), F.max("open").alias("open"), F.min(F.struct("row", "spot", "whole")).alias("place")), "buckets"
    )
    repeated = places.filter("open").join(buckets.filter("n > 1").select("core", "ctx"), ["core", "ctx"], "left_semi").select("row", "spot")
    left = buckets.select("core", "place.*", (F.col("open") & (F.col("n") == 1)).alias("open"))
    cores = left.groupBy("core").agg(F.count("*").alias("n"), F.max("open").alias("wanted")).filter("n > 1 AND wanted")
    return repeated, left.join(cores.select("core"), "core", "left_semi").select("row", "spot", "whole", "open")


def _contexts(docs: DataFrame, places: DataFrame, length: int) -> DataFrame:
    """Places with the bytes of their contexts: one join of the texts with what is left open."""
    width = length - GRAM + 1
    listed = places.groupBy("row").agg(F.collect_list(F.struct("spot", "open")).alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text, own in zip(batch.column("row").to_pylist(), batch.column("text"), batch.column("places")):
                data = text.as_py().encode()
                out: dict[str, list] = {"row": [], "spot": [], "open": [], "bytes": []}
                for place in own.as_py():
                    rest, last = divmod(place["spot"], width)
                    anchor, first = divmod(rest, width)
                    out["row"].append(row)
                    out["spot"].append(place["spot"])
                    out["open"].append(place["open"])
                    out["bytes"].append(data[anchor - last : anchor - first + length])
                yield pa.record_batch(
                    {
                        "row": pa.array(out["row"], pa.int64()),
                        "spot": pa.array(out["spot"], pa.int64()),
                        "open": pa.array(out["open"], pa.bool_()),
                        "bytes": pa.array(out["bytes"], pa.binary()),
                    }
                )

    return docs.select("row", "text").join(listed, "row").mapInArrow(cut, "row long, spot long, open boolean, bytes binary")


def _smaller_cells(parents: DataFrame, length: int, cell: int) -> DataFrame:
    """The cells of `cell` offsets inside parents (row, spot, open, whole, bytes).

    `whole` is the spot of the first round's cell, whose context is in bytes.
    """
    width = length - GRAM + 1

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"row": [], "spot": [], "open": [], "whole": [], "core": [], "ctx": []}
            for row, spot, is_open, whole, data in zip(*(batch.column(c).to_pylist() for c in ("row", "spot", "open", "whole", "bytes"))):
                rest, last = divmod(spot, width)
                anchor, first = divmod(rest, width)
                begin = anchor - whole % width  # place of the bytes in the text
                at = anchor - begin
                for number in range(first // cell, last // cell + 1):
                    low, high = max(first, number * cell), min(last, number * cell + cell - 1)
                    core_end = min(number * cell + cell - 1, width - 1)
                    core = data[at - number * cell : at - core_end + length]
                    context = data[at - high : at - low + length]
                    out["row"].append(row)
                    out["spot"].append((anchor * width + low) * width + high)
                    out["open"].append(is_open)
                    out["whole"].append(whole)
                    out["core"].append(xxhash.xxh3_64_intdigest(core, number) - (1 << 63))
                    out["ctx"].append(xxhash.xxh3_64_intdigest(context, (1 << 40) + low * width + high) - (1 << 63))
            kinds = {"open": pa.bool_()}
            yield pa.record_batch({k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    return parents.select("row", "spot", "open", "whole", "bytes").mapInArrow(cells, "row long, spot long, open boolean, whole long, core long, ctx long")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """row, spans (first byte, end) of (row, text): every byte covered by a string that also starts elsewhere.

    A text without such bytes has no row. Spans of one row may overlap.
    """
    width = length - GRAM + 1
    sizes = cell_sizes(length)
    cells = first_cells(docs, length, sizes[0])
    shared = cells.groupBy("core").count().filter("count > 1").select("core")
    places = stored(cells.join(shared, "core", "left_semi"), "places").withColumn("open", F.lit(True)).withColumn("whole", F.col("spot"))
    repeated, left = _refine(places)
    repeats = [repeated]
    whole = stored(_contexts(docs, left, length).withColumn("whole", F.col("spot")), "contexts")
    parents = whole
    for cell in sizes[1:]:
        places = stored(_smaller_cells(parents, length, cell), "places")
        repeated, left = _refine(places)
        repeats.append(repeated)
        if cell > 1:
            parents = left.join(whole.select("row", "whole", "bytes"), ["row", "whole"])
    found = repeats[0]
    for more in repeats[1:]:
        found = found.unionByName(more)
    square = width * width
    spans = found.selectExpr(
        "row", f"spot DIV {square} - spot % {width} AS first", f"spot DIV {square} - (spot DIV {width}) % {width} + {length} AS end"
    )
    return spans.groupBy("row").agg(F.collect_list(F.struct("first", "end")).alias("spans"))


CUT = "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept:binary>"


def _without_spans(text: Column, spans: Column) -> Column:
    @F.arrow_udf(CUT)
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, listed in batches:
            rows = []
            for text, own in zip(texts, listed):
                data = (text.as_py() or "").encode()
                kept, at, count = [], 0, 0
                if own.is_valid:
                    values = own.values
                    begin, end = (values.field(i).to_numpy(zero_copy_only=False) for i in ("first", "end"))
                    order = np.argsort(begin, kind="stable")
                    begin, reach = begin[order], np.maximum.accumulate(end[order])
                    new = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
                    for first, last in zip(begin[new].tolist(), reach[np.append(new[1:], len(reach)) - 1].tolist()):
                        kept.append(data[at:first])
                        at = last
                        count += 1
                kept.append(data[at:])
                rest = b"".join(kept)
                rows.append({"n_bytes": len(data), "n_removed": len(data) - len(rest), "n_spans": count, "kept": rest})
            yield pa.array(rows, pa.struct({"n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept": pa.binary()}))

    return cut(text, spans)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (bytes) of every text; docs must be a scan.

    Texts are UTF-8 bytes; null is empty. A string of `length` bytes counts as repeated if it starts anywhere else in
    any text, the same one included, also where the two overlap; strings are judged on the input. Texts shorter than
    `length` keep all. Equal rows are two texts, which remove each other; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    base = with_row_id(pick(docs, doc_id=id_column, text=text_column))
    spans = repeated_spans(base, length)
    joined = base.join(spans, "row", "left")
    return joined.select("doc_id", _without_spans(F.col("text"), F.col("spans")).alias("c")).select("doc_id", "c.*")

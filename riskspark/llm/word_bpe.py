"""BPE of words with an end-of-word mark: encoding by a segment tree over adjacent pair ranks, and decoding.

A tokenizer file gives a vocabulary, an ordered list of merges, a pattern for pre-tokens and special strings. The bytes
of a pre-token, each written as one printable character, are its first symbols; the last carries the end mark. A segment
tree has a leaf for each pair of neighbours: the rank of its merge, then its place. An inner node holds the lesser of
its children, so the root is the lowest rank and of equal ranks the leftmost. A merge changes three leaves (its own and
both neighbours'), each on a path of logarithmic length to the root. Merging ends when the root holds no rank.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import pick, small_batches
from riskspark.llm.pretokens import Splitter, is_plain

ID_BITS = 20  # ids fit
CACHED_CHARS = 64  # longer pre-tokens are not kept
CACHED_BYTES = 96 << 20  # about what a worker's cache may take
ENTRY_BYTES = 200  # of a cache entry besides its ids

_loaded: dict[str, "WordBpe"] = {}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if it is one, else the next one from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    places = {byte: byte for byte in shown}
    for byte in range(256):
        places.setdefault(byte, 256 + len(places) - len(shown))
    return [chr(places[byte]) for byte in range(256)]


def merge(symbols: list[int], merges: dict[int, int]) -> list[int]:
    """The symbols after all merges. A pair's key and value are both two ids in one number: (left, right) and (rank, merged)."""
    n = len(symbols)
    if n < 2:
        return symbols
    size = 1 << (n - 2).bit_length()
    none = 1 << 62  # greater than any rank with its place
    known = merges.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * size)
    for i in range(n - 1):
        found = known(symbols[i] << ID_BITS | symbols[i + 1])
        if found is not None:
            tree[size + i] = found * size + i
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(i: int, value: int) -> None:
        node = size + i
        while node and tree[node] != value:
            tree[node] = value
            value = min(value, tree[node ^ 1])
            node >>= 1

    def pair(i: int, j: int) -> int:
        found = known(symbols[i] << ID_BITS | symbols[j])
        return none if found is None else found * size + i

    while tree[1] != none:
        found, i = divmod(tree[1], size)
        j = after[i]
        symbols[i] = found & (1 << ID_BITS) - 1
        symbols[j] = -1
        after[i] = k = after[j]
        if j < n - 1:
            put(j, none)
        if k < n:
            before[k] = i
            put(i, pair(i, k))
        else:
            put(i, none)
        if before[i] >= 0:
            put(before[i], pair(before[i], i))
    return [s for s in symbols if s >= 0]


class WordBpe(dict):
    """Packed ids (little-endian, 32 bits) by pre-token; unseen ones are encoded, short ones kept up to a bound of bytes."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        split, *rest = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or split["type"] != "Split" or [r["type"] for r in rest] != ["ByteLevel"]:
            raise ValueError(f"{path} is not a BPE of pre-tokens by a pattern over bytes")
        vocabulary = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        # The library's normal form (composition, lower case); all that follows is done here.
        self.normal_form = Tokenizer.from_file(path).normalizer.normalize_str
        self.split = Splitter(split["pattern"]["Regex"])
        marks = byte_characters()
        self.inner = [vocabulary.get(c) for c in marks]
        self.last = [vocabulary.get(c + end) for c in marks]
        self.merges = {
            vocabulary[a] << ID_BITS | vocabulary[b]: rank << ID_BITS | vocabulary[a + b] for rank, (a, b) in enumerate(model["merges"])
        }
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.between = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        own = vocabulary | self.special
        self.tokens = [""] * (max(own.values()) + 1)
        for token, number in own.items():
            self.tokens[number] = token
        self.held = 0

    def ids(self, word: str) -> list[int]:
        """Ids of one pre-token."""
        data = word.encode()
        symbols = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        return merge([s for s in symbols if s is not None], self.merges)

    def __missing__(self, word: str) -> bytes:
        packed = np.array(self.ids(word), "<u4").tobytes()
        if len(word) <= CACHED_CHARS:
            if self.held >= CACHED_BYTES:
                self.clear()
                self.held = 0
            self.held += ENTRY_BYTES + len(packed)
            self[word] = packed
        return packed

    def plain(self, text: str) -> bytes:
        """Ids of a text without special strings."""
        return b"".join(map(self.__getitem__, self.split(text.lower() if is_plain(text) else self.normal_form(text))))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; a special string inside it is its one id."""
        parts = self.between.split(text) if self.between else [text]
        packed = [self.special[p].to_bytes(4, "little") if i % 2 else self.plain(p) for i, p in enumerate(parts)]
        return np.frombuffer(b"".join(packed), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The tokens with a space between them, as the file names no decoder that would undo bytes and end marks."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def codec(path: str) -> WordBpe:
    """One per Python worker, kept between tasks."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def coded(text: Column, path: str) -> Column:
    """Struct of a text's ids and of the text they decode to; a null or empty text has no ids and decodes to nothing."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def round_trips(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path)
        for batch in batches:
            each = [own.encode(t.as_py() or "") for t in batch]
            ends = np.concatenate(([0], np.cumsum([len(ids) for ids in each], dtype=np.int64))).astype(np.int32)
            values = np.concatenate(each).astype(np.int32) if each else np.empty(0, np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
            yield pa.StructArray.from_arrays([ids, pa.array([own.decode(i) for i in each], pa.string())], names=["ids", "decoded"])

    return round_trips(text)


def round_trip(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (array) and decoded (the text that the ids stand for) of every text. No shuffle; equal rows each give a row.

    Null and empty texts give no ids and an empty decoded text; a null id stays null; an empty table gives no rows; other
    columns, also of clashing names, are left out.
    """
    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_column, text=text_column)
    return rows.select("doc_id", coded(F.col("text"), path).alias("c")).select("doc_id", "c.ids", "c.decoded")

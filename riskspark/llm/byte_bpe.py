"""Byte-level BPE: encoding by a hierarchical-bitmap rank queue, and decoding.

A rank file gives every token (a byte string) its rank, which is also its id. A pre-token starts as single bytes and the
adjacent pair whose joined bytes have the lowest rank is merged, leftmost first, until no pair has a rank.

The pairs wait in buckets, one per rank, that hold positions of a linked list of tokens. Which buckets have entries is
kept in a bitmap of two levels: a bit per rank in leaves of 256, and a bit per leaf. Find-first-set on both gives the
next rank in constant time, whatever the length of the pre-token. A merge changes the ranks of its two neighbours;
their old entries stay where they are and are skipped when met.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import holds_cache, pick, small_batches
from riskspark.llm.pretokens import Splitter

LEAF = 256
KEPT_BYTES = 64  # longer pre-tokens are not kept
CACHE_BYTES = 96 << 20  # about what a worker's cache may take
ENTRY_BYTES = 200  # of a cache entry besides its ids

_loaded: dict[tuple[str, str], "Codec"] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    known = ranks.get
    whole = known(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    ends = list(range(1, n + 1))  # a token from i reaches to ends[i], where the next one starts
    before = list(range(-1, n - 1))
    pair_rank: list[int | None] = [None] * n
    buckets: dict[int, list[int]] = {}
    leaves: dict[int, int] = {}
    top = 0
    for i in range(n - 1):
        rank = known(piece[i : i + 2])
        if rank is not None:
            pair_rank[i] = rank
            bucket = buckets.get(rank)
            if bucket is None:
                buckets[rank] = [i]
                leaf = rank // LEAF
                leaves[leaf] = leaves.get(leaf, 0) | 1 << rank % LEAF
                top |= 1 << leaf
            else:
                bucket.append(i)  # positions come in order: a list in order is a heap
    while top:
        leaf = (top & -top).bit_length() - 1
        bits = leaves[leaf]
        low = (bits & -bits).bit_length() - 1
        rank = leaf * LEAF + low
        bucket = buckets[rank]
        i = heappop(bucket)
        if not bucket:
            del buckets[rank]
            leaves[leaf] = bits = bits & (bits - 1)
            if not bits:
                top &= top - 1
        if pair_rank[i] != rank:
            continue  # stale
        right = ends[i]
        end = ends[i] = ends[right]
        pair_rank[right] = None
        changed = []
        if end < n:
            before[end] = i
            pair_rank[i] = new = known(piece[i : ends[end]])
            if new is not None:
                changed.append((new, i))
        else:
            pair_rank[i] = None
        left = before[i]
        if left >= 0:
            pair_rank[left] = new = known(piece[left:end])
            if new is not None:
                changed.append((new, left))
        for new, at in changed:
            bucket = buckets.get(new)
            if bucket is None:
                buckets[new] = [at]
                leaf = new // LEAF
                leaves[leaf] = leaves.get(leaf, 0) | 1 << new % LEAF
                top |= 1 << leaf
            else:
                heappush(bucket, at)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return ids


class Codec(dict):
    """Packed ids (little-endian, 32 bits) by pre-token; unseen pre-tokens are encoded, short ones kept up to a bound."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.held = 0
        self.ranks = read_ranks(path)
        self.split = Splitter(pattern)
        # All tokens in one run of bytes, by id: where each starts and how long it is.
        tokens = {rank: token for token, rank in self.ranks.items()}
        own = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.pool = np.frombuffer(b"".join(own), np.uint8)
        self.sizes = np.array([len(t) for t in own], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        packed = b"".join(i.to_bytes(4, "little") for i in merge(data, self.ranks))
        if len(data) <= KEPT_BYTES:
            if self.held >= CACHE_BYTES:
                self.clear()
                self.held = 0
            self.held += ENTRY_BYTES + len(packed)
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        ids = np.frombuffer(packed, "<u4")
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        places = np.repeat(self.starts[ids] - (ends - sizes), sizes)
        return self.pool[places + np.arange(len(places))].tobytes()


def codec(path: str, pattern: str) -> Codec:
    """One per Python worker, kept between tasks."""
    holds_cache("byte_bpe", _loaded.clear)
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Codec(path, pattern)
    return _loaded[path, pattern]


def encode(text: Column, path: str, pattern: str) -> Column:
    """Packed ids of a text column as binary, four little-endian bytes an id; null and empty texts have no ids."""

    @F.arrow_udf("binary")
    def packed_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for batch in batches:
            yield pa.array([own.encode(t.as_py() or "") for t in batch], pa.binary())

    return packed_ids(text)


def decode(packed: Column, path: str, pattern: str) -> Column:
    """The bytes that packed ids stand for; null gives no bytes."""

    @F.arrow_udf("binary")
    def token_bytes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for batch in batches:
            yield pa.array([own.decode(p.as_py() or b"") for p in batch], pa.binary())

    return token_bytes(packed)


def coded(text: Column, path: str, pattern: str) -> Column:
    """Struct of packed ids and of the bytes they decode to. Both are made in one worker, which holds one codec."""

    @F.arrow_udf("struct<ids:binary,decoded:binary>")
    def round_trips(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = codec(path, pattern)
        for batch in batches:
            ids = [own.encode(t.as_py() or "") for t in batch]
            decoded = [own.decode(packed) for packed in ids]
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], names=["ids", "decoded"])

    return round_trips(text)


def round_trip(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (packed) and decoded bytes of every text. No shuffle; equal rows each give a row.

    Null and empty texts give empty ids and bytes; a null id stays null; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = pick(docs, doc_id=id_column, text=text_column)
    return rows.select("doc_id", coded(F.col("text"), path, pattern).alias("c")).select("doc_id", "c.ids", "c.decoded")

"""Near-duplicate classes by DartMinHash signatures and banded joining.

Elements are a text's distinct five-word shingles, with weight one (or how often they occur). Each unit of an element's
weight is a region into which darts are thrown: a Poisson process of ranks made from hashes of the element alone, so
equal elements have equal darts in every text. Each dart also hashes to a coordinate, and the earliest dart per
coordinate is the signature. Two texts agree in a coordinate with the probability of their (weighted) Jaccard
similarity, and a text throws about k ln k darts, however many elements it has.

Texts with equal shingle sets are collapsed first. Bands of the signature are joined: in a bucket, members are compared
with one centre, not with each other, and links (exact similarity at or over the threshold) join classes. What a bucket
still holds of different classes is compared with another centre. The texts of buckets that are mixed even then form
crowds (texts joined by such buckets), often edited copies of one text that are too far from each other to be linked.

A crowd is not paired off. It has a reference, one of its texts, and each text is written as its difference from that:
the shingles that one of the two has and the other has not. Two texts differ in what their differences do not share, and
a link allows them to differ in D = (1 - t) / (1 + t) of their sizes' sum only. So two linked texts share an element of
their differences, and if those are sorted rarest first, the first shared one stands at places that sum to D at most;
or both differences together have no more than D elements, and then both texts are linked to the text for which the
size of its difference, less its share of D, is least. Such places are joined, and one such text a crowd. So no link
between different texts of a crowd is lost, no large class is expanded, and copies of a text that were edited
differently do not meet, since what they have in common is not in their differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import holds_cache, in_place, pick, small_batches, stored, text_blocks, with_row_id

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS = 32
BAND_ROWS = 6  # a pair at 0.8 shares no band with a probability of 6e-5
BROADCAST_ROWS = 1_000_000  # of sixteen bytes
BLOCK_CHARS = 2 << 20

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)
SIGNATURE = "struct<set_key:binary,bands:array<bigint>>"


def mix(x: np.ndarray) -> np.ndarray:
    """A good hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """Hashes by word, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 300_000:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value


_word_hashes = _WordHashes()


def shingle_hashes(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """A hash of each run of `size` words in order; a text of fewer words, but not none, has one of all its words.

    Words are runs without ASCII white space, with A-Z in lower case.
    """
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    holds_cache("near_dedup", _word_hashes.clear)
    hashes = np.fromiter(map(_word_hashes.__getitem__, words), np.uint64, len(words))
    size = min(size, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        out = mix(out * _STEP + hashes[i : len(words) - size + 1 + i])
    return out


def dart_signatures(texts: np.ndarray, elements: np.ndarray, weights: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """Signatures (n_texts x k dart ids) of weighted sets given as (text, element, weight); zeros without elements."""
    whole = np.ceil(weights).astype(np.int64)
    if whole.size and whole.max() > 1:  # one region for each unit of weight; the last may be cut
        owner = np.repeat(np.arange(len(whole)), whole)
        unit = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
        texts, elements, room = texts[owner], mix(elements[owner] + unit.astype(np.uint64) * _STEP), weights[owner] - unit
    else:
        room = weights
    total = np.bincount(texts, weights=np.minimum(room, 1.0), minlength=n_texts)
    best = np.full((n_texts, k), np.inf)
    ids = np.zeros(n_texts * k, np.uint64)
    thrown = total > 0
    reach = np.zeros(n_texts)  # ranks up to which a text's darts count so far
    reach[thrown] = k * (np.log(k) + 2) / total[thrown]
    state = mix(elements + _STEP)
    rank = np.zeros(len(texts))  # of each region's next dart
    dart = np.zeros(len(texts), np.uint64)

    def draw(regions: np.ndarray) -> None:
        own = state[regions]
        rank[regions] -= np.log(((own >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        dart[regions] = mix(own ^ _MIX[0])
        state[regions] = mix(own + _STEP)

    active = np.arange(len(texts))
    draw(active)
    active = active[rank <= reach[texts]]
    while True:
        while active.size:
            _throw(best.ravel(), ids, texts, rank, room, dart, active, k)
            draw(active)
            active = active[rank[active] <= reach[texts[active]]]
        short = thrown & np.isinf(best).any(axis=1)
        if not short.any():
            return ids.reshape(n_texts, k)
        reach[short] *= 1.5
        active = np.flatnonzero(short[texts] & (rank <= reach[texts]))


def _throw(best, ids, texts, rank, room, dart, regions, k) -> None:
    """Keep the earliest dart per text and coordinate."""
    darts, ranks = dart[regions], rank[regions]
    place = texts[regions] * k + (darts % np.uint64(k)).astype(np.int64)
    inside = ranks < best[place]
    left = room[regions]
    if (left < 1.0).any():
        inside &= (mix(darts + _STEP) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < left
    place, ranks, darts = place[inside], ranks[inside], darts[inside]
    np.minimum.at(best, place, ranks)
    first = ranks == best[place]
    ids[place[first]] = darts[first]


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key of each band of each signature, signed as Spark's longs are."""
    n, k = signatures.shape
    parts = signatures.reshape(n, bands, k // bands)
    out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
    for i in range(parts.shape[2]):
        out = mix(out * _STEP + parts[:, :, i])
    return out.view(np.int64)


def _sets(texts: list[str], size: int, counted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, element, weight) of a block of texts; elements of a text are sorted."""
    each = [np.unique(shingle_hashes(t, size), return_counts=True) for t in texts]
    places = np.repeat(np.arange(len(texts)), [len(e) for e, _ in each])
    elements = np.concatenate([e for e, _ in each]) if each else np.empty(0, np.uint64)
    counts = np.concatenate([c for _, c in each]) if each else np.empty(0, np.int64)
    return places, elements, counts.astype(float) if counted else np.ones(len(counts))


def signature(text: Column, size: int, bands: int, rows: int, counted: bool) -> Column:
    """Struct of a key of the shingle set and the band keys; both null for a text without words."""

    @F.arrow_udf(SIGNATURE)
    def signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            keys: list[bytes | None] = []
            own: list[list[int] | None] = []
            for block in text_blocks((t.as_py() for t in batch), BLOCK_CHARS):
                texts, elements, weights = _sets(block, size, counted)
                made = band_keys(dart_signatures(texts, elements, weights, len(block), bands * rows), bands)
                bounds = np.searchsorted(texts, np.arange(len(block) + 1))
                for i in range(len(block)):
                    low, high = bounds[i], bounds[i + 1]
                    known = elements[low:high].tobytes() + (weights[low:high].tobytes() if counted else b"")
                    keys.append(xxhash.xxh3_128_digest(known) if high > low else None)
                    own.append(made[i].tolist() if high > low else None)
            columns = [pa.array(keys, pa.binary()), pa.array(own, pa.list_(pa.int64()))]
            yield pa.StructArray.from_arrays(columns, names=["set_key", "bands"])

    return signed(text)


def shingle_set(text: Column, size: int) -> Column:
    """The distinct shingle hashes of a text."""

    @F.arrow_udf("array<bigint>")
    def shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py() or "", size)).view(np.int64) for t in batch]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets], dtype=np.int64))).astype(np.int32)
            values = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))

    return shingles(text)


def linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least `threshold`."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("sa", "sb"))
    alike = common >= threshold * (F.size("sa") + F.size("sb") - common) - 1e-9
    # A bound by sizes first: the smaller set cannot hold more than all of its own.
    possible = F.least(F.size("sa"), F.size("sb")) >= threshold * F.greatest(F.size("sa"), F.size("sb")) - 1e-9
    return both.filter(F.when(possible, alike).otherwise(False)).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) of every node of the links (a, b).

    Rounds of large stars and small stars: every node hands its larger, then its smaller, neighbours to the smallest
    one it knows, until nothing changes. Only a count and a checksum reach the driver. A table of at most
    BROADCAST_ROWS rows is broadcast; else a node with very many links is a skewed key of a join, never one group.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    while True:
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select("v", "v").distinct())
        before = after
        side = F.broadcast if after[0] <= BROADCAST_ROWS else lambda df: df
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(side(least), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(side(least), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        edges = stored(small.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), "edges")


def _members(reps: DataFrame) -> DataFrame:
    """bucket, node, centre of every bucket of two nodes or more; the centre is its smallest node."""
    banded = reps.select("node", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("centre")).filter("n > 1")
    return banded.join(buckets.select("bucket", "centre"), "bucket")


def classes(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    threshold: float = THRESHOLD,
    size: int = SHINGLE_WORDS,
    bands: int = BANDS,
    rows: int = BAND_ROWS,
    counted: bool = False,
) -> DataFrame:
    """row, doc_id, class_id and kept of every document; docs must be a scan (see with_row_id).

    Documents are in one class if a chain of links, each of similarity `threshold` or more between shingle sets, joins
    them. class_id is the smallest doc_id of the class and kept is true for one row of it (of equal ids, the first).
    A null or empty text has no shingles and is a class of its own; a null id counts as the smallest. Equal rows are
    one class, of which one is kept. `counted` weighs shingles in the signature by how often they occur.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = with_row_id(pick(docs, doc_id=id_column, text=text_column))
    signed = stored(base.select("row", "doc_id", signature(F.col("text"), size, bands, rows, counted).alias("s")).select("row", "doc_id", "s.*"), "signatures")
    reps = stored(
        signed.filter("set_key IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "row")).alias("first"), F.first("bands").alias("bands"))
        .select("set_key", "first", F.col("first.row").alias("node"), "bands"),
        "representatives",
    )
    members = stored(_members(reps), "members")
    involved = members.select("node").distinct()
    sets = stored(
        base.select(F.col("row").alias("node"), "text").join(involved, "node").select("node", shingle_set(F.col("text"), size).alias("shingles")), "sets"
    )
    pairs = stored(members.filter("centre < node").groupBy("node").agg(F.min("centre").alias("a")).select("a", F.col("node").alias("b")), "pairs")
    links = stored(linked(pairs, sets, threshold), "links")
    tested = pairs
    comps = stored(components(links), "components")
    for find in (_star_pairs, _crowd_pairs):
        open_members = stored(_open(members, comps), "open")
        if open_members.isEmpty():
            break
        pairs = stored(find(open_members, sets, threshold).join(tested, ["a", "b"], "left_anti"), "pairs")
        links = stored(links.unionByName(linked(pairs, sets, threshold)), "links")
        tested = tested.unionByName(pairs)
        comps = stored(components(links), "components")
    known = reps.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    firsts = known.groupBy("comp").agg(F.min("first").alias("head"))
    heads = known.join(firsts, "comp").select("set_key", "head")
    placed = signed.select("row", "doc_id", "set_key").join(heads, "set_key", "left")
    alone = F.col("set_key").isNull()
    return placed.select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        (alone | (F.col("head.row") == F.col("row"))).alias("kept"),
    )


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """bucket, node and comp of the buckets with more than one class."""
    placed = members.select("bucket", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high")
    return placed.join(mixed.select("bucket"), "bucket")


def _star_pairs(open_members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """For each node one centre of another class, from the centres of its buckets."""
    centres = open_members.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "comp")).alias("c"))
    met = open_members.join(centres, "bucket").filter("c.comp <> comp")
    chosen = met.groupBy("node").agg(F.min("c").alias("c"))
    return chosen.select(F.least("node", "c.node").alias("a"), F.greatest("node", "c.node").alias("b")).distinct()


def _crowd_pairs(open_members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs among which are all links between different classes of a crowd, but for those through a third text.

    The reference of a crowd is the text that most of its buckets hold. Texts of the reference's class are compared with
    texts of other classes only.
    """
    share = (1 - threshold) / (1 + threshold)  # of the sizes' sum, by which linked sets may differ
    centres = open_members.groupBy("bucket").agg(F.min("node").alias("a"))
    joined = open_members.join(centres, "bucket").filter("a < node").select("a", F.col("node").alias("b")).distinct()
    crowds = components(joined).withColumnRenamed("comp", "crowd")
    nodes = stored(open_members.groupBy("node", "comp").agg(F.count("*").alias("held")).join(crowds, "node"), "crowds")
    heads = nodes.groupBy("crowd").agg(F.max(F.struct("held", F.negative("node").alias("back"), "node", "comp")).alias("h"))
    heads = heads.select("crowd", F.col("h.node").alias("node"), F.col("h.comp").alias("main"))
    references = heads.join(sets, "node").select("crowd", "main", F.col("shingles").alias("reference"))
    with_sets = nodes.select("node", "comp", "crowd").join(sets, "node").join(references, "crowd")
    differences = with_sets.select(
        "crowd",
        "node",
        "comp",
        (F.col("comp") != F.col("main")).alias("outside"),
        F.size("shingles").alias("n"),
        F.concat(F.array_except("shingles", "reference"), F.array_except("reference", "shingles")).alias("d"),
    )
    differences = stored(differences, "differences")

    own = F.size("d") - share * F.col("n")
    nearest = differences.groupBy("crowd").agg(F.min(F.struct(own.alias("over"), "node", "comp")).alias("m"))
    stars = differences.join(nearest, "crowd").filter((F.col("m.comp") != F.col("comp")) & (F.col("m.over") + own <= 1e-9))
    stars = stars.select(F.least("node", "m.node").alias("a"), F.greatest("node", "m.node").alias("b"))

    elements = differences.select("crowd", "node", F.explode("d").alias("e"))
    common = elements.groupBy("crowd", "e").agg(F.count("*").alias("df")).filter("df > 1")
    ranked = elements.join(common, ["crowd", "e"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("es"))
    # Elements that one text alone has come first; a linked text's size is at most n / threshold.
    alone = F.size("d") - F.size("es")
    most = share * (F.col("n") + F.col("n") / threshold) + 1e-9
    placed = (
        differences.join(ranked, "node")
        .select("crowd", "node", "comp", "outside", "n", F.size("d").alias("size"), alone.alias("alone"), "es", most.alias("most"))
        .filter("alone <= most")
        .select("crowd", "node", "comp", "outside", "n", "size", "alone", F.posexplode(F.expr("slice(es, 1, CAST(floor(most) AS INT) + 1 - alone)")).alias("i", "e"))
        .select("crowd", "node", "comp", "outside", "n", "size", (F.col("alone") + F.col("i")).alias("place"), F.col("e.e").alias("e"))
    )
    placed = stored(placed, "places")
    x, y = placed.filter("outside").alias("x"), placed.alias("y")
    allowed = share * (F.col("x.n") + F.col("y.n")) + 1e-9
    shared = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place"))
    met = (
        (F.col("x.crowd") == F.col("y.crowd"))
        & (F.col("x.e") == F.col("y.e"))
        & (F.col("x.comp") != F.col("y.comp"))
        & (~F.col("y.outside") | (F.col("x.node") < F.col("y.node")))
        & (F.col("x.place") + F.col("y.place") <= allowed)
        & (F.col("x.size") + F.col("y.size") - 2 * shared <= allowed)
    )
    pairs = x.join(y, met).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return pairs.unionByName(stars).distinct()


def keep_one(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row of docs of each near-duplicate class, with all its columns; docs must be a scan (see with_row_id).

    Of a class stays the row with the smallest id (null first), of equal ids the first. A null or empty text is a class of
    its own, so its row stays, also if repeated. An empty table gives no rows. Columns may have any names.
    """
    dropped = classes(docs, id_column, text_column).filter("NOT kept").select(F.col("row").alias("_row"))
    return in_place(docs, lambda df: with_row_id(df, "_row").join(dropped, "_row", "left_anti"))

"""Histogram gradient boosting with second-order gains, L2 and sampling of rows and columns.

Features are cut into bins at quantiles once, and rows are kept as blocks: a byte per feature and row, with label, weight,
hash and margin. A level of a tree is one job: each task adds up gradients and second derivatives per (node, feature, bin)
over its blocks, the sums of tasks are added in a tree of bounded width, and the task that adds the last of them chooses the
level's splits: the driver gets a few numbers a node, never a histogram. Rows are sampled by their hash and columns by a
seeded choice, so a lost task redoes the same work. These small jobs, four a tree, run over the rows of the blocks as an
RDD: planned as DataFrames each took some 50 ms before any work, so 29. Margins are written with the blocks every CHECKPOINT
rounds; between, a task adds the trees made since.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.operators import ranks
from riskspark.operators.sampling import row_hash

# The settings of the boosted trees.
ROUNDS, DEPTH, RATE, MIN_CHILD_WEIGHT, ROW_SHARE, COLUMN_SHARE, L2 = 450, 4, 0.04, 2.0, 0.9, 0.9, 1.0

BINS = 256
BLOCK_ROWS = 65_536
CHECKPOINT = 50  # rounds between two writings of the margins
WIDTH = 32  # histograms added up in one place
SCORE_CELLS = 2_000_000  # rows x trees scored at once
CACHED_BYTES = 128 << 20  # of margins that a Python worker keeps from one level to the next
BLOCK = "block long, rows int, bins binary, label binary, weight binary, hash binary, margin binary"
NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, cover double"


@dataclass
class BoostedTrees:
    """Complete trees of one depth in heap order: node i has children 2 i + 1 and 2 i + 2. feature -1 marks a leaf."""

    features: list[str]
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x nodes, used where a leaf is
    cover: np.ndarray  # trees x nodes, sums of second derivatives

    @property
    def depth(self) -> int:
        return int(math.log2(self.value.shape[1] + 1)) - 1

    def node_table(self, spark: SparkSession) -> DataFrame:
        """The nodes as trees.leaf_table reads them."""
        rows = []
        for tree in range(len(self.value)):
            pending = [0]
            while pending:
                node = pending.pop()
                feature = int(self.feature[tree, node]) if node < self.feature.shape[1] else -1
                cover = float(self.cover[tree, node])
                if feature < 0:
                    rows.append((tree, node, None, None, None, None, float(self.value[tree, node]), cover))
                else:
                    rows.append((tree, node, feature, float(self.threshold[tree, node]), 2 * node + 1, 2 * node + 2, 0.0, cover))
                    pending += [2 * node + 1, 2 * node + 2]
        return spark.createDataFrame(rows, NODES)

    @classmethod
    def from_nodes(cls, nodes: DataFrame, features: Sequence[str]) -> BoostedTrees:
        rows = nodes.collect()
        trees = 1 + max((r["tree"] for r in rows), default=-1)
        depth = max((int(math.log2(r["node"] + 1)) for r in rows), default=0)
        own = cls(list(features), *_empty(trees, depth))
        for r in rows:
            own.value[r["tree"], r["node"]], own.cover[r["tree"], r["node"]] = r["value"], r["cover"]
            if r["feature"] is not None:
                own.feature[r["tree"], r["node"]], own.threshold[r["tree"], r["node"]] = r["feature"], r["threshold"]
        return own

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Sums of leaf values; a missing value goes left."""
        bottom, feature, threshold = self._filled()
        out = np.zeros(len(x))
        trees = np.arange(len(bottom))
        block = max(1, SCORE_CELLS // max(1, len(bottom)))
        for start in range(0, len(x), block):
            rows = x[start : start + block]
            at = np.zeros((len(rows), len(bottom)), np.int64)
            line = np.arange(len(rows))[:, None]
            for _ in range(self.depth):
                at = 2 * at + 1 + (rows[line, feature[trees, at]] > threshold[trees, at])
            out[start : start + block] = bottom[trees, at - feature.shape[1]].sum(axis=1)
        return out

    def _filled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of the bottom nodes and splits of all others, where what lies below a leaf repeats it."""
        value, feature, threshold = self.value.copy(), self.feature.copy(), self.threshold.copy()
        for node in range(feature.shape[1]):
            leaf = feature[:, node] < 0
            feature[leaf, node], threshold[leaf, node] = 0, np.inf
            for child in (2 * node + 1, 2 * node + 2):
                value[leaf, child] = value[leaf, node]
                if child < feature.shape[1]:
                    feature[leaf, child] = -1
        return value[:, feature.shape[1] :], feature, threshold

    def probability(self, spark: SparkSession, vector: Column) -> Column:
        """Probability of the positive class, in Arrow batches; the trees are broadcast (2^(depth + 1) nodes each)."""
        shared = spark.sparkContext.broadcast(self)

        @F.arrow_udf("double")
        def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            own = shared.value
            for batch in batches:
                x = batch.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), len(own.features))
                yield pa.array(1.0 / (1.0 + np.exp(-own.margins(x))))

        return score(vector)


def _empty(trees: int, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    inner, nodes = 2**depth - 1, 2 ** (depth + 1) - 1
    return np.full((trees, inner), -1, np.int64), np.zeros((trees, inner)), np.zeros((trees, nodes)), np.zeros((trees, nodes))


def _share(hashes: np.ndarray, number: int) -> np.ndarray:
    """A number in 0..1 for each row and round."""
    x = hashes ^ np.uint64((number + 1) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) * 2.0**-53


def bin_cuts(train: DataFrame, features: Sequence[str], bins: int) -> tuple[int, list[np.ndarray]]:
    """Rows, and cut values of each feature, from mergeable quantile sketches in one pass; a value falls below its first cut >= it."""
    shares = [i / (bins - 1) for i in range(1, bins - 1)]
    sketches = [F.percentile_approx(F.nanvl(F.col(f).cast("double"), F.lit(None)), shares, 20 * bins).alias(f"q{i}") for i, f in enumerate(features)]
    row = train.agg(F.count("*").alias("rows"), *sketches).first()
    # The first bin is that of missing values.
    return row["rows"], [np.unique(np.array([-np.inf, *(row[f"q{i}"] or [])])) for i in range(len(features))]


def _blocks(train: DataFrame, features: Sequence[str], label: str, weight: float, cuts: list[np.ndarray], seed: int) -> DataFrame:
    """The training rows as blocks of bytes."""
    vector = F.array(*[F.col(f).cast("double") for f in features])
    rows = train.select(F.col(label).cast("double").alias("y"), vector.alias("x"), row_hash(train, seed, [label, *features]).alias("h"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, len(cuts))
            binned = np.empty(x.shape, np.uint8)
            for j, own in enumerate(cuts):
                binned[:, j] = np.searchsorted(own, np.where(np.isnan(x[:, j]), -np.inf, x[:, j]), side="left")
            y = batch.column("y").to_numpy(zero_copy_only=False)
            hashes = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(y), BLOCK_ROWS):
                part = slice(start, start + BLOCK_ROWS)
                own_y = y[part]
                columns = [binned[part].tobytes(), own_y.tobytes(), np.where(own_y == 1, weight, 1.0).tobytes(), hashes[part].tobytes(), np.zeros(len(own_y)).tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([0]), pa.array([len(own_y)], pa.int32()), *[pa.array([c], pa.binary()) for c in columns]],
                    names=["block", "rows", "bins", "label", "weight", "hash", "margin"],
                )

    return rows.mapInArrow(pack, BLOCK).withColumn("block", F.monotonically_increasing_id())


_margins: dict[tuple[str, int], tuple[int, np.ndarray]] = {}


class Block:
    """A block's arrays, with the margin that given trees add.

    A worker that met the block earlier in this run still has its margin and only adds the trees made since; any other
    worker starts from the written one. `first` is the number of the first tree.
    """

    def __init__(self, row: dict[str, object], width: int, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]], run: str, first: int):
        self.bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, width)
        self.y, self.weight = np.frombuffer(row["label"]), np.frombuffer(row["weight"])
        self.hash = np.frombuffer(row["hash"], np.uint64)
        done, self.margin = _margins.pop((run, row["block"]), (first, np.frombuffer(row["margin"])))
        if not first <= done <= first + len(trees):
            done, self.margin = first, np.frombuffer(row["margin"])
        for feature, cut, value in trees[done - first :]:
            self.margin = self.margin + value[self.leaf(feature, cut)]
        if sum(m.nbytes for _, m in _margins.values()) + self.margin.nbytes > CACHED_BYTES:
            _margins.clear()
        _margins[run, row["block"]] = (first + len(trees), self.margin)

    def leaf(self, feature: np.ndarray, cut: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node of each row: a leaf, or the one that is reached after so many levels."""
        at = np.zeros(len(self.bins), np.int64)
        line = np.arange(len(at))
        depth = int(math.log2(len(feature) + 1)) if levels is None else levels
        for _ in range(depth):
            inner = np.flatnonzero((at < len(feature)) & (feature[np.minimum(at, len(feature) - 1)] >= 0))
            own = at[inner]
            at[inner] = 2 * own + 1 + (self.bins[line[inner], feature[own]] > cut[own])
        return at


def _added(parts: RDD, number: int) -> RDD:
    """One row: the sum of the histograms (place, sums) of all partitions, added in places of at most WIDTH, in a fixed order."""

    def total(held: list[tuple[int, np.ndarray]]) -> np.ndarray:
        return sum(sums for _, sums in sorted(held, key=lambda part: part[0]))

    while number > 1:
        number = -(-number // WIDTH)
        parts = parts.map(lambda part: (part[0] // WIDTH, part)).groupByKey(number).mapValues(lambda held: total(list(held)))
    return parts.values()


def best_splits(sums: np.ndarray, l2: float, least: float) -> list[tuple[float, int, int, float, float, float, float]]:
    """For each node (gain, column, bin, sums left, sums right) of the best split; gain 0 without one.

    sums is nodes x columns x bins x (first, second derivatives). A split at a bin sends that bin and those below it left.
    """
    out = []
    for node in sums:
        left = node.cumsum(axis=1)
        total = left[:, -1:, :]
        right = total - left
        score = lambda s: s[..., 0] ** 2 / (s[..., 1] + l2)
        gain = score(left) + score(right) - score(total)
        gain[(left[..., 1] < least) | (right[..., 1] < least)] = 0.0
        column, cut = np.unravel_index(np.argmax(gain[:, :-1]), gain[:, :-1].shape)
        best = float(gain[column, cut])
        out.append((best, int(column), int(cut), *map(float, left[column, cut]), *map(float, right[column, cut])))
    return out


def fit_histogram_trees(
    train: DataFrame,
    features: Sequence[str] = tuple(S.FEATURES),
    label: str = S.TARGET,
    positive_weight: float = 1.0,
    seed: int = 42,
    rounds: int = ROUNDS,
    depth: int = DEPTH,
    rate: float = RATE,
    min_child_weight: float = MIN_CHILD_WEIGHT,
    row_share: float = ROW_SHARE,
    column_share: float = COLUMN_SHARE,
    l2: float = L2,
    bins: int = BINS,
) -> BoostedTrees:
    """Boosted trees for a 0/1 label under the logistic loss.

    A null or NaN feature counts as lower than all values. Equal rows are sampled together. An empty table, or one class
    only, gives trees of one leaf.
    """
    spark = train.sparkSession
    rows, cuts = bin_cuts(train, features, min(bins, 256))
    width, most = len(features), 1 + max((len(c) for c in cuts), default=0)
    tasks = max(1, -(-rows // BLOCK_ROWS))  # fewer than the scan's where its parts are small

    def kept(made: DataFrame) -> tuple[DataFrame, RDD]:
        """Blocks written, and their rows held in memory as long as executors can; the table is there if they cannot."""
        table = ranks.work_table(made, "blocks").coalesce(tasks)
        return table, table.rdd.map(lambda row: row.asDict()).persist(StorageLevel.MEMORY_AND_DISK)

    blocks, held = kept(_blocks(train.coalesce(tasks), features, label, float(positive_weight), cuts, seed))
    feature, threshold, value, cover = _empty(rounds, depth)
    cut_bins = np.zeros_like(feature)
    rng = np.random.default_rng(seed)
    since, run = 0, uuid.uuid4().hex

    def level_splits(done: int, tree: int, level: int, columns: np.ndarray) -> tuple[tuple[float, float], list[tuple]]:
        """The sums of the level's first node, and the best split of each of its nodes."""
        earlier = [(feature[t], cut_bins[t], value[t]) for t in range(done, tree)]
        own_feature, own_cut = feature[tree].copy(), cut_bins[tree].copy()
        nodes, first = 2**level, 2**level - 1

        def add(place: int, rows: Iterator[dict[str, object]]) -> Iterator[tuple[int, np.ndarray]]:
            total = np.zeros((2, len(columns), nodes * most))
            for row in rows:
                own = Block(row, width, earlier, run, done)
                at = own.leaf(own_feature, own_cut, level) - first
                used = np.flatnonzero((at >= 0) & (_share(own.hash, tree) < row_share))
                p = 1.0 / (1.0 + np.exp(-own.margin[used]))
                g, h = own.weight[used] * (p - own.y[used]), own.weight[used] * p * (1.0 - p)
                base = at[used] * most
                binned = own.bins[used]
                for j, column in enumerate(columns):
                    slot = base + binned[:, column]
                    total[0, j] += np.bincount(slot, g, nodes * most)
                    total[1, j] += np.bincount(slot, h, nodes * most)
            yield place, total

        def choose(total: np.ndarray) -> tuple[tuple[float, float], list[tuple]]:
            sums = total.reshape(2, len(columns), nodes, most).transpose(2, 1, 3, 0)
            g, h = map(float, sums[0, 0].sum(axis=0))
            return (g, h), best_splits(sums, l2, min_child_weight)

        return _added(held.mapPartitionsWithIndex(add), held.getNumPartitions()).map(choose).first()

    for tree in range(rounds):
        columns = np.sort(rng.choice(width, max(1, round(column_share * width)), replace=False))
        for level in range(depth):
            first = 2**level - 1
            (g, h), splits = level_splits(since, tree, level, columns)
            if level == 0:
                value[tree, 0], cover[tree, 0] = -rate * g / (h + l2), h
            grown = False
            for i, (gain, column, cut, *sides) in enumerate(splits):
                node = first + i
                if gain <= 1e-6 or (node and feature[tree, (node - 1) // 2] < 0):
                    continue
                grown = True
                feature[tree, node], cut_bins[tree, node] = columns[column], cut
                threshold[tree, node] = cuts[columns[column]][cut]
                for side, (g, h) in enumerate((sides[:2], sides[2:])):
                    child = 2 * node + 1 + side
                    value[tree, child], cover[tree, child] = -rate * g / (h + l2), h
            if not grown:
                break
        if tree + 1 - since == CHECKPOINT and tree + 1 < rounds:
            made = [(feature[t], cut_bins[t], value[t]) for t in range(since, tree + 1)]

            def advance(batches: Iterator[pa.RecordBatch], made=made, since=since) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    margins = [Block(row, width, made, run, since).margin.tobytes() for row in batch.to_pylist()]
                    place = batch.schema.get_field_index("margin")
                    yield batch.set_column(place, "margin", pa.array(margins, pa.binary()))

            moved = kept(blocks.mapInArrow(advance, BLOCK))
            held.unpersist()
            (blocks, held), since = moved, tree + 1
    held.unpersist()
    return BoostedTrees(list(features), feature, threshold, value, cover)

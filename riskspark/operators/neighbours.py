"""Exact k nearest neighbours of every point of a table among all points of it, as a partitioned join.

Every point belongs to the cell of its nearest pivot. What is known of a cell (its radius, its k + 1 points nearest to the
pivot) bounds how far the neighbours of any of its points can be, and by the triangle inequality which points of which
other cells can be among them. Cells are put into groups of about `group_rows` points; a group receives the points that
some cell of it still allows, in chunks of the same size, and each pair of query part and chunk is one task. The nearest
ones of all chunks are merged. So no task, broadcast or driver holds the table: pivots and cells number about twice the
square root of the rows. Where bounds are weak (many dimensions, no clusters) more points are sent, never fewer found.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.operators import ranks
from riskspark.operators.sampling import lowest_per_group

GROUP_ROWS = 10_000
BLOCK_ROWS = 256
NEAR = "array<struct<square:double,id:long,n:long,x:array<double>>>"
FOUND = f"id long, found {NEAR}"
SPARE = 8  # more than k are taken by the fast distance, then told apart by the exact one


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        return np.empty((0, width))
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by the fast formula, which rounds."""
    return np.maximum((a**2).sum(axis=1)[:, None] - 2.0 * a @ b.T + (b**2).sum(axis=1)[None, :], 0.0)


def nearest_in(queries: np.ndarray, own: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and squared distances of the k nearest rows of `data`, the query's own id left out, ties by id.

    Missing ones (fewer than k others) have an infinite distance. The fast formula shortlists, the plain one decides; where
    its rounding could hide a nearer row, all rows are measured plainly.
    """
    k = min(k, len(data))
    places = np.empty((len(queries), k), np.int64)
    found = np.empty((len(queries), k))
    short = min(k + SPARE, len(data))
    norms = (data**2).sum(axis=1)
    for start in range(0, len(queries), BLOCK_ROWS):
        block = slice(start, start + BLOCK_ROWS)
        q = queries[block]
        rough = squares(q, data)
        same = own[block][:, None] == ids[None, :]
        rough[same] = np.inf
        listed = np.argpartition(rough, short - 1, axis=1)[:, :short]
        exact = ((data[listed] - q[:, None, :]) ** 2).sum(axis=2)
        exact[np.take_along_axis(same, listed, axis=1)] = np.inf
        order = np.lexsort((ids[listed], exact), axis=1)[:, :k]
        near, at = np.take_along_axis(exact, order, axis=1), np.take_along_axis(listed, order, axis=1)
        slack = 1e-12 * (norms.max(initial=0.0) + (q**2).sum(axis=1)) * max(q.shape[1], 1)
        edge = np.take_along_axis(rough, listed, axis=1).max(axis=1)
        for row in np.flatnonzero((near[:, -1] + slack >= edge - slack) & (short < len(data))):
            plain = ((data - q[row]) ** 2).sum(axis=1)
            plain[same[row]] = np.inf
            best = np.lexsort((ids, plain))[:k]
            near[row], at[row] = plain[best], best
        places[block], found[block] = at, near
    return places, found


def _pivots(points: DataFrame, number: int, seed: int) -> np.ndarray:
    """That many points, chosen by a hash of their ids."""
    rows = points.select("x", F.xxhash64("id", F.lit(seed)).alias("h"), "id").orderBy("h", "id").limit(number).collect()
    return np.array([r["x"] for r in rows], dtype=float)


def _in_cells(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """points with the number of their cell and their distance from its pivot."""
    shared = points.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            x = _matrix(batch.column("x"), own.shape[1])
            cell = np.concatenate([squares(x[i : i + 1024], own).argmin(axis=1) for i in range(0, len(x), 1024)] or [np.empty(0, int)])
            away = np.sqrt(((x - own[cell]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=[*batch.schema.names, "cell", "away"]
            )

    return points.mapInArrow(place, "id long, x array<double>, n long, cell int, away double")


def group_cells(pivots: np.ndarray, sizes: np.ndarray, group_rows: int) -> np.ndarray:
    """A group number for each cell: neighbouring cells together until a group has about `group_rows` points."""
    heads = max(1, math.ceil(sizes.sum() / group_rows))
    if heads == 1:
        return np.zeros(len(pivots), np.int64)
    head, away = np.empty(len(pivots), np.int64), np.empty(len(pivots))
    for start in range(0, len(pivots), 1024):
        between = squares(pivots[start : start + 1024], pivots[:heads])
        head[start : start + 1024], away[start : start + 1024] = between.argmin(axis=1), between.min(axis=1)
    groups = np.empty(len(pivots), np.int64)
    number, held = 0, 0
    for cell in np.lexsort((away, head)):
        if held and held + sizes[cell] > group_rows:
            number, held = number + 1, 0
        groups[cell] = number
        held += sizes[cell]
    return groups


def _reach(cells: DataFrame, pivots: np.ndarray, radius: np.ndarray, lowest: np.ndarray, k: int) -> DataFrame:
    """grp, cell, least: a group needs those points of a cell that are at least `least` away from its pivot.

    `cells` has a row (cell, grp) per cell, all of a group in one task. `lowest` holds the distances from each pivot of its
    k + 1 nearest points; k + 1, since a point is not its own neighbour.
    """
    shared = cells.sparkSession.sparkContext.broadcast((pivots, radius, lowest))

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, radii, near = shared.value
        least: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, group in zip(batch.column("cell").to_pylist(), batch.column("grp").to_pylist()):
                between = np.sqrt(((centres - centres[cell]) ** 2).sum(axis=1))
                # No neighbour of a point of this cell is farther than this.
                at_most = np.partition((radii[cell] + between[:, None] + near).ravel(), k)[k]
                slack = 1e-9 * (1.0 + between.max() + radii.max())
                own = between - radii[cell] - at_most - slack
                least[group] = np.minimum(least[group], own) if group in least else own
        for group, own in least.items():
            needed = np.flatnonzero(own <= radii)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(needed), group)), pa.array(needed.astype(np.int32)), pa.array(own[needed])], names=["grp", "cell", "least"]
            )

    return cells.mapInArrow(bounds, "grp long, cell int, least double")


def nearest_neighbours(points: DataFrame, k: int, group_rows: int = GROUP_ROWS, seed: int = 42) -> DataFrame:
    """id and found: the k nearest other points (square of the distance, id, n, x), nearest first, ties by id.

    points has id (unique), x (all of one length, without gaps) and n, which is handed on. It is read several times, so it
    should be a table. With fewer than k other points all of them are found; an empty table gives no rows.
    """
    spark = points.sparkSession
    points = points.select("id", "x", "n")
    rows = points.count()
    if rows == 0 or k < 1:
        return points.select("id", F.lit([]).cast(NEAR).alias("found"))
    pivots = _pivots(points, min(rows, math.ceil(2 * math.sqrt(rows))), seed)
    placed = ranks.work_table(_in_cells(points, pivots), "cells")

    # A row per cell reaches the driver, as the pivots did.
    sizes, radius = np.zeros(len(pivots), np.int64), np.full(len(pivots), -np.inf)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect():
        sizes[r["cell"]], radius[r["cell"]] = r["n"], r["away"]
    lowest = np.full((len(pivots), k + 1), np.inf)
    nearest = lowest_per_group(placed.select("cell", "away", "id"), ["cell"], "away", k + 1, salts=8)
    for r in nearest.groupBy("cell").agg(F.sort_array(F.collect_list("away")).alias("a")).collect():
        lowest[r["cell"], : len(r["a"])] = r["a"]

    groups = group_cells(pivots, sizes, group_rows)
    cell_rows = [(c, int(g)) for c, g in enumerate(groups) if sizes[c]]
    cells = spark.createDataFrame(cell_rows, "cell int, grp long")
    parts = np.bincount(groups, weights=sizes, minlength=groups.max() + 1)
    part_rows = spark.createDataFrame([(g, max(1, math.ceil(size / group_rows))) for g, size in enumerate(parts.tolist())], "grp long, parts long")
    if rows <= k + 1:
        reach = cells.select("grp").distinct().crossJoin(cells.select("cell")).withColumn("least", F.lit(float("-inf")))  # a few cells
    else:
        reach = _reach(cells.repartition(F.col("grp")), pivots, radius, lowest, k)
    reach = ranks.work_table(reach, "reach")
    cell_sizes = spark.createDataFrame([(c, int(sizes[c])) for c, _ in cell_rows], "cell int, size long")
    chunks = reach.join(cell_sizes, "cell").groupBy("grp").agg(F.ceil(F.sum("size") / group_rows).alias("chunks"))
    plan = ranks.work_table(part_rows.join(chunks, "grp"), "neighbour-plan")

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        """Rows of one side: its own share by hash, repeated for every share of the other side."""
        names = {"parts": "part", "chunks": "chunk"}
        return df.select(
            "grp",
            "id",
            "x",
            "n",
            F.pmod(F.xxhash64("id", F.lit(own)), F.col(own)).alias(names[own]),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(names[other]),
        ).toDF("grp", "id", "x", "n", names[own], names[other])  # columns apart from those of the other side

    queries = spread(placed.join(cells, "cell").join(plan, "grp"), "parts", "chunks")
    allowed = placed.join(reach, "cell").filter("away >= least").join(plan, "grp")
    data = spread(allowed, "chunks", "parts")
    width = pivots.shape[1]

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        own = left.column("id").to_numpy()
        ids, n = right.column("id").to_numpy(), right.column("n").to_numpy()
        x = _matrix(right.column("x"), width)
        q = _matrix(left.column("x"), width)
        if not len(ids) or not len(own):
            return pa.table({"id": pa.array(own, pa.int64()), "found": pa.array([[]] * len(own), _NEAR_ARROW)})
        places, near = nearest_in(q, own, x, ids, k)
        kept = np.isfinite(near)
        ends = np.concatenate(([0], np.cumsum(kept.sum(axis=1)))).astype(np.int32)
        flat = places[kept]
        vectors = pa.ListArray.from_arrays(pa.array((np.arange(len(flat) + 1) * width).astype(np.int32)), pa.array(x[flat].ravel()))
        struct = pa.StructArray.from_arrays([pa.array(near[kept]), pa.array(ids[flat]), pa.array(n[flat]), vectors], names=["square", "id", "n", "x"])
        return pa.table({"id": own, "found": pa.ListArray.from_arrays(pa.array(ends), struct)})

    keys = ["grp", "part", "chunk"]
    partial = queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(find, FOUND)
    merged = partial.groupBy("id").agg(F.flatten(F.collect_list("found")).alias("found"))
    return merged.select("id", F.slice(F.array_sort("found"), 1, k).alias("found"))


_NEAR_ARROW = pa.list_(pa.struct([("square", pa.float64()), ("id", pa.int64()), ("n", pa.int64()), ("x", pa.list_(pa.float64()))]))

"""Minority oversampling by interpolation between nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.operators import ranks
from riskspark.operators.features import feature_vector
from riskspark.operators.neighbours import GROUP_ROWS, nearest_neighbours
from riskspark.operators.sampling import HASH, row_hash, take_lowest


def _nearest_rows(k: int) -> Column:
    """The vectors of a point's k nearest rows, where a point stands for `n` equal rows.

    Its own copies come first, at no distance; then other points, each as often as it has rows; itself if there is none.
    """
    copies = F.array_repeat("x", F.least(F.col("n") - 1, F.lit(k)).cast("int"))
    others = F.flatten(F.transform("found", lambda f: F.array_repeat(f["x"], F.least(f["n"], F.lit(k)).cast("int"))))
    rows = F.slice(F.concat(copies, others), 1, k)
    return F.when(F.size(rows) > 0, rows).otherwise(F.array("x"))


def oversample(
    train: DataFrame,
    features: Sequence[str] = tuple(S.FEATURES),
    label: str = S.TARGET,
    neighbours: int = 5,
    seed: int = 42,
    group_rows: int = GROUP_ROWS,
) -> tuple[DataFrame, dict[str, object]]:
    """Add interpolated minority rows until both classes have the same size.

    Returns the enlarged rows (label and features) and a record of what was done. Each minority row
    gets the same number of synthetic rows, the remainder going to the first rows in hash order.

    Neighbours are the nearest ones of the whole minority, found by a join of parts of about ``group_rows`` points.
    Equal rows are one point that is counted, so a mass of copies is one row of the search.
    """
    sizes = train.agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    ).first()
    pos, neg = sizes["pos"], sizes["neg"]
    base = train.select(label, *features)
    if pos < 2:
        return base, {
            "enabled": False,
            "reason": "There is no second positive row to interpolate with.",
            "minority_count_before": pos,
        }
    small, few, many = (1, pos, neg) if pos <= neg else (0, neg, pos)
    k = min(neighbours, few - 1)
    # The keys of the stored record.
    info = {
        "enabled": True,
        "sampling_strategy": "auto",
        "k_neighbors": min(neighbours, pos - 1),
        "minority_count_before": pos,
        "minority_count_after": max(pos, neg),
        "majority_count_after": max(pos, neg),
    }
    need = many - few
    if need == 0 or k < 1:
        return base, info
    minority = base.filter(F.col(label) == small)
    minority = minority.select(row_hash(minority, seed, list(features)).alias(HASH), feature_vector(features).alias("x"))
    each, rest = divmod(need, few)
    # The minority is read several times: it is written once, as hash and vector.
    minority = ranks.work_table(minority, "minority").withColumn("_all", F.lit(0))
    takes = minority.sparkSession.range(1).select(F.lit(0).alias("_all"), F.lit(rest).alias("take"))
    flagged = take_lowest(minority, takes, "_all", HASH)
    points = flagged.groupBy(HASH, "x").agg(F.count("*").alias("n"), F.count_if("_taken").alias("extra"))
    points = ranks.work_table(points, "points")
    found = nearest_neighbours(points.select(F.col(HASH).alias("id"), "x", "n"), k, group_rows, seed)
    found = points.join(found.withColumnRenamed("id", HASH), HASH).withColumn("near", _nearest_rows(k))
    found = found.select(HASH, "x", "near", (F.col("n") * each + F.col("extra")).alias("_copies"))
    drawn = ranks.expand_copies(found, "_copies", "_copy")
    draw = F.xxhash64(F.lit(seed), HASH, "x", "_copy")
    step = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), HASH, "x", "_copy"), 11) / F.lit(float(2**53))
    drawn = drawn.select(
        "x", F.col("near")[F.pmod(draw, F.size("near")).cast("int")].alias("to"), step.alias("u")
    )
    kinds = dict(base.dtypes)
    values = [f"CAST(x[{i}] + u * (to[{i}] - x[{i}]) AS {kinds[name]}) AS `{name}`" for i, name in enumerate(features)]
    synthetic = drawn.selectExpr(f"CAST({small} AS {kinds[label]}) AS `{label}`", *values)
    return base.unionByName(synthetic), info

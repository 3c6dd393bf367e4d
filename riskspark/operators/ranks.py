"""Running totals and exact order statistics without a one-task sort.

A window without PARTITION BY moves every row into one task. Here the rows are cut into key ranges
instead: range ends are taken from a small sample and used as plain constants, so each pass over the
data puts a row into the same range, whatever is recomputed. A range's rows are ordered on their own
and the total of the ranges before it is added from a table with one row per range.

The range ends only steer balance, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark.session import shared_folder

ROWS_PER_RANGE = 1_000_000
SAMPLES_PER_RANGE = 100
COPIES_PER_TASK_ROW = 10_000
FANOUT = 128  # cuts looked through at once

RANGE = "_range"
_SPLIT_KEY = "_range_key"


def range_ends(
    df: DataFrame, key: Column, rows_per_range: int = ROWS_PER_RANGE, rows: int | None = None
) -> list[float]:
    """Sampled range ends of a numeric key, repeated where one value fills whole ranges.

    Empty when all rows fit one range. ``rows`` saves the counting where the caller knows it. The number of ranges
    grows with the rows, and so does the accuracy of their ends.
    """
    keys = df.select(key.cast("double").alias("k")).filter("k IS NOT NULL")
    rows = keys.count() if rows is None else rows
    ranges = math.ceil(rows / rows_per_range)
    if ranges <= 1:
        return []
    fraction = min(1.0, SAMPLES_PER_RANGE * ranges / rows)
    sample = keys.sample(fraction, seed=7) if fraction < 1.0 else keys
    # One constant, not a column per share: there may be very many.
    shares = F.split(F.lit(",".join(repr(i / ranges) for i in range(1, ranges))), ",").cast("array<double>")
    ends = sample.agg(F.percentile_approx("k", shares, max(10_000, 10 * ranges)).alias("ends")).first()["ends"]
    return sorted(ends or [])


def with_range(df: DataFrame, key: Column, ends: Sequence[float]) -> DataFrame:
    """Add the range number of a key; ranges are closed below and open above."""
    if not ends:
        return df.withColumn(RANGE, F.lit(0))
    inner = sorted(set(ends))
    bucketizer = Bucketizer(
        splits=[-math.inf, *inner, math.inf],
        inputCol=_SPLIT_KEY,
        outputCol=RANGE,
        handleInvalid="keep",
    )
    placed = bucketizer.transform(df.withColumn(_SPLIT_KEY, key.cast("double")))
    return placed.withColumn(RANGE, F.col(RANGE).cast("int")).drop(_SPLIT_KEY)


def with_part(df: DataFrame, cuts: DataFrame, group: str, value: str, most: int, part: str) -> DataFrame:
    """Add how many cuts of its group are at most a row's value: 0 in a group without cuts, or without a value.

    cuts is a table (group, cut), at most ``most`` different ones a group. They are laid out as a search tree of nodes of less
    than FANOUT cuts, a broadcast table a level, so that a row meets few cuts however many its group has. Cut number b
    parts the nodes of the highest level whose width divides b.
    """
    depth = 1
    while FANOUT**depth <= most:
        depth += 1
    order = Window.partitionBy("_group").orderBy("_cut")
    numbered = cuts.select(F.col(group).alias("_group"), F.col("cut").alias("_cut")).filter("_cut IS NOT NULL").distinct()
    numbered = work_table(numbered.withColumn("_number", F.row_number().over(order).cast("long")), "part-cuts")
    steps = [1 << i for i in reversed(range((FANOUT - 1).bit_length()))]
    found = df.withColumn(part, F.lit(0).cast("long"))
    for level in reversed(range(depth)):
        width, above = FANOUT**level, FANOUT ** (level + 1)
        number = F.col("_number")
        own = numbered.filter((number % width == 0) & (number % above != 0))
        nodes = own.groupBy("_group", F.floor(number / above).alias("_node")).agg(F.sort_array(F.collect_list("_cut")).alias("_cuts"))
        met = (F.col(group) == F.col("_group")) & (F.col(part) == F.col("_node"))
        passed = F.aggregate(
            F.array(*map(F.lit, steps)),
            F.lit(0),
            lambda at, step: F.when(F.get("_cuts", at + step - 1) <= F.col(value), at + step).otherwise(at),
        )
        found = found.join(F.broadcast(nodes), met, "left").withColumn(part, F.col(part) * FANOUT + passed)
        found = found.drop("_group", "_node", "_cuts")
    return found.withColumn(part, F.col(part).cast("int"))


def before_range(totals: DataFrame, sums: Sequence[str], by: Sequence[str] = (RANGE,)) -> DataFrame:
    """Totals of all earlier ranges. The input has one row per range, a millionth of the rows or so."""
    earlier = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *by, *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums]
    )


def with_running_sums(
    rows: DataFrame,
    totals: DataFrame | None,
    order: Sequence[Column],
    sums: Mapping[str, str],
    by: Sequence[str] = (RANGE,),
) -> DataFrame:
    """Running sums over ranged rows: order inside each range, plus the earlier ranges' totals.

    ``sums`` maps a value column to the running-sum column to add. ``totals`` holds one row per
    range with a sum under each value column's name; None when there is a single range.
    """
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({out: F.sum(value).over(window) for value, out in sums.items()})
    if totals is None:
        return rows
    offsets = before_range(totals, list(sums), by)
    joined = rows.join(F.broadcast(offsets), list(by))
    added = {out: F.col(out) + F.col(f"_before_{value}") for value, out in sums.items()}
    return joined.withColumns(added).drop(*[f"_before_{value}" for value in sums])


def expand_copies(df: DataFrame, copies: str, position: str) -> DataFrame:
    """Repeat each row ``copies`` times, numbered from 1.

    A row with very many copies is first cut into blocks that are spread over the cluster, so no
    task writes all copies of one row.
    """
    block = COPIES_PER_TASK_ROW
    last = F.floor((F.col(copies) - 1) / block)
    identity = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    few = df.filter(F.col(copies).between(1, block)).withColumn(
        position, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies).cast("long")))
    )
    blocks = (
        df.filter(F.col(copies) > block)
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
        .repartition(F.xxhash64("_block", *identity))
    )
    first = F.col("_block") * block
    many = blocks.withColumn(
        position, F.explode(F.sequence(first + 1, F.least(first + block, F.col(copies).cast("long"))))
    ).drop("_block")
    return few.unionByName(many)


def work_table(df: DataFrame, purpose: str) -> DataFrame:
    """A small result that later steps read more than once, kept in the shared folder."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked_values(
    df: DataFrame,
    value: str,
    asked: Callable[[DataFrame], DataFrame],
    by: str | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
    total: int | None = None,
    range_of: Column | None = None,
) -> DataFrame:
    """g, n, rank, value, below, equal: the values at asked ranks of each group, exact, for any number of groups.

    ``asked`` turns the table of group sizes (g, n) into (g, ranks), an array of 0-based ranks; without ``by`` the one
    group is 0. The data is passed twice: rows are counted per group and key range, then only the ranges that hold
    an asked rank are counted value by value. Counts, ranks and results stay tables. ``range_of`` is an ascending
    range number of the value, for values whose spread is known, such as hashes; else ranges are sampled.
    Null values and null groups are not counted.
    """
    group = F.col(by) if by else F.lit(0)
    rows = df.select(group.alias("g"), F.col(value).alias("value"), *([range_of.alias(RANGE)] if range_of is not None else []))
    rows = rows.filter(F.col("g").isNotNull() & F.col("value").isNotNull())
    ranged = rows
    if range_of is None:
        ranged = with_range(rows, F.col("value"), range_ends(rows, F.col("value"), rows_per_range, total))
    sizes = work_table(ranged.groupBy("g", RANGE).agg(F.count("*").alias("rows")), "range-sizes")
    in_order = Window.partitionBy("g").orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("start", F.coalesce(F.sum("rows").over(in_order), F.lit(0)))
    wanted = asked(sizes.groupBy("g").agg(F.sum("rows").alias("n"))).select("g", "ranks")
    whole = sizes.groupBy("g").agg(F.sum("rows").alias("n"))
    slots = placed.join(wanted, "g").join(whole, "g")
    inside = F.filter("ranks", lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("rows")))
    slots = slots.withColumn("ranks", F.array_sort(F.array_distinct(inside))).filter(F.size("ranks") > 0)
    slots = work_table(slots.select("g", RANGE, "n", "start", "ranks"), "range-slots")
    counted = ranged.join(slots, ["g", RANGE]).groupBy("g", RANGE, "n", "start", "ranks", "value").agg(F.count("*").alias("equal"))
    earlier = Window.partitionBy("g", RANGE).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("below", F.col("start") + F.coalesce(F.sum("equal").over(earlier), F.lit(0)))
    hit = F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("equal")))
    return counted.select("g", "n", F.explode(hit).alias("rank"), "value", "below", "equal")


def exact_quantiles(
    df: DataFrame,
    value: str,
    shares: Sequence[float],
    by: str | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
    total: int | None = None,
) -> DataFrame:
    """g, quantiles (array in the order of shares): exact quantiles of each group, with linear interpolation."""

    def around(sizes: DataFrame) -> DataFrame:
        places = [F.floor((F.col("n") - 1) * F.lit(share)) for share in shares]
        above = [F.least(place + 1, F.col("n") - 1) for place in places]
        return sizes.select("g", F.array(*places, *above).alias("ranks"))

    found = ranked_values(df, value, around, by, rows_per_range, total)
    per_group = found.groupBy("g", "n").agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))

    def interpolated(share: float) -> Column:
        place = (F.col("n") - 1) * F.lit(share)
        low = F.col("at")[F.floor(place)].cast("double")
        high = F.col("at")[F.least(F.floor(place) + 1, F.col("n") - 1)].cast("double")
        return low + (high - low) * (place - F.floor(place))

    return per_group.select("g", F.array(*[interpolated(share) for share in shares]).alias("quantiles"))

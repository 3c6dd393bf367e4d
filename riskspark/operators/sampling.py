"""Hash-ordered samples, stratified splits and the banded alert sample.

Random choice means order by a seeded hash of the row, so a sample is the same on every run and on
every recomputation of a lost partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.functions import risk
from riskspark.operators import ranks

HASH = "_hash"
HASH_BITS, BUCKET_BITS = 60, 16
TINY_AMOUNT = 1.0


def row_hash(df: DataFrame, seed: int, key: Sequence[str] | None = None) -> Column:
    """Seeded hash of the key columns, by default of the whole row: 60 bits of an MD5 over their texts.

    Any engine that has MD5 draws the same rows.
    """
    texts = [F.coalesce(F.col(name).cast("string"), F.lit("")) for name in (key or df.columns)]
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *texts))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def take_lowest(df: DataFrame, takes: DataFrame, stratum: str, hash_column: str) -> DataFrame:
    """Add ``_taken``: true for exactly as many rows of each stratum as ``takes`` (stratum, take) says, lowest hash first.

    The cut is found by rank selection over equal buckets of the hash, so no stratum is ever sorted in one task. When
    the cut falls inside a group of exact copies the copies are counted, and as many of them as needed are taken.
    """
    wanted = takes.filter("take > 0").select(F.col(stratum).alias("g"), F.array(F.col("take").cast("long") - 1).alias("ranks"))
    bucket = F.shiftright(F.col(hash_column), HASH_BITS - BUCKET_BITS).cast("int")
    cuts = ranks.ranked_values(df, hash_column, lambda sizes: sizes.join(wanted, "g"), stratum, range_of=bucket)
    # Per stratum: rows up to this hash are taken; a cut inside copies takes the rows before them.
    need = F.col("rank") + 1 - F.col("below")
    torn = need < F.col("equal")
    cuts = ranks.work_table(
        cuts.select(
            F.col("g").alias(stratum),
            F.when(torn, F.col("value") - 1).otherwise(F.col("value")).alias("_through"),
            F.when(torn, F.col("value")).alias("_torn"),
            need.alias("_need"),
        ),
        "cuts",
    )
    marked = df.join(cuts, stratum, "left").withColumn("_taken", F.coalesce(F.col(hash_column) <= F.col("_through"), F.lit(False)))
    if cuts.filter("_torn IS NOT NULL").isEmpty():
        return marked.select(*df.columns, "_taken")
    on_cut = F.coalesce(F.col(hash_column) == F.col("_torn"), F.lit(False))
    # Rows with one hash are copies of one another, so few distinct rows are left to order here.
    copies = marked.filter(on_cut).groupBy(*df.columns, "_need").agg(F.count("*").alias("_copies"))
    through = F.sum("_copies").over(
        Window.partitionBy(stratum)
        .orderBy(F.xxhash64(*df.columns))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    spread = ranks.expand_copies(copies.withColumn("_through", through), "_copies", "_copy")
    place = F.col("_through") - F.col("_copies") + F.col("_copy")
    chosen = spread.withColumn("_taken", place <= F.col("_need")).select(*df.columns, "_taken")
    return marked.filter(~on_cut).select(*df.columns, "_taken").unionByName(chosen)


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """At most n rows without replacement: those with the lowest hashes."""
    if n <= 0:
        return df.limit(0)
    hashed = df.withColumn(HASH, row_hash(df, seed, key)).withColumn("_stratum", F.lit(0))
    takes = hashed.groupBy("_stratum").agg(F.least(F.count("*"), F.lit(n)).alias("take"))
    return take_lowest(hashed, takes, "_stratum", HASH).filter("_taken").select(*df.columns)


def share_out(sizes: DataFrame, stratum: str, share: float) -> DataFrame:
    """(stratum, take): that share of all rows (n), split over strata in proportion to size: whole parts, then
    largest remainders. The input has one row per stratum."""
    everything = Window.partitionBy(F.lit(0))
    total = F.ceil(F.round(F.sum("n").over(everything) * F.lit(share), 9))
    parts = sizes.withColumn("_exact", F.col("n") * total / F.sum("n").over(everything)).withColumn("_part", F.floor("_exact"))
    left = total - F.sum("_part").over(everything)
    turn = F.row_number().over(everything.orderBy((F.col("_part") - F.col("_exact")), F.col(stratum).cast("string")))
    return parts.select(stratum, (F.col("_part") + F.when(turn <= left, 1).otherwise(0)).alias("take"))


def stratified_split(
    df: DataFrame,
    label: str = S.TARGET,
    test_share: float = 0.2,
    seed: int = 42,
    key: Sequence[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows with every class in the same proportion, sizes exact.

    ``key`` names columns that identify a row; without it the whole row is hashed.
    """
    hashed = df.withColumn(HASH, row_hash(df, seed, key))
    takes = share_out(df.groupBy(label).agg(F.count("*").alias("n")), label, test_share)
    marked = take_lowest(hashed, takes, label, HASH)
    return (
        marked.filter(~F.col("_taken")).select(*df.columns),
        marked.filter("_taken").select(*df.columns),
    )


def lowest_per_group(df: DataFrame, group: Sequence[str], order: str, n: int, salts: int = 64) -> DataFrame:
    """The n lowest rows per group. Groups are cut into salted parts first, so that a group that
    holds most rows is reduced by many tasks before its parts meet."""
    part = df.withColumn("_salt", F.pmod(F.xxhash64(F.lit("salt"), F.col(order)), F.lit(salts)))
    first = Window.partitionBy(*group, "_salt").orderBy(order)
    second = Window.partitionBy(*group).orderBy(order)
    part = part.withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= n)
    return (
        part.withColumn("_place", F.row_number().over(second))
        .filter(F.col("_place") <= n)
        .drop("_salt", "_place")
    )


def amount_pools(candidates: DataFrame, group: str = "band", amount: str = "_amount") -> DataFrame:
    """Add ``pool``: low, medium or high amount (0, 1, 2) within the group.

    Amounts above 1.0 form the pools when a group has at least three of them, else all amounts do;
    a group with under three rows or a single amount has one pool. Rows outside the pools are null.
    The groups' facts and cuts are a table that is joined, for any number of groups.
    """
    large = F.col(amount) > TINY_AMOUNT
    facts = candidates.groupBy(group).agg(
        F.count("*").alias("_n"),
        F.count_if(large).alias("_n_large"),
        F.min(amount).alias("_low"),
        F.max(amount).alias("_high"),
        F.min(F.when(large, F.col(amount))).alias("_low_large"),
    )
    only_large = F.col("_n_large") >= 3
    rows = F.when(only_large, F.col("_n_large")).otherwise(F.col("_n"))
    lowest = F.when(only_large, F.col("_low_large")).otherwise(F.col("_low"))
    facts = ranks.work_table(
        facts.select(
            F.col(group).alias("_group"),
            F.when(only_large, TINY_AMOUNT).otherwise(float("-inf")).alias("_above"),
            ((rows < 3) | (lowest == F.col("_high"))).alias("_lone"),
        ),
        "pool-facts",
    )
    matched = F.col(group).eqNullSafe(F.col("_group"))
    placed = candidates.join(facts, matched, "left").withColumn("_in", F.col(amount) > F.col("_above"))
    several = placed.filter("_in AND NOT _lone").select(group, amount)
    cuts = ranks.exact_quantiles(several, amount, [0.33, 0.66], group).withColumnsRenamed({"g": "_cut_group", "quantiles": "_cuts"})
    placed = placed.join(cuts, F.col(group) == F.col("_cut_group"), "left")
    third = F.when(F.col(amount) <= F.col("_cuts")[0], 0).when(F.col(amount) <= F.col("_cuts")[1], 1).otherwise(2)
    pool = F.when(F.col("_lone"), 0).otherwise(third)
    return placed.withColumn("pool", F.when(F.col("_in"), pool)).select(*candidates.columns, "pool")


def band_quotas(max_alerts: int) -> list[int]:
    """Places for REVIEW, FLAGGED and BLOCKED: 35, 30 and the remaining share, one at least each."""
    review = round(max_alerts * 0.35)
    flagged = round(max_alerts * 0.30)
    blocked = max_alerts - round(max_alerts * 0.65)
    return [max(1, places) for places in (review, flagged, blocked)]


def banded_sample(
    df: DataFrame,
    max_alerts: int,
    save_threshold: float = S.SAVE_THRESHOLD,
    model_threshold: float = S.MODEL_THRESHOLD,
    seed: int = 42,
    key: Sequence[str] | None = None,
    probability: str = "fraud_probability",
    amount: str | None = "Amount",
) -> DataFrame:
    """A varied choice of alerts over the decision bands and, with amounts, over amount pools.

    Every stratum (band, pool, large or tiny) is cut to its ``max_alerts`` lowest hashes on the
    executors. The quota rules then run over those survivors, at most 24 strata of them, as window expressions.
    ``position`` numbers the result: large amounts first, then by probability and amount.
    """
    if max_alerts <= 0:
        return df.withColumn("position", F.lit(0)).limit(0)
    save_at = min(max(save_threshold, 0.0), 1.0)
    block_at = max(min(max(model_threshold, 0.0), 1.0), S.FLAG_THRESHOLD)
    rows = df.withColumns(
        {
            HASH: row_hash(df, seed, key),
            "_p": risk.clip_probability(F.col(probability)),
            "_amount": risk.finite(F.col(amount)) if amount else F.lit(0.0),
        }
    )
    p = F.col("_p")
    band = F.when(p >= block_at, 3).when(p >= S.FLAG_THRESHOLD, 2).otherwise(1)
    rows = rows.filter(p >= min(save_at, S.FLAG_THRESHOLD))
    # Candidates are read by several passes: they are written once.
    rows = ranks.work_table(rows.withColumns({"_saved": p >= save_at, "band": band}), "candidates")
    rows = amount_pools(rows) if amount else rows.withColumn("pool", F.lit(None).cast("int"))
    rows = rows.withColumn("_large", F.col("_amount") > TINY_AMOUNT)
    survivors = lowest_per_group(rows, ["band", "pool", "_large"], HASH, max_alerts)
    survivors = survivors.withColumn("_large", F.col("_large") & F.lit(amount is not None))
    order = ["_large", "_p", "_amount"] if amount else ["_p"]
    ranked = Window.partitionBy("_all").orderBy(*[F.desc(c) for c in order], *_TURN)
    chosen = fill_quotas(survivors.withColumn("_all", F.lit(0)), band_quotas(max_alerts), max_alerts)
    numbered = chosen.withColumn("position", F.row_number().over(ranked))
    return numbered.select(*df.columns, "position").orderBy("position")


_TURN = [HASH, "_p", "_amount"]


def fill_quotas(survivors: DataFrame, quotas: Sequence[int], total: int) -> DataFrame:
    """The rows that the quota rules choose, from a bounded table (band, pool, _large, _saved, constant _all, in turn by _TURN).

    Band by band: a third of the band's places for each amount pool, as far as the pool reaches; then places that are left
    go to the band's other rows, only to large ones if there are any. Last, what the bands leave of the total goes to saved
    rows, large ones first. All is counting and ranking over the survivors, a few rows for each place asked for.
    """
    everyone = Window.partitionBy("_all")

    def met(condition: Column) -> Column:
        return F.sum(condition.cast("int")).over(everyone)

    def turn(eligible: str) -> Column:
        return F.row_number().over(Window.partitionBy("_all", eligible).orderBy(*_TURN))

    no = F.lit(False)
    rows = survivors.withColumn("_in_pool", F.row_number().over(Window.partitionBy("_all", "band", "pool").orderBy(*_TURN)))
    rows = rows.withColumn("_taken", no)
    for band, quota in enumerate(quotas, start=1):
        own = F.col("band") == band
        left = F.least(F.lit(quota), F.lit(total) - met(F.col("_taken")))
        rows = rows.withColumn("_left", left).withColumn("_share", F.greatest(F.lit(1), F.floor(F.col("_left") / 3)))
        for pool in range(3):
            inside = own & F.coalesce(F.col("pool") == pool, no)
            rows = rows.withColumn("_places", F.greatest(F.least("_share", "_left", met(inside)), F.lit(0)))
            rows = rows.withColumn("_taken", F.col("_taken") | (inside & (F.col("_in_pool") <= F.col("_places"))))
            rows = rows.withColumn("_left", F.col("_left") - F.col("_places"))
        open_rows = own & ~F.col("_taken")
        rows = rows.withColumn("_eligible", open_rows & (F.col("_large") | (met(open_rows & F.col("_large")) == 0)))
        rows = rows.withColumn("_taken", F.col("_taken") | (F.col("_eligible") & (turn("_eligible") <= F.col("_left"))))
    rows = rows.withColumn("_eligible", F.col("_saved") & ~F.col("_taken")).withColumn("_left", F.lit(total) - met(F.col("_taken")))
    later = ~F.col("_large") & (met(F.col("_saved") & F.col("_large")) > 0)
    rows = rows.withColumn("_later", later)
    last = F.row_number().over(Window.partitionBy("_all", "_eligible").orderBy("_later", *_TURN))
    return rows.withColumn("_taken", F.col("_taken") | (F.col("_eligible") & (last <= F.col("_left")))).filter("_taken")

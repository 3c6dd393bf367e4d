"""Aggregate reports over normalised alerts."""

from __future__ import annotations

from collections import Counter
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.functions import risk, times
from riskspark.operators import ranks

NO_MERCHANT = "UNKNOWN"


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _is(*decisions: str) -> Column:
    return F.upper("decision").isin(*decisions)


def _report_rows(df: DataFrame) -> DataFrame:
    """Report inputs with broken numbers repaired; idempotent on normalised alerts."""
    return df.withColumns(
        {
            "fraud_probability": risk.clip_probability(F.col("fraud_probability")),
            "risk_score": risk.clip_risk_score(F.col("risk_score")),
            "Amount": risk.normalize_amount(F.col("Amount")),
        }
    )


def hourly_counts(df: DataFrame) -> DataFrame:
    """Figures per hour that has alerts. 24 keys at most, so it also serves as a streaming aggregate."""
    hour = F.least(F.greatest(F.coalesce("hour_of_day", F.lit(0)), F.lit(0)), F.lit(23))
    return (
        _report_rows(df)
        .groupBy(hour.cast("int").alias("hour_of_day"))
        .agg(
            F.count("*").alias("fraud_alerts"),
            F.avg("fraud_probability").alias("avg_probability"),
            F.max("fraud_probability").alias("max_probability"),
            F.avg("risk_score").alias("avg_risk_score"),
            F.max("risk_score").alias("max_risk_score"),
            F.sum("Amount").alias("total_amount"),
            F.count_if(_is(S.BLOCKED)).alias("blocked_count"),
            F.count_if(_is(S.REVIEW, S.FLAGGED)).alias("flagged_count"),
        )
    )


def day_hour_figures(df: DataFrame) -> DataFrame:
    """Figures per UTC day of storing (null: not known) and hour, all of a kind that can be added up or compared over days.

    24 keys a day, so it also serves as a streaming state.
    """
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_seconds(times.time_column(df, "stored_at_utc")) / 86400).cast("int"))
    hour = F.least(F.greatest(F.coalesce("hour_of_day", F.lit(0)), F.lit(0)), F.lit(23))
    return (
        _report_rows(df)
        .groupBy(day.alias("day"), hour.cast("int").alias("hour_of_day"))
        .agg(
            F.count("*").alias("fraud_alerts"),
            F.sum("fraud_probability").alias("total_probability"),
            F.max("fraud_probability").alias("max_probability"),
            F.sum("risk_score").alias("total_risk_score"),
            F.max("risk_score").alias("max_risk_score"),
            F.sum("Amount").alias("total_amount"),
            F.count_if(_is(S.BLOCKED)).alias("blocked_count"),
            F.count_if(_is(S.REVIEW, S.FLAGGED)).alias("flagged_count"),
        )
    )


def hourly_profile_of_days(figures: DataFrame) -> DataFrame:
    """The hourly profile (see hourly_profile) of the alerts behind such figures, of all days that are given."""
    added = [F.sum(c).alias(c) for c in ("fraud_alerts", "total_amount", "blocked_count", "flagged_count")]
    means = [(F.sum(f"total_{c}") / F.sum("fraud_alerts")).alias(f"avg_{c}") for c in ("probability", "risk_score")]
    highest = [F.max(c).alias(c) for c in ("max_probability", "max_risk_score")]
    return fill_hours(figures.groupBy("hour_of_day").agg(*added, *means, *highest))


def hourly_profile(df: DataFrame) -> DataFrame:
    """Alerts per hour of day, all 24 hours present. Flagged counts REVIEW and FLAGGED together.

    The aggregate shrinks the alerts to 24 rows before anything is joined; the total is a window
    over those rows. No rows at all give an empty report.
    """
    return fill_hours(hourly_counts(df))


def fill_hours(grouped: DataFrame) -> DataFrame:
    """Complete an hourly aggregate to 24 zero-filled rows and add each hour's share."""
    spine = grouped.sparkSession.range(24).select(F.col("id").cast("int").alias("hour_of_day"))
    filled = spine.join(F.broadcast(grouped), "hour_of_day", "left").na.fill(0)
    total = F.sum("fraud_alerts").over(Window.partitionBy(F.lit(0)))
    return (
        filled.withColumn("total", total)
        .filter("total > 0")
        .withColumn("fraud_rate", F.col("fraud_alerts") / F.col("total"))
        .select(
            "hour_of_day",
            "fraud_alerts",
            "fraud_rate",
            "avg_probability",
            "max_probability",
            "avg_risk_score",
            "max_risk_score",
            "total_amount",
            "blocked_count",
            "flagged_count",
        )
        .orderBy("hour_of_day")
    )


def active_hours(hourly: DataFrame) -> DataFrame:
    return hourly.agg(F.count_if(F.col("fraud_alerts") > 0).alias("active_hours"))


def amount_since_midnight(df: DataFrame, now: datetime | Column | None = None) -> DataFrame:
    """Alerted amount stored since midnight UTC of ``now``."""
    moment = F.current_timestamp() if now is None else now if isinstance(now, Column) else F.lit(now)
    midnight = F.timestamp_seconds(F.floor(F.unix_seconds(moment) / 86400) * 86400)
    if "stored_date" in df.columns:
        df = df.filter(F.col("stored_date") >= F.to_date(midnight))
    today = df.filter(times.time_column(df, "stored_at_utc") >= midnight)
    return today.agg(_zero(F.sum("Amount")).alias("total_amount"))


def merchant_summary(df: DataFrame) -> DataFrame:
    """Alerts, decisions, probability, risk and amount per merchant, null merchant a group of its own.

    Two steps keep a merchant that holds most alerts from landing in one task: alerts are first counted per merchant and
    hundredth of the risk score, map-side, and only these counts, 10,001 a merchant at most, meet per merchant. The least
    and the greatest score of each hundredth give two medians; where they agree that is the median, as always for scores
    of two decimals. The rows of the other merchants are ranked (exact_quantiles). Runs at once and returns a small table.
    """
    rows = _report_rows(df).withColumn("_time", times.event_time(df))
    counted = rows.groupBy("merchant_name", F.floor(F.col("risk_score") * 100).alias("_range")).agg(
        F.count("*").alias("n"),
        F.count_if(_is(S.REVIEW)).alias("review"),
        F.count_if(_is(S.FLAGGED)).alias("flagged"),
        F.count_if(_is(S.BLOCKED)).alias("blocked"),
        F.sum("fraud_probability").alias("probability"),
        F.max("fraud_probability").alias("max_probability"),
        F.sum("risk_score").alias("risk"),
        F.min("risk_score").alias("low"),
        F.max("risk_score").alias("high"),
        F.sum("Amount").alias("amount"),
        F.max("_time").alias("last_time"),
    )
    summary = counted.groupBy("merchant_name").agg(
        F.sum("n").alias("alert_count"),
        F.sum("review").alias("review_count"),
        F.sum("flagged").alias("flagged_count"),
        F.sum("blocked").alias("blocked_count"),
        (F.sum("probability") / F.sum("n")).alias("avg_probability"),
        F.max("max_probability").alias("max_probability"),
        (F.sum("risk") / F.sum("n")).alias("avg_risk_score"),
        F.percentile("low", 0.5, F.col("n")).alias("median_risk_score"),
        F.percentile("high", 0.5, F.col("n")).alias("_high_median"),
        F.max("high").alias("max_risk_score"),
        F.sum("amount").alias("total_amount"),
        F.max("last_time").alias("last_alert_time"),
    )
    summary = ranks.work_table(summary.withColumn("block_rate", F.col("blocked_count") / F.col("alert_count")), "merchants")
    between = F.col("median_risk_score") < F.col("_high_median")
    if summary.filter(between).isEmpty():
        return summary.drop("_high_median")
    group = F.coalesce(F.concat(F.lit("="), "merchant_name"), F.lit("")).alias("g")
    open_groups = summary.filter(between).select(group)
    scores = rows.select(group, "risk_score").join(open_groups, "g", "left_semi")
    medians = ranks.exact_quantiles(scores, "risk_score", [0.5], "g").select("g", F.col("quantiles")[0].alias("_median"))
    joined = summary.withColumn("g", group).join(medians, "g", "left")
    median = F.coalesce("_median", "median_risk_score")
    return joined.withColumn("median_risk_score", median).drop("_median", "_high_median", "g")


def rank_merchants(summary: DataFrame, limit: int | None = None) -> DataFrame:
    """Riskiest merchants first; the name settles ties."""
    ordered = summary.orderBy(
        F.desc("blocked_count"),
        F.desc("block_rate"),
        F.desc("avg_risk_score"),
        F.desc("total_amount"),
        F.asc_nulls_last("merchant_name"),
    )
    return ordered if limit is None else ordered.limit(limit)


def high_risk_merchants(df: DataFrame, limit: int = 10) -> DataFrame:
    named = df.withColumn("merchant_name", F.coalesce("merchant_name", F.lit(NO_MERCHANT)))
    return rank_merchants(merchant_summary(named), limit)


def kpi_summary(df: DataFrame) -> DataFrame:
    """Alert totals; every figure is zero without alerts."""
    return df.agg(
        F.count("*").alias("alert_count"),
        F.count_if(_is(S.REVIEW)).alias("review_count"),
        F.count_if(_is(S.FLAGGED)).alias("flagged_count"),
        F.count_if(_is(S.BLOCKED)).alias("blocked_count"),
        _zero(F.sum("Amount")).alias("alerted_amount"),
        _zero(F.sum(F.when(_is(S.BLOCKED), F.col("Amount")))).alias("blocked_amount"),
        _zero(F.avg("risk_score")).alias("average_risk"),
    )


def decision_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("decision").agg(
        F.count("transaction_id").alias("alert_count"),
        F.avg("risk_score").alias("avg_risk_score"),
        F.sum("Amount").alias("total_amount"),
    )


def decision_split(df: DataFrame) -> DataFrame:
    """The three alert bands and their counts, as rows."""
    kpis = kpi_summary(df)
    pairs = [(S.REVIEW, "review_count"), (S.FLAGGED, "flagged_count"), (S.BLOCKED, "blocked_count")]
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("decision"), F.greatest(F.col(c), F.lit(0)).alias("alert_count"))
            for name, c in pairs
        ]
    )
    return kpis.select(F.inline(rows))


def night_flags(df: DataFrame) -> DataFrame:
    """Night flag per alert: by event time when any alert has one, else by hour of day."""
    event = times.event_time(df, include_stored_at=False)
    timed = F.coalesce(F.bool_or(event.isNotNull()), F.lit(False))
    any_event = df.agg(timed.alias("any_event")).select("any_event").scalar()
    by_event = times.night_by_hour(times.utc_hour(event))
    by_hour = times.night_by_hour(risk.column_or_null(df, "hour_of_day", "int"))
    return df.withColumn("is_night", F.when(any_event, by_event).otherwise(by_hour))


def insight_ratios(df: DataFrame) -> DataFrame:
    """Blocked share, night count and share, highest risk, in one pass."""
    event = times.event_time(df, include_stored_at=False)
    by_event = F.count_if(times.night_by_hour(times.utc_hour(event)))
    by_hour = F.count_if(times.night_by_hour(risk.column_or_null(df, "hour_of_day", "int")))
    night = F.when(F.bool_or(event.isNotNull()), by_event).otherwise(by_hour)
    total = F.greatest(F.count("*"), F.lit(1))
    return df.agg(
        (F.count_if(_is(S.BLOCKED)) / total * 100).alias("blocked_pct"),
        night.alias("night_count"),
        (night / total * 100).alias("night_pct"),
        _zero(F.max("risk_score")).alias("max_risk"),
    )


def risk_histogram(df: DataFrame, bins: int = 25) -> DataFrame:
    """Alerts per decision and risk bin over 0-100."""
    width = 100.0 / bins
    index = F.least(F.floor(F.col("risk_score") / width), F.lit(bins - 1)).cast("int")
    counted = df.groupBy("decision", index.alias("bin")).agg(F.count("*").alias("alert_count"))
    return counted.select("decision", "bin", (F.col("bin") * width).alias("bin_start"), "alert_count")


def amount_histogram(df: DataFrame, bins: int = 35, log_scale: bool = False) -> DataFrame:
    """Alerts per decision and amount bin between the smallest and the largest amount."""
    amount = F.greatest(F.col("Amount"), F.lit(0.01))
    rows = df.select("decision", (F.log10(amount) if log_scale else amount).alias("x"))
    bounds = rows.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    low, high = bounds.select("low").scalar(), bounds.select("high").scalar()
    rows = rows.withColumns({"low": low, "high": high})
    width = (F.col("high") - F.col("low")) / bins
    index = F.when(width > 0, F.least(F.floor((F.col("x") - F.col("low")) / width), F.lit(bins - 1)))
    counted = rows.groupBy(
        "decision",
        F.coalesce(index, F.lit(0)).cast("int").alias("bin"),
        (F.col("low") + F.coalesce(index, F.lit(0)) * width).alias("bin_start"),
    ).agg(F.count("*").alias("alert_count"))
    return counted.select("decision", "bin", "bin_start", "alert_count")


def recent_mixed(df: DataFrame, limit: int = 24) -> DataFrame:
    return df.orderBy(times.event_time(df).desc_nulls_last(), "transaction_id").limit(limit)


def highest_risk(df: DataFrame, limit: int = 20) -> DataFrame:
    return df.orderBy(F.desc("risk_score"), F.desc("Amount"), "transaction_id").limit(limit)


def cumulative_amount(df: DataFrame, rows_per_range: int = ranks.ROWS_PER_RANGE) -> DataFrame:
    """Running alerted amount by (event time, transaction id), rows without a time dropped.

    Rows are cut into time ranges by a sample. A moment that holds many alerts gets ranges of its own, cut by ids that
    were sampled at that moment; the cuts are a small table in which a row's part is searched (ranks.with_part). Exact
    copies of one alert at such a moment are counted first and repeated last, which keeps a mass of copies out of any one
    task.
    """
    rows = df.withColumns(
        {"_event_time": times.event_time(df), "Amount": risk.finite(F.col("Amount"))}
    ).filter(F.col("_event_time").isNotNull())
    moment = F.unix_micros("_event_time").cast("double")
    ends = ranks.range_ends(rows, moment, rows_per_range)
    shares = {end: n for end, n in Counter(ends).items() if n > 1}
    # A crowded moment gets a range of its own: from the moment up to the next microsecond.
    placed = ranks.with_range(rows, moment, sorted(set(ends) | {end + 1 for end in shares}))
    order = [F.col("_event_time"), F.col("transaction_id")]
    if not shares:
        totals = placed.groupBy(ranks.RANGE).agg(F.sum("Amount").alias("Amount")) if ends else None
        return ranks.with_running_sums(placed, totals, order, {"Amount": "cum_amount"}).drop(ranks.RANGE)

    spark = df.sparkSession
    wanted = spark.createDataFrame([(end, n + 1) for end, n in shares.items()], "_moment double, _parts int")
    placed = placed.withColumn("_at", moment).join(F.broadcast(wanted), F.col("_at") == F.col("_moment"), "left")
    crowded = placed.filter("_moment IS NOT NULL AND transaction_id IS NOT NULL").select("_moment", "_parts", "transaction_id")
    # About SAMPLES_PER_RANGE ids per part are drawn; a part's cut is the id at its share of them.
    share = min(1.0, ranks.SAMPLES_PER_RANGE / rows_per_range)
    drawn = crowded.sample(share, seed=11) if share < 1.0 else crowded
    drawn = ranks.work_table(drawn, "drawn-ids")
    numbers = drawn.groupBy("_moment").agg(F.count("*").alias("_ids"))
    turn = F.row_number().over(Window.partitionBy("_moment").orderBy("transaction_id"))
    turned = drawn.withColumn("_place", turn.cast("long") - 1).join(F.broadcast(numbers), "_moment")
    # The first place at or after i * ids / parts is a cut, for every i in 1 to parts - 1.
    before = F.floor((F.col("_place") - 1) * F.col("_parts") / F.col("_ids"))
    at = F.floor(F.col("_place") * F.col("_parts") / F.col("_ids"))
    cuts = turned.filter((F.col("_place") > 0) & (at > before)).select("_moment", F.col("transaction_id").alias("cut"))
    placed = ranks.with_part(placed, cuts, "_moment", "transaction_id", max(shares.values()) + 1, "_part")
    placed = placed.withColumn("_crowded", F.col("_moment").isNotNull()).drop("_at", "_moment", "_parts")
    keys = [c for c in placed.columns if c != "_crowded"]
    copies = placed.filter("_crowded").groupBy(*keys).agg(F.count("*").alias("_copies"))
    alone = placed.filter("NOT _crowded").select(*keys, F.lit(1).cast("long").alias("_copies"))
    counted = alone.unionByName(copies).withColumn("_weight", F.col("Amount") * F.col("_copies"))
    totals = placed.groupBy(ranks.RANGE, "_part").agg(F.sum("Amount").alias("_weight"))
    summed = ranks.with_running_sums(
        counted, totals, order, {"_weight": "_through"}, by=(ranks.RANGE, "_part")
    )
    repeated = ranks.expand_copies(summed, "_copies", "_copy")
    after = (F.col("_copies") - F.col("_copy")) * F.col("Amount")
    return repeated.withColumn("cum_amount", F.col("_through") - after).drop(
        ranks.RANGE, "_part", "_copies", "_weight", "_through", "_copy"
    )


def blocked_points(timeline: DataFrame) -> DataFrame:
    return timeline.filter(_is(S.BLOCKED))


def batch_score_summary(scored: DataFrame) -> DataFrame:
    """Figures over scored transactions; no input is an error."""
    flagged = F.count_if(_is(S.REVIEW, S.FLAGGED, S.BLOCKED))
    counts = [F.struct(F.lit(d), F.count_if(_is(d))) for d in S.DECISIONS]
    empty = F.raise_error(F.lit("at least one transaction is required"))
    return scored.agg(
        F.when(F.count("*") > 0, F.count("*")).otherwise(empty.cast("bigint")).alias("transaction_count"),
        F.map_from_entries(F.array(*counts)).alias("decision_counts"),
        flagged.alias("flagged_or_blocked_count"),
        F.try_divide(flagged, F.count("*")).alias("estimated_fraud_rate"),
        F.avg("fraud_probability").alias("average_fraud_probability"),
        F.max("fraud_probability").alias("max_fraud_probability"),
        F.avg("risk_score").alias("average_risk_score"),
    )


def generation_summary(scored: DataFrame, alerts: DataFrame, alert_threshold: float) -> DataFrame:
    """One record about an alert generation: rows scanned, candidates, alerts by decision."""
    seen = scored.agg(
        F.count("*").alias("scanned"),
        F.count_if(F.col("fraud_probability") >= alert_threshold).alias("candidates"),
        F.max("fraud_probability").alias("max_probability"),
    )
    made = alerts.agg(
        F.count("*").alias("inserted"),
        F.struct(
            *[F.count_if(_is(d)).alias(d.lower()) for d in (S.REVIEW, S.FLAGGED, S.BLOCKED)]
        ).alias("decision_mix"),
    )
    return seen.select(
        "scanned",
        "candidates",
        made.select("inserted").scalar().alias("inserted"),
        F.lit(float(alert_threshold)).alias("alert_threshold"),
        "max_probability",
        made.select("decision_mix").scalar().alias("decision_mix"),
    )

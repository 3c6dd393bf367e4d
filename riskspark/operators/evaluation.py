"""Model evaluation as table operators over (label, score) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.functions.risk import as_column
from riskspark.operators import ranks

# The tuning grid as (first, last, number of evenly spaced points).
GRID_SEGMENTS = [(0.01, 0.90, 90), (0.91, 0.99, 10), (0.991, 0.999, 9)]


def threshold_grid(spark: SparkSession) -> DataFrame:
    """The 109 default thresholds, ascending."""
    segments = None
    for first, last, points in GRID_SEGMENTS:
        position = F.col("id")
        step = F.lit((last - first) / (points - 1))
        value = F.when(position == points - 1, F.lit(last)).otherwise(F.lit(first) + position * step)
        segment = spark.range(points).select(value.alias("threshold"))
        segments = segment if segments is None else segments.unionByName(segment)
    return segments.distinct().orderBy("threshold")


def grid_values() -> list[float]:
    """The same thresholds as numbers."""
    values = set()
    for first, last, points in GRID_SEGMENTS:
        step = (last - first) / (points - 1)
        values |= {first + i * step for i in range(points - 1)} | {last}
    return sorted(values)


def rates(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1, zero where undefined."""

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    f1 = ratio(2 * precision * recall, precision + recall)
    return {"precision": precision, "recall": recall, "f1": f1}


def metrics_from_counts(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and predicted count from the four confusion counts."""
    tp, fp, fn = (F.col(c) for c in ("true_positives", "false_positives", "false_negatives"))
    return df.withColumns({**rates(tp, fp, fn), "predicted_fraud_count": tp + fp})


def with_usable_scores(scored: DataFrame) -> DataFrame:
    """(label, score) of all rows; a null or NaN score becomes the lowest, which no threshold predicts."""
    score = F.col("score").cast("double")
    unusable = score.isNull() | F.isnan(score)
    return scored.select("label", F.when(unusable, float("-inf")).otherwise(score).alias("score"))


def threshold_sweep(
    scored: DataFrame,
    thresholds: Sequence[float] | None = None,
    false_positive_cost: float = S.FALSE_POSITIVE_COST,
    false_negative_cost: float = S.FALSE_NEGATIVE_COST,
) -> DataFrame:
    """Confusion counts, rates and business cost at every threshold.

    Each score is placed once, by binary search, between two thresholds; the counts above a
    threshold are then sums over one row per interval. Rows are never multiplied by thresholds.
    """
    spark = scored.sparkSession
    grid = sorted(set(grid_values() if thresholds is None else map(float, thresholds)))
    placed = ranks.with_range(with_usable_scores(scored), F.col("score"), grid)
    per_interval = placed.groupBy(ranks.RANGE).agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )
    # Interval 0 lies below the first threshold, interval i starts at threshold i.
    spine = F.posexplode(F.array(F.lit(None).cast("double"), *[F.lit(t) for t in grid]))
    intervals = spark.range(1).select(spine.alias(ranks.RANGE, "threshold"))
    filled = intervals.join(F.broadcast(per_interval), ranks.RANGE, "left").na.fill(0, ["pos", "neg"])
    whole = Window.partitionBy(F.lit(0))
    above = whole.orderBy(F.desc(ranks.RANGE)).rowsBetween(Window.unboundedPreceding, 0)
    swept = filled.select(
        "threshold",
        (F.sum("neg").over(whole) - F.sum("neg").over(above)).alias("true_negatives"),
        F.sum("neg").over(above).alias("false_positives"),
        (F.sum("pos").over(whole) - F.sum("pos").over(above)).alias("false_negatives"),
        F.sum("pos").over(above).alias("true_positives"),
    ).filter(F.col("threshold").isNotNull())
    costs = {
        "false_positive_cost": F.lit(float(false_positive_cost)),
        "false_negative_cost": F.lit(float(false_negative_cost)),
    }
    return (
        metrics_from_counts(swept)
        .withColumns(costs)
        .withColumn(
            "business_cost",
            F.col("false_positives") * F.col("false_positive_cost")
            + F.col("false_negatives") * F.col("false_negative_cost"),
        )
        .select(*S.THRESHOLD_METRICS_SCHEMA.fieldNames())
    )


def best_f1(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"), "threshold").limit(1)


def best_cost(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy("business_cost", "false_negatives", "false_positives", "threshold").limit(1)


def best_by(sweep: DataFrame, metric: str = "f1", ascending: bool = False) -> DataFrame:
    """Best row for any metric column, highest first unless told otherwise."""
    if metric not in sweep.columns:
        raise ValueError(f"metric must be one of {sweep.columns}")
    order = F.asc(metric) if ascending else F.desc(metric)
    return sweep.orderBy(order, "threshold").limit(1)


def top_thresholds(sweep: DataFrame, n: int = 10) -> DataFrame:
    return sweep.orderBy(F.desc("f1"), "threshold").limit(n)


def confusion_at(scored: DataFrame, threshold: float | Column) -> DataFrame:
    """Confusion counts and rates at one threshold, from one pass. A null or NaN score is no hit."""
    scored = with_usable_scores(scored)
    hit = F.col("score") >= as_column(threshold)
    positive, negative = F.col("label") == 1, F.col("label") == 0
    counts = scored.agg(
        F.count_if(negative & ~hit).alias("true_negatives"),
        F.count_if(negative & hit).alias("false_positives"),
        F.count_if(positive & ~hit).alias("false_negatives"),
        F.count_if(positive & hit).alias("true_positives"),
        F.count_if(positive).alias("fraud_cases"),
        F.count("*").alias("validation_rows"),
    )
    return metrics_from_counts(counts).withColumn("threshold", as_column(threshold))


def score_counts(scored: DataFrame, rows_per_range: int = ranks.ROWS_PER_RANGE) -> DataFrame:
    """Distinct scores, highest first, with the positives and negatives at and above each.

    Rows are counted per score before any ordering, so heavy ties cost nothing, and the running
    counts go range by range (see ``ranks``). Null and NaN scores count as the lowest score.
    """
    scored = with_usable_scores(scored)
    key = -F.col("score")
    ends = ranks.range_ends(scored, key, rows_per_range)
    placed = ranks.with_range(scored, key, ends)
    counts = [
        F.count_if(F.col("label") == 1).alias("pos"),
        F.count_if(F.col("label") == 0).alias("neg"),
    ]
    per_score = placed.groupBy(ranks.RANGE, "score").agg(*counts)
    totals = placed.groupBy(ranks.RANGE).agg(*counts) if ends else None
    sums = {"pos": "tp", "neg": "fp"}
    return ranks.with_running_sums(per_score, totals, [F.desc("score")], sums).drop(ranks.RANGE)


def ranking_quality(counted: DataFrame) -> DataFrame:
    """ROC AUC and average precision from the table of ``score_counts``.

    AUC credits a tie with half a win and is 0 when one class is missing. Average precision is the
    step sum over distinct scores, not the trapezoid.
    """
    positives, negatives = F.sum("pos"), F.sum("neg")
    wins = F.sum(F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2))
    steps = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    pairs = positives.cast("double") * negatives
    return counted.agg(
        F.coalesce(F.try_divide(wins, pairs), F.lit(0.0)).alias("auc"),
        F.coalesce(F.try_divide(steps, positives), F.lit(0.0)).alias("auprc"),
    )


def roc_auc(scored: DataFrame) -> DataFrame:
    return ranking_quality(score_counts(scored)).select("auc")


def average_precision(scored: DataFrame) -> DataFrame:
    return ranking_quality(score_counts(scored)).select("auprc")


def _with_class_totals(scored: DataFrame, counted: DataFrame) -> DataFrame:
    totals = scored.agg(
        F.count_if(F.col("label") == 1).alias("positives"),
        F.count_if(F.col("label") == 0).alias("negatives"),
    )
    return counted.withColumns(
        {name: totals.select(name).scalar() for name in ("positives", "negatives")}
    )


def roc_curve(scored: DataFrame) -> DataFrame:
    """False and true positive rate at every distinct score."""
    rows = _with_class_totals(scored, score_counts(scored))
    return rows.select(
        F.col("score").alias("threshold"),
        F.coalesce(F.try_divide("fp", "negatives"), F.lit(0.0)).alias("false_positive_rate"),
        F.coalesce(F.try_divide("tp", "positives"), F.lit(0.0)).alias("true_positive_rate"),
    )


def precision_recall_curve(scored: DataFrame) -> DataFrame:
    rows = _with_class_totals(scored, score_counts(scored))
    return rows.select(
        F.col("score").alias("threshold"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        F.coalesce(F.try_divide("tp", "positives"), F.lit(0.0)).alias("recall"),
    )


def model_metrics(scored: DataFrame, threshold: float | Column, model: str) -> DataFrame:
    """The metrics record of one model at one threshold."""
    quality = ranking_quality(score_counts(scored))
    return (
        confusion_at(scored, threshold)
        .withColumns(
            {
                "model": F.lit(model),
                "auc": quality.select("auc").scalar(),
                "auprc": quality.select("auprc").scalar(),
                "metric_source": F.lit("active_threshold_recomputed"),
            }
        )
        .select(*S.MODEL_METRICS_SCHEMA.fieldNames())
    )


def classification_report(scored: DataFrame, threshold: float | Column) -> DataFrame:
    """Per class, macro and weighted precision, recall, F1 and support, and the accuracy."""
    counts = confusion_at(scored, threshold)
    tn, fp, fn, tp = (F.col(c) for c in S.CONFUSION_COUNTS)

    def class_row(name: str, hit: Column, wrong: Column, missed: Column) -> Column:
        values = [c.alias(k) for k, c in rates(hit, wrong, missed).items()]
        return F.struct(F.lit(name).alias("label"), *values, (hit + missed).alias("support"))

    both = counts.select(
        class_row("0", tn, fn, fp).alias("zero"), class_row("1", tp, fp, fn).alias("one"), *counts.columns
    )
    total = tn + fp + fn + tp

    def average_row(name: str, weight0: Column, weight1: Column) -> Column:
        values = [
            F.coalesce(
                F.try_divide(F.col(f"zero.{m}") * weight0 + F.col(f"one.{m}") * weight1, weight0 + weight1),
                F.lit(0.0),
            ).alias(m)
            for m in ("precision", "recall", "f1")
        ]
        return F.struct(F.lit(name).alias("label"), *values, total.alias("support"))

    accuracy = F.coalesce(F.try_divide(tn + tp, total), F.lit(0.0))
    accuracy_row = F.struct(
        F.lit("accuracy").alias("label"),
        F.lit(None).cast("double").alias("precision"),
        F.lit(None).cast("double").alias("recall"),
        accuracy.alias("f1"),
        total.alias("support"),
    )
    one = F.lit(1.0)
    rows = F.array(
        F.col("zero"),
        F.col("one"),
        accuracy_row,
        average_row("macro avg", one, one),
        average_row("weighted avg", F.col("zero.support"), F.col("one.support")),
    )
    return both.select(F.inline(rows))


def model_comparison(*metrics: DataFrame) -> DataFrame:
    """Model records under each other; absent fields are null."""
    table = metrics[0]
    for other in metrics[1:]:
        table = table.unionByName(other, allowMissingColumns=True)
    return table


def champion(comparison: DataFrame, preference: Sequence[str]) -> DataFrame:
    """Model with the highest average precision; on a tie the first of ``preference``."""
    place = F.array_position(F.array(*[F.lit(name) for name in preference]), F.col("model"))
    return comparison.orderBy(F.desc("auprc"), place).limit(1)


_RECOMPUTED = [
    "precision",
    "recall",
    "f1",
    *S.CONFUSION_COUNTS,
    "predicted_fraud_count",
    "fraud_cases",
    "validation_rows",
]


def active_metrics(stored: DataFrame, active: DataFrame, threshold: float) -> DataFrame:
    """Stored model records with the recomputed fields of the active threshold in front.

    Both tables have one row per model; a model without recomputed metrics keeps its stored ones.
    """
    fields = [name for name in _RECOMPUTED if name in active.columns]
    fresh = active.select("model", F.lit(True).alias("_fresh"), *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = stored.join(F.broadcast(fresh), "model", "left")
    merged = {
        name: F.coalesce(f"_new_{name}", name) if name in stored.columns else F.col(f"_new_{name}")
        for name in fields
    }
    source = F.when(F.col("_fresh"), "active_threshold_recomputed").otherwise("stored_training_artifact")
    return (
        joined.withColumns(merged)
        .withColumns({"threshold": F.lit(float(threshold)), "metric_source": source})
        .drop("_fresh", *[f"_new_{name}" for name in fields])
    )


def metrics_near_threshold(summary: DataFrame, threshold: float) -> DataFrame:
    """The tuning summary's row for this threshold, the F1 choice before the cost choice.

    ``summary`` has one row per ``choice`` (``best_f1_threshold``, ``best_business_cost_threshold``).
    """
    first = F.when(F.col("choice") == "best_f1_threshold", 0).otherwise(1)
    return (
        summary.filter(F.abs(F.col("threshold") - threshold) <= 1e-9)
        .withColumn("metric_source", F.concat("choice", F.lit("_summary")))
        .orderBy(first)
        .limit(1)
        .drop("choice")
    )


def tuning_summary(sweep: DataFrame) -> DataFrame:
    """The two chosen threshold rows, labelled."""
    f1 = best_f1(sweep).withColumn("choice", F.lit("best_f1_threshold"))
    cost = best_cost(sweep).withColumn("choice", F.lit("best_business_cost_threshold"))
    return f1.unionByName(cost)


def confusion_matrix(metrics: DataFrame) -> DataFrame:
    """Adds ``matrix`` as [[TN, FP], [FN, TP]]; missing counts are zero."""
    tn, fp, fn, tp = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in S.CONFUSION_COUNTS)
    return metrics.withColumn("matrix", F.array(F.array(tn, fp), F.array(fn, tp)))


def has_all_counts(df: DataFrame) -> Column:
    """True when a metric row carries all four confusion counts."""
    if any(name not in df.columns for name in S.CONFUSION_COUNTS):
        return F.lit(False)
    present = F.lit(True)
    for name in S.CONFUSION_COUNTS:
        present = present & F.col(name).isNotNull()
    return present


def resolve_threshold(
    spark: SparkSession,
    tuned: DataFrame | None = None,
    record: DataFrame | None = None,
    default: float = S.MODEL_THRESHOLD,
) -> DataFrame:
    """The threshold in force: the tuned one, else the training record's, else the default."""
    sources = [df.select("threshold").limit(1).scalar() for df in (tuned, record) if df is not None]
    return spark.range(1).select(F.coalesce(*sources, F.lit(float(default))).alias("threshold"))

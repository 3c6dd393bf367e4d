import random

import pytest

from riskspark import schema as S
from riskspark.operators import evaluation as E


def brute(scored, t):
    tp = sum(1 for y, s in scored if y == 1 and s >= t)
    fp = sum(1 for y, s in scored if y == 0 and s >= t)
    fn = sum(1 for y, s in scored if y == 1 and s < t)
    return len(scored) - tp - fp - fn, fp, fn, tp


def scored_rows(seed=4, n=3000):
    rng = random.Random(seed)
    return [(int(rng.random() < 0.1), rng.choice([rng.random(), 0.5, 0.9, 0.01, 0.999])) for _ in range(n)]


def test_grid_has_its_three_parts(spark):
    parts = [(0.01, 0.90, 90), (0.91, 0.99, 10), (0.991, 0.999, 9)]
    want = [low + i * (high - low) / (n - 1) for low, high, n in parts for i in range(n)]
    grid = [r["threshold"] for r in E.threshold_grid(spark).collect()]
    assert len(grid) == 109 and grid == pytest.approx(want, abs=1e-12)
    assert E.grid_values() == grid


def test_counts_through_the_sweep(spark):
    """Scores laid between thresholds give known counts back, and the rates and best rows that follow from them."""
    grid = [0.2, 0.4, 0.6, 0.8]
    positives, negatives = [3, 5, 7, 20, 65], [900, 60, 30, 8, 2]  # below the first threshold, then from each on
    scored = [(1, g, n) for g, n in zip([0.0, *grid], positives)] + [(0, g, n) for g, n in zip([0.0, *grid], negatives)]
    df = spark.createDataFrame(scored, "label int, score double, n int").selectExpr("label", "score", "explode(sequence(1, n)) as i")
    rows = E.threshold_sweep(df, grid).orderBy("threshold").collect()
    for k, r in enumerate(rows):
        tp, fp = sum(positives[k + 1 :]), sum(negatives[k + 1 :])
        assert (r["true_positives"], r["false_positives"], r["false_negatives"], r["true_negatives"]) == (tp, fp, 100 - tp, 1000 - fp)
        assert r["precision"] == pytest.approx(tp / (tp + fp)) and r["recall"] == tp / 100
        assert r["f1"] == pytest.approx(2 * tp / (2 * tp + fp + 100 - tp)) and r["business_cost"] == fp + 20.0 * (100 - tp)
    table = spark.createDataFrame(rows, S.THRESHOLD_METRICS_SCHEMA)
    assert E.best_f1(table).first()["threshold"] == 0.6 and E.best_cost(table).first()["threshold"] == 0.2


def test_unusable_scores_are_never_predicted(spark):
    nan = float("nan")
    rows = [(1, 0.9), (1, nan), (1, None), (0, 0.2), (0, nan)]
    df = spark.createDataFrame(rows, "label int, score double")
    want = (1, 0, 2, 2)  # tp, fp, fn, tn
    names = ("true_positives", "false_positives", "false_negatives", "true_negatives")
    for r in (E.threshold_sweep(df, [0.5]).first(), E.confusion_at(df, 0.5).first()):
        assert tuple(r[n] for n in names) == want
    report = {r["label"]: r["support"] for r in E.classification_report(df, 0.5).collect()}
    assert report["0"] == 2 and report["1"] == 3
    counted = E.score_counts(df).orderBy("tp", "fp").collect()
    assert [(r["score"], r["tp"], r["fp"]) for r in counted] == [(0.9, 1, 0), (0.2, 1, 1), (float("-inf"), 3, 2)]


def test_sweep_against_brute_force(spark):
    rows = scored_rows()
    df = spark.createDataFrame(rows, "label int, score double")
    for r in E.threshold_sweep(df, [0.01, 0.5, 0.9, 0.95, 0.999, 0.9999], 2.0, 3.0).collect():
        tn, fp, fn, tp = brute(rows, r["threshold"])
        assert tuple(r[c] for c in S.CONFUSION_COUNTS) == (tn, fp, fn, tp)
        assert r["business_cost"] == 2 * fp + 3 * fn
    one = E.confusion_at(df, 0.5).first()
    assert tuple(one[c] for c in S.CONFUSION_COUNTS) == brute(rows, 0.5)


@pytest.mark.parametrize("rows_per_range", [10**6, 100])
def test_ranking_quality(spark, rows_per_range):
    rows = scored_rows(7, 800)
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    ap = 0.0
    for t in sorted({s for _, s in rows}):
        _, fp, _, tp = brute(rows, t)
        ap += sum(1 for p in pos if p == t) / len(pos) * tp / (tp + fp)
    df = spark.createDataFrame(rows, "label int, score double").repartition(6)
    found = E.ranking_quality(E.score_counts(df, rows_per_range)).first()
    assert found["auc"] == pytest.approx(auc) and found["auprc"] == pytest.approx(ap)


def test_one_class(spark):
    df = spark.createDataFrame([(0, 0.2), (0, 0.7)], "label int, score double")
    assert E.roc_auc(df).first()["auc"] == 0.0
    assert E.average_precision(df).first()["auprc"] == 0.0
    assert E.confusion_at(df, 0.9).first()["precision"] == 0.0
    assert E.classification_report(df, 0.5).count() == 5


def test_best_by(spark):
    sweep = E.threshold_sweep(spark.createDataFrame(scored_rows(), "label int, score double"))
    costs = [r["business_cost"] for r in sweep.collect()]
    assert E.best_by(sweep, "business_cost").first()["business_cost"] == max(costs)
    assert E.best_by(sweep, "business_cost", ascending=True).first()["business_cost"] == min(costs)
    with pytest.raises(ValueError, match="metric must be one of"):
        E.best_by(sweep, "speed")


def test_active_metrics(spark):
    stored = spark.createDataFrame([("boosted_trees", 0.21, 0.89, 0.34, 0.98, 0.9)], "model string, precision double, recall double, f1 double, auc double, threshold double")
    active = spark.createDataFrame([("boosted_trees", 0.7411, 0.8469, 0.7905, 56835, 29, 15, 83)], "model string, precision double, recall double, f1 double, " + ", ".join(f"{c} long" for c in S.CONFUSION_COUNTS))
    merged = E.confusion_matrix(E.active_metrics(stored, active, 0.999)).first()
    assert (merged["precision"], merged["recall"], merged["f1"], merged["threshold"]) == (0.7411, 0.8469, 0.7905, 0.999)
    assert merged["auc"] == 0.98 and merged["metric_source"] == "active_threshold_recomputed"
    assert merged["matrix"] == [[56835, 29], [15, 83]]
    assert active.select(E.has_all_counts(active)).first()[0] is True
    assert stored.select(E.has_all_counts(stored)).first()[0] is False


def test_thresholds_and_champion(spark):
    tuned = spark.createDataFrame([(0.999,)], "threshold double")
    assert E.resolve_threshold(spark, tuned, None, 0.5).first()[0] == 0.999
    assert E.resolve_threshold(spark, tuned.limit(0), tuned, 0.5).first()[0] == 0.999
    assert E.resolve_threshold(spark).first()[0] == 0.5
    table = spark.createDataFrame([("isolation_forest", 0.5), ("boosted_trees", 0.5)], "model string, auprc double")
    assert E.champion(table, ["boosted_trees", "isolation_forest"]).first()["model"] == "boosted_trees"

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.operators import evaluation as E
from riskspark.operators import features as X
from riskspark.operators import boosting, isolation, models
from riskspark.operators.oversample import oversample
from riskspark.plans import jobs, model_queries
from riskspark.sources import alerts as table
from riskspark.sources import artifacts, messages, model_store
from riskspark.streaming import alerts as streaming

BOOST = {"rounds": 8, "depth": 3, "rate": 0.3}
FIRST_ORDER = {"maxIter": 8, "maxDepth": 3, "stepSize": 0.3}


@pytest.fixture(scope="module")
def cards(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(1500):
        fraud = i % 25 == 0
        v = rng.normal(2.5 if fraud else 0.0, 1.0, 28)
        rows.append((float(i * 60), *map(float, v), float(abs(rng.normal(50, 30))), float(fraud)))
    path = str(tmp_path_factory.mktemp("cards"))
    spark.createDataFrame(rows, S.transaction_schema()).write.mode("overwrite").option("header", True).csv(path)
    return path


@pytest.fixture(scope="module")
def features(spark, cards):
    raw = spark.read.schema(S.transaction_schema()).option("header", True).csv(cards)
    return X.model_columns(X.add_features(raw)).withColumn("Class", F.col("Class").cast("int")).cache()


def test_oversample(spark, features, monkeypatch):
    monkeypatch.setattr("riskspark.operators.ranks.COPIES_PER_TASK_ROW", 5)
    enlarged, info = oversample(features, group_rows=25)
    counts = {r["Class"]: r["count"] for r in enlarged.groupBy("Class").count().collect()}
    assert counts == {0: 1440, 1: 1440}
    assert info["minority_count_before"] == 60 and info["minority_count_after"] == 1440 and info["k_neighbors"] == 5
    # Every made row lies between a minority row and one of its five nearest.
    data = np.array(features.filter("Class = 1").select(*S.FEATURES).collect(), dtype=float)
    made = np.array(enlarged.filter("Class = 1").select(*S.FEATURES).collect(), dtype=float)
    square = ((data[:, None, :] - data[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(square, np.inf)
    ends = [(i, j) for i, row in enumerate(np.argsort(square, axis=1)[:, :5]) for j in row]
    start, step = data[[i for i, _ in ends]], np.array([data[j] - data[i] for i, j in ends])
    for point in made:
        share = ((point - start) * step).sum(axis=1) / (step**2).sum(axis=1)
        off = ((start + np.clip(share, 0, 1)[:, None] * step - point) ** 2).sum(axis=1)
        assert off.min() < 1e-6


def test_oversample_needs_two_positives(features):
    one = features.filter("Class = 0").limit(50)
    same, info = oversample(one)
    assert info["enabled"] is False and same.count() == 50


def test_oversample_with_copies(spark):
    rows = [(0, float(i), 0.0) for i in range(300)] + [(1, 5.0, 5.0)] * 80
    df = spark.createDataFrame(rows, "Class int, a double, b double")
    enlarged, _ = oversample(df, ["a", "b"])
    found = enlarged.filter("Class = 1").groupBy("a", "b").count().collect()
    assert [tuple(r) for r in found] == [(5.0, 5.0, 300)]


def test_standardize(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "a double, b double")
    assert sorted(map(tuple, isolation.standardize(df, ["a", "b"]).collect())) == [(-1.0, 0.0), (1.0, 0.0)]
    flat = isolation.min_max_scaled(df, "b").collect()
    assert [r["score"] for r in flat] == [0.0, 0.0]


def test_contamination_is_clamped():
    assert [isolation.contamination(x) for x in (0.0, 0.002, 0.4)] == [0.0005, 0.002, 0.05]


def test_isolation_forest_separates(spark, features):
    forest = isolation.fit_isolation_forest(X.only_negatives(features), trees=40)
    assert forest.nodes["tree"].nunique() == 40 and forest.rows_per_tree == 256
    scored = isolation.min_max_scaled(forest.transform(features)).selectExpr("Class as label", "score").cache()
    low, high = scored.agg(F.min("score"), F.max("score")).first()
    assert (low, high) == (0.0, 1.0)
    assert E.roc_auc(scored).first()["auc"] > 0.95


def test_tree_drivers_add_up(spark, features):
    """Contributions of a row sum to its margin less the same constant for every row."""
    classifier = models.fit_boosted_trees(features, positive_weight=3.0, **FIRST_ORDER)
    contributions = models.tree_contributions(classifier, S.FEATURES, spark)
    raw = classifier.transform(isolation.assemble(features.limit(200), S.FEATURES))
    total = F.aggregate(contributions, F.lit(0.0), lambda a, b: a + b)
    rows = raw.select(vector_to_array("rawPrediction")[1].alias("margin"), total.alias("total")).collect()
    # The raw prediction of the positive class is the sum of the weighted trees.
    gaps = [r["margin"] - r["total"] for r in rows]
    assert max(gaps) - min(gaps) < 1e-6
    drivers = features.limit(50).select(models.row_drivers(classifier, S.FEATURES, spark).alias("d")).collect()
    for row in drivers:
        sizes = [abs(d["shap_value"]) for d in row["d"]]
        assert len(sizes) == 5 and sizes == sorted(sizes, reverse=True)
        assert all(d["direction"] == ("risk_increasing" if d["shap_value"] >= 0 else "risk_decreasing") for d in row["d"])


def test_train_tune_evaluate_score_generate(spark, cards, features, tmp_path):
    out = str(tmp_path / "run")
    run = jobs.train(spark, features, out, trees=20, **BOOST)
    table_rows = {r["model"]: r for r in run.comparison.collect()}
    assert set(table_rows) == {"boosted_trees", "isolation_forest"}
    assert table_rows["boosted_trees"]["validation_rows"] == 300 and table_rows["boosted_trees"]["fraud_cases"] == 12
    assert run.oversampling["minority_count_after"] == 1152
    best = max(table_rows.values(), key=lambda r: r["auprc"])["model"]
    assert run.best_model == best or table_rows["boosted_trees"]["auprc"] == table_rows["isolation_forest"]["auprc"]
    record = artifacts.latest_record(spark, f"{out}/run_metrics/training", "training").first()
    assert record["best_model"] == run.best_model and record["oversampling"]["enabled"] == "True"

    chosen = jobs.tune(run.holdout, run.boosted, out)
    assert chosen.count() == 2
    tuned = artifacts.latest_record(spark, f"{out}/run_metrics/tuning", "tuning").first()
    assert tuned["threshold"] == run.boosted.threshold and tuned["threshold_grid_size"] == 109
    assert set(tuned["choices"]) == {"best_f1_threshold", "best_business_cost_threshold"}
    assert artifacts.read_threshold_metrics(spark, f"{out}/threshold_metrics").count() == 109

    # From the folder alone: the same trees, the tuned threshold, and anomaly scores that do not depend on company.
    model, forest = model_store.load_scoring_model(spark, out), model_store.load_forest(spark, out)
    assert model.threshold == run.boosted.threshold and model.stats == pytest.approx(dict(run.boosted.stats))
    assert record["oversampling"]["contamination"] == str(isolation.contamination(0.04))
    scores = [jobs.labelled(models.with_probability(run.holdout, m.classifier, m.features, "score"), "score").orderBy("score").collect() for m in (run.boosted, model)]
    assert scores[0] == scores[1]
    together = {tuple(r[:5]): r["score"] for r in forest.score(run.holdout).collect()}
    alone = forest.score(run.holdout.orderBy("Time").limit(7)).collect()
    assert all(together[tuple(r[:5])] == r["score"] for r in alone)
    assert min(together.values()) == 0.0 and max(together.values()) == 1.0
    with pytest.raises(FileNotFoundError):
        model_store.load_scoring_model(spark, str(tmp_path / "nothing"))

    evaluation = jobs.evaluate(run.holdout, model)
    assert evaluation.metrics.first()["auc"] > 0.95
    assert evaluation.report.count() == 5 and evaluation.best_thresholds.count() == 10

    raw = spark.read.schema(S.transaction_schema()).option("header", True).csv(cards)
    scored, summary = jobs.batch_score(raw, run.boosted, explain=True)
    first = summary.first()
    assert first["transaction_count"] == 1500 and sum(first["decision_counts"].values()) == 1500
    assert scored.filter(F.size("top_shap_features") == 5).count() == 1500

    stored = str(tmp_path / "alerts")
    made = jobs.generate_alerts(
        spark, cards, stored, run.boosted, max_rows=800, alert_threshold=0.1, max_alerts=20
    ).first()
    assert made["scanned"] == 800 and 0 < made["inserted"] <= 20 and made["inserted"] <= made["candidates"]
    alerts = table.read_alerts(spark, stored)
    assert alerts.count() == made["inserted"]
    assert alerts.filter("size(top_shap_features) = 5 AND alert_reason = 'dashboard_demo_generator'").count() == made["inserted"]
    every = jobs.generate_alerts(spark, cards, str(tmp_path / "all"), run.boosted, max_alerts=20).first()
    assert every["scanned"] == 1500
    fed = jobs.feed_alerts(spark, cards, str(tmp_path / "fed"), run.boosted, 0.5)
    assert fed == table.read_alerts(spark, str(tmp_path / "fed")).count() > 0


def test_stream_with_a_loaded_model_equals_batch(spark, features, cards, tmp_path):
    """A model from its folder scores a stream as it scores a table; replays of a batch leave one copy."""
    out = str(tmp_path / "run")
    jobs.train(spark, features, out, trees=5, **BOOST)
    model = model_store.load_scoring_model(spark, out)
    raw = spark.read.schema(S.transaction_schema()).option("header", True).csv(cards)
    events = raw.withColumns({"transaction_id": F.concat(F.lit("t"), F.col("Time").cast("int")), "merchant_name": F.lit("m")})
    messages.publish_text(messages.transaction_messages(events).select("value"), str(tmp_path / "in"))
    stream = messages.text_stream(spark, str(tmp_path / "in"))
    path, aside = str(tmp_path / "alerts"), str(tmp_path / "aside")
    streaming.start_alert_stream(stream, streaming.model_scorer(model), path, aside, str(tmp_path / "c"), "s", 0.5, None).awaitTermination()
    live = streaming.read_stream_alerts(spark, path)
    batch = models.score_transactions(events, model).filter("fraud_probability > 0.5")
    columns = ["Time", "fraud_probability", "decision", "Amount"]
    assert sorted(map(tuple, live.select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))
    figures = streaming.read_batch_figures(spark, path).agg(F.sum("scored"), F.sum("flagged")).first()
    assert tuple(figures) == (1500, live.count())
    day = live.select("stored_date").first()[0]
    assert streaming.compact_day(spark, path, str(tmp_path / "compact"), str(day)) == live.filter(F.col("stored_date") == F.lit(day)).count()


def test_registered_isolation_scores_come_from_all_trees(spark, monkeypatch):
    class Asked(Exception):
        pass

    def fit(negatives, *args, trees=isolation.TREES, **kwargs):
        raise Asked(trees)

    monkeypatch.setattr(isolation, "fit_isolation_forest", fit)
    with pytest.raises(Asked) as asked:
        model_queries.isolation_scores(spark, "/root/testdata/sf0.001")
    assert asked.value.args == (350,)


def test_registered_boosted_tree_scores_come_from_all_iterations(spark, monkeypatch):
    class Asked(Exception):
        pass

    def fit(rows, *args, rounds=boosting.ROUNDS, depth=boosting.DEPTH, **kwargs):
        raise Asked(rounds, depth)

    monkeypatch.setattr(boosting, "fit_histogram_trees", fit)
    with pytest.raises(Asked) as asked:
        model_queries.boosted_tree_scores(spark, "/root/testdata/sf0.001")
    assert asked.value.args == (450, 4)

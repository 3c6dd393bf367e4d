import math
import random
import statistics
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.operators import alerts as A
from riskspark.operators import features as X
from riskspark.operators import reports
from riskspark.operators.alerts import normalize_alerts
from riskspark.sources.transactions import enrich_events


def documents(spark, rows):
    names = sorted({k for row in rows for k in row})
    kinds = {"fraud_probability": "double", "risk_score": "double", "Amount": "double", "threshold": "double"}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    return spark.createDataFrame([tuple(row.get(n) for n in names) for row in rows], schema)


def test_ranges_are_clipped(spark):
    rows = [{"fraud_probability": -1.0, "risk_score": -20.0}, {"fraud_probability": 2.0, "risk_score": 150.0}]
    found = A.display_alerts(documents(spark, rows)).collect()
    assert sorted((r["fraud_probability"], r["risk_score"]) for r in found) == [(0.0, 0.0), (1.0, 100.0)]
    assert all(r["transaction_id"] for r in found)


def test_action_is_kept_and_decision_recomputed(spark):
    row = {"transaction_id": "a", "fraud_probability": 0.95, "decision": "review", "recommended_action": "Wait."}
    found = A.normalize_alerts(documents(spark, [row])).first()
    assert (found["decision"], found["recommended_action"]) == ("BLOCKED", "Wait.")
    kept = A.normalize_alerts(documents(spark, [row]), recompute_decision=False).first()
    assert kept["decision"] == "REVIEW"


def test_empty_kpis(spark):
    found = reports.kpi_summary(A.normalize_alerts(documents(spark, [{"fraud_probability": 0.1}])).limit(0)).first()
    assert found["alert_count"] == 0 and found["average_risk"] == 0.0 and found["alerted_amount"] == 0.0
    assert reports.hourly_profile(A.normalize_alerts(documents(spark, [{"fraud_probability": 0.1}])).limit(0)).count() == 0


def test_merchant_counts_and_median(spark):
    rows = [{"merchant_name": "Shop A", "fraud_probability": p, "threshold": 0.9} for p in (0.2, 0.7, 0.95, 0.98)]
    rows += [{"merchant_name": None, "fraud_probability": p, "threshold": 0.9} for p in (0.2, 0.8)]
    table = {r["merchant_name"]: r for r in reports.merchant_summary(A.normalize_alerts(documents(spark, rows))).collect()}
    a, none = table["Shop A"], table[None]
    assert (a["alert_count"], a["review_count"], a["flagged_count"], a["blocked_count"]) == (4, 1, 1, 2)
    assert a["block_rate"] == 0.5 and a["median_risk_score"] == 82.5
    assert none["avg_probability"] == pytest.approx(0.5) and none["max_probability"] == 0.8
    assert none["avg_risk_score"] == pytest.approx(50.0) and none["max_risk_score"] == 80.0
    named = reports.high_risk_merchants(A.normalize_alerts(documents(spark, rows)), 1).collect()
    assert [r["merchant_name"] for r in named] == ["Shop A"]


def test_cumulative_order(spark):
    rows = [
        {"transaction_id": "a", "Amount": 10.0, "event_time_utc": "2026-01-02T00:00:00Z", "stored_at_utc": "2026-01-01T00:00:00Z"},
        {"transaction_id": "b", "Amount": 5.0, "event_time_utc": "2026-01-01T00:00:00Z", "stored_at_utc": "2026-01-02T00:00:00Z"},
        {"transaction_id": "c", "Amount": 7.0},
    ]
    found = reports.cumulative_amount(documents(spark, rows)).orderBy("_event_time").collect()
    assert [(r["transaction_id"], r["cum_amount"]) for r in found] == [("b", 5.0), ("a", 15.0)]


@pytest.mark.parametrize("hot", [False, True])
def test_cumulative_amount_in_ranges(spark, hot, monkeypatch):
    """Many ranges, a moment with a third of all alerts, and many exact copies of one alert."""
    monkeypatch.setattr("riskspark.operators.ranks.COPIES_PER_TASK_ROW", 100)
    rng = random.Random(5)
    base = 1_767_225_600
    rows = [(f"t{i}", base + rng.randrange(5000), rng.randrange(1, 500) / 4) for i in range(2000)]
    if hot:
        rows += [(f"h{i}", base + 2500, rng.randrange(1, 500) / 4) for i in range(800)]
        rows += [("copy", base + 2500, 2.25)] * 1200
    df = spark.createDataFrame(rows, "transaction_id string, s long, Amount double").repartition(7)
    df = df.select("transaction_id", "Amount", F.timestamp_seconds("s").alias("event_time_utc"))
    found = reports.cumulative_amount(df, rows_per_range=200).collect()
    assert len(found) == len(rows)
    assert sorted((r["transaction_id"], r["Amount"]) for r in found) == sorted((r[0], r[2]) for r in rows)
    total = 0.0
    last = None
    for r in sorted(found, key=lambda r: r["cum_amount"]):
        total += r["Amount"]
        assert r["cum_amount"] == pytest.approx(total)
        assert last is None or r["_event_time"] >= last
        last = r["_event_time"]


def test_night_flags(spark):
    timed = [
        {"transaction_id": "a", "event_time_utc": "2026-01-01T23:30:00Z", "stored_at_utc": "2026-01-02T12:00:00Z"},
        {"transaction_id": "b", "transaction_time_utc": "2026-01-01T14:30:00Z", "stored_at_utc": "2026-01-02T23:00:00Z"},
        {"transaction_id": "c", "hour_of_day": "23"},
    ]
    rows = A.normalize_alerts(documents(spark, timed))
    found = {r["transaction_id"]: r["is_night"] for r in reports.night_flags(rows).collect()}
    assert found == {"a": True, "b": False, "c": False}
    only_hour = A.normalize_alerts(documents(spark, timed[2:]))
    assert reports.night_flags(only_hour).first()["is_night"] is True
    assert reports.insight_ratios(only_hour).first()["night_count"] == 1


def test_amount_today(spark):
    rows = [{"Amount": 5.0, "stored_at_utc": "2026-01-02T00:00:00Z"}, {"Amount": 7.0, "stored_at_utc": "2026-01-01T23:59:59Z"}]
    now = datetime(2026, 1, 2, 18, tzinfo=timezone.utc)
    assert reports.amount_since_midnight(documents(spark, rows), now).first()[0] == 5.0
    assert reports.amount_since_midnight(documents(spark, rows[1:]), now).first()[0] == 0.0


def test_batch_summary_needs_rows(spark):
    rows = A.normalize_alerts(documents(spark, [{"fraud_probability": 0.7}]))
    assert reports.batch_score_summary(rows).first()["flagged_or_blocked_count"] == 1
    with pytest.raises(Exception, match="at least one transaction"):
        reports.batch_score_summary(rows.limit(0)).collect()


def test_amount_coercion(spark):
    names = S.RAW_COLUMNS
    rows = [tuple("123.45" if n == "Amount" else "1" for n in names), tuple(None if n == "Amount" else "1" for n in names)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    found = {(r["Amount"], r["amount_source"]) for r in X.coerce_csv(df).collect()}
    assert found == {(123.45, "raw_creditcard_csv"), (0.0, "fallback_missing_amount")}
    without = X.coerce_csv(df.drop("Amount")).collect()
    assert {(r["Amount"], r["amount_source"]) for r in without} == {(0.0, "fallback_missing_amount")}


def test_features_edge_cases(spark):
    df = spark.createDataFrame([(-1.0, -2.0, 1.0), (90000.0, -2.0, 0.0)], "Time double, Amount double, Class double")
    found = X.add_features(df).orderBy("Time").collect()
    assert [r["hour_of_day"] for r in found] == [23.0, 1.0]
    assert [r["is_night_transaction"] for r in found] == [1.0, 1.0]
    assert [r["amount_log"] for r in found] == [0.0, 0.0]
    assert [r["amount_zscore"] for r in found] == [0.0, 0.0]  # zero deviation divides by one
    stats = X.dataset_statistics(df).first()
    assert stats["amount_std"] == 0.0 and stats["class_distribution"] == {"0": 1, "1": 1}
    with pytest.raises(ValueError, match="missing columns"):
        X.scoring_features(df)


def test_deviation_of_large_amounts(spark):
    """Amounts that differ little beside their size, over several classes, one of them without amounts."""
    amounts = [(1e12 + i % 7, float(i % 3)) for i in range(500)] + [(None, 5.0), (1e12, None)]
    known = [a for a, _ in amounts if a is not None]
    centre = statistics.fmean(a - 1e12 for a in known)
    want = math.sqrt(sum((a - 1e12 - centre) ** 2 for a in known) / len(known))
    stats = X.dataset_statistics(spark.createDataFrame(amounts, "Amount double, Class double")).first()
    assert stats["amount_std"] == pytest.approx(want, rel=1e-6) and stats["row_count"] == 502
    none = X.dataset_statistics(spark.createDataFrame([], "Amount double, Class double")).first()
    assert none["amount_std"] == 0.0 and none["row_count"] == 0


def test_enrichment_is_repeatable(spark):
    df = spark.range(200).select(F.col("id").cast("double").alias("Time"), F.lit(1.0).alias("Amount"))
    now = datetime(2026, 1, 2, tzinfo=timezone.utc)
    one = enrich_events(df, ["a", "b"], now).orderBy("Time").collect()
    two = enrich_events(df.repartition(5), ["a", "b"], now).orderBy("Time").collect()
    assert one == two
    assert len({r["transaction_id"] for r in one}) == 200


def test_cumulative_amount_orders_equal_times_by_id(spark):
    moment = "2026-02-03T04:05:06+00:00"
    rows = [{"transaction_id": i, "Amount": a, "event_time_utc": moment} for i, a in (("c", 4.0), ("a", 1.0), ("d", 8.0), ("b", 2.0))]
    for rows_per_range in (10**6, 2):
        found = reports.cumulative_amount(documents(spark, rows), rows_per_range).collect()
        assert sorted((r["transaction_id"], r["cum_amount"]) for r in found) == [("a", 1.0), ("b", 3.0), ("c", 7.0), ("d", 15.0)]


def test_both_amount_spellings(spark):
    df = spark.createDataFrame([(None, 5.0, 0.5), (7.0, 1.0, 0.5), (None, None, 0.2)], "Amount double, amount double, fraud_probability double")
    assert [r["Amount"] for r in normalize_alerts(df).collect()] == [5.0, 7.0, 0.0]


def test_missing_ids_are_repeatable(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("Amount"), F.lit(0.4).alias("fraud_probability"))
    ids = [sorted((r["Amount"], r["transaction_id"]) for r in normalize_alerts(rows).collect()) for rows in (df, df.repartition(7))]
    assert ids[0] == ids[1] and len({i for _, i in ids[0]}) == 50


def test_missing_ids_share_one_hash_expression(spark):
    rows = [(None, 1.0, {"a": 1}, [1]), ("", 2.0, None, None), ("given", 3.0, {}, [])]
    df = spark.createDataFrame(rows, "transaction_id string, Amount double, tags map<string, int>, parts array<int>")
    held = ["transaction_id", "Amount", F.to_json("tags"), "parts"]
    both = [F.lpad(F.hex(F.xxhash64(F.lit(seed), *held)), 16, "0") for seed in (1, 2)]
    want = [r[0] for r in df.select(F.lower(F.concat(*both))).collect()]
    alerts = normalize_alerts(df)
    ids = {r["Amount"]: r["transaction_id"] for r in alerts.collect()}
    assert ids == {1.0: want[0], 2.0: want[1], 3.0: "given"}
    assert alerts._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 1

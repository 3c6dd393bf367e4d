import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.operators import reports
from riskspark.operators.alerts import normalize_alerts
from riskspark.plans import jobs, views
from riskspark.session import shared_folder
from riskspark.sources import alerts as table
from riskspark.sources import artifacts, messages, transactions
from riskspark.streaming import alerts as streaming

NOW = datetime(2026, 6, 3, 12, tzinfo=timezone.utc)
SF = "/root/testdata/sf0.001"

SEEDS = [
    {"transaction_id": "first", "merchant_name": "Corner Shop", "amount": 31.5, "fraud_probability": 0.31, "top_shap_features": []},
    {"transaction_id": "second", "merchant_name": "Book Store", "Amount": 870.25, "fraud_probability": 0.66, "decision": "FLAGGED",
     "event_time_utc": "2026-05-11T08:30:00+00:00", "shap_features": [{"feature": "V4", "shap_value": -0.2, "value": 3.0}]},
    17,
]


@pytest.fixture
def seed_path(tmp_path):
    path = tmp_path / "seeds.json"
    path.write_text(json.dumps(SEEDS))
    return str(path)


def test_alert_table(spark, tmp_path):
    path = str(tmp_path / "alerts")
    assert table.read_alerts(spark, path).count() == 0 and table.clear_alerts(spark, path) == 0
    documents = views.alert_documents(spark, SF)
    assert table.write_alerts(documents, path, NOW) == 1000
    assert table.write_alerts(documents.limit(5).drop("stored_at_utc"), path, NOW) == 5
    stored = table.read_alerts(spark, path)
    assert stored.count() == 1005
    assert {f.name for f in S.ALERT_SCHEMA} <= set(stored.columns)
    assert stored.filter(F.col("stored_at_utc") == F.lit(NOW)).count() == 5
    assert reports.amount_since_midnight(stored, NOW).first()[0] > 0
    table.export_alerts_csv(stored, str(tmp_path / "csv"))
    header = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert header.columns == S.EXPORT_COLUMNS and header.count() == 1005
    assert table.clear_alerts(spark, path) == 1005
    assert table.read_alerts(spark, path).count() == 0


def test_seeds(spark, seed_path, tmp_path):
    seeds = table.read_seed_alerts(spark, seed_path)
    rows = seeds.orderBy("position").collect()
    assert [r["Amount"] for r in rows] == [31.5, 870.25]
    assert rows[1]["top_shap_features"][0]["feature"] == "V4" and rows[0]["top_shap_features"] == []
    assert rows[1]["event_time_utc"] is not None and rows[1]["decision"] == "FLAGGED"
    for text in ("[]", "{oops"):
        empty = tmp_path / "empty.json"
        empty.write_text(text)
        with pytest.raises(ValueError, match="empty or invalid"):
            table.read_seed_alerts(spark, str(empty))


def test_seeds_of_many_arrays_in_a_file(spark, tmp_path):
    texts = [f'[{{"transaction_id": "a{i}",\n "Amount": {i}}},\n {{"transaction_id": "b{i}", "amount": {i}}}]\n' for i in range(40)]
    path = tmp_path / "seeds.json"
    path.write_text("\x1e" + "\x1e".join(texts), encoding="utf-8")
    rows = table.read_seed_alerts(spark, str(path)).select("position", "transaction_id", "Amount").collect()
    assert sorted(map(tuple, rows)) == sorted((p, f"{c}{i}", float(i)) for i in range(40) for p, c in enumerate("ab"))


def test_seed_refresh_writes_no_file_per_array(spark, tmp_path, monkeypatch):
    from riskspark.plans import alert_queries

    monkeypatch.setattr(alert_queries, "shared_folder", lambda spark, purpose: str(tmp_path / purpose))
    assert alert_queries.seed_refresh(spark, SF).count() == 1000
    assert len(list((tmp_path / "seeds").rglob("part-*"))) <= 8  # of 20 arrays, by 8 tasks at most


def test_views_are_written_apart_from_their_aggregation(spark, tmp_path):
    """The one task that writes a view's file does not compute its partitions."""
    from pyspark import TaskContext

    task = F.udf(lambda _: float(TaskContext.get().partitionId()), "double")
    rows = spark.range(64).repartition(8).select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"),
        F.lit(1).alias("hour_of_day"),
        *[F.lit(1).cast("long").alias(c) for c in ("fraud_alerts", "blocked_count", "flagged_count")],
        *[task("id").alias(c) for c in ("total_probability", "max_probability", "total_risk_score", "max_risk_score", "total_amount")],
    )
    streaming.write_day_hours(rows, 0, str(tmp_path / "view"), fold_every=1)
    view = streaming.read_day_hours(spark, str(tmp_path / "view"), fold_every=1)
    assert view.count() == 64 and view.select("total_amount").distinct().count() == 8
    assert len(list((tmp_path / "view").rglob("part-*.parquet"))) == 2


def test_csv_checks(spark, tmp_path):
    rows = views.card_rows(spark, SF).select(*S.RAW_COLUMNS)
    path = str(tmp_path / "cards")
    rows.limit(60).write.option("header", True).csv(path)
    with pytest.raises(ValueError, match="fewer than 100 rows"):
        transactions.read_transactions_csv(spark, path)
    assert transactions.read_transactions_csv(spark, path, min_rows=0, max_rows=7).count() == 7
    rows.drop("V3").write.option("header", True).csv(f"{path}-narrow")
    with pytest.raises(ValueError, match=r"\['V3'\]"):
        transactions.read_transactions_csv(spark, f"{path}-narrow")


def test_feature_job(spark, tmp_path):
    csv = str(tmp_path / "cards")
    rows = views.card_rows(spark, SF).select(*reversed(S.RAW_COLUMNS))  # columns are found by name
    rows.write.option("header", True).csv(csv)
    features, stats = str(tmp_path / "features"), str(tmp_path / "stats")
    default = transactions.read_stats(spark, stats).first()
    assert (default["amount_mean"], default["amount_std"], default["row_count"]) == (0.0, 1.0, None)
    built = transactions.read_features(spark, features, lambda: jobs.build_features(spark, csv, features, stats))
    assert built.columns == [*S.FEATURES, S.TARGET] and built.count() == rows.count()
    record = transactions.read_stats(spark, stats)
    assert record.first()["row_count"] == rows.count() and len(record.first()["feature_columns"]) == 34
    assert [r["class"] for r in jobs.class_lines(record).collect()] == ["0", "1"]
    with pytest.raises(FileNotFoundError):
        transactions.read_features(spark, str(tmp_path / "missing"))


def test_run_records(spark, tmp_path):
    path = str(tmp_path / "records")
    assert artifacts.latest_record(spark, path, "tuning") is None
    for threshold in (0.4, 0.7):
        row = spark.createDataFrame([("tuning", threshold)], "kind string, threshold double")
        artifacts.append_record(row, path)
    assert artifacts.latest_record(spark, path, "tuning").first()["threshold"] == 0.7


def score(df):
    return df.withColumn("fraud_probability", F.col("V1")).withColumn("threshold", F.lit(0.9))


def event(i, p, **changes):
    row = {"transaction_id": f"t{i}", "merchant_name": "m", "Time": 3600.0 * i, "Amount": 10.0, "Class": 1.0}
    row |= {f"V{j}": 0.0 for j in range(1, 29)} | {"V1": p} | changes
    return json.dumps({k: v for k, v in row.items() if v is not None})


def test_stream_scores_quarantines_and_replays(spark, tmp_path):
    folder, out, aside = tmp_path / "in", str(tmp_path / "alerts"), str(tmp_path / "aside")
    folder.mkdir()
    lines = [event(1, 0.5), event(2, 0.51), event(3, 0.95), event(4, 0.9, V7=None), "not json", event(5, 0.2)]
    (folder / "a.txt").write_text("\n".join(lines) + "\n")

    def run(checkpoint):
        stream = messages.text_stream(spark, str(folder))
        query = streaming.start_alert_stream(stream, score, out, aside, str(tmp_path / checkpoint), "s", 0.5, None)
        query.awaitTermination()

    run("one")
    alerts = streaming.read_stream_alerts(spark, out).orderBy("transaction_id").collect()
    assert [(r["transaction_id"], r["decision"]) for r in alerts] == [("t2", "FLAGGED"), ("t3", "BLOCKED")]
    assert alerts[0]["alert_reason"] == "fraud_probability_above_0.5" and alerts[0]["actual_class"] == 1
    assert alerts[0]["hour_of_day"] == 2 and alerts[0]["scored_at_utc"] and alerts[0]["stored_at_utc"]
    rejected = spark.read.parquet(aside)
    assert rejected.count() == 2
    assert rejected.filter("_corrupt_record = 'not json'").count() == 1
    (folder / "b.txt").write_text(event(6, 0.8) + "\n")
    run("one")
    assert streaming.read_stream_alerts(spark, out).count() == 3
    (folder / "c.txt").write_text("")
    # The same batch again, as after a failure between write and commit.
    batch = streaming.parse_messages(spark.createDataFrame([(event(6, 0.8),), (event(7, 0.9),)], "value string"))
    figures = streaming.write_batch(batch, 1, score, out, aside, "s")
    assert figures["rows"] == 2 and figures["flagged"] == 2 and figures["max_probability"] == 0.9
    assert streaming.read_stream_alerts(spark, out).count() == 4


def test_messages_refuse_nan(spark):
    rows = views.card_rows(spark, SF).withColumn("V2", F.when(F.col("vec_id") % 2 == 0, float("nan")).otherwise(F.col("V2")))
    found = messages.transaction_messages(rows).collect()
    assert 0 < len(found) < rows.count()
    record = json.loads(found[0]["value"])
    assert set(S.BASE_FEATURES) <= set(record) and record["transaction_id"] == found[0]["key"]
    assert ", " not in found[0]["value"][:80] and messages.transaction_messages(rows, 4).count() <= 4


def test_kafka_needs_its_package(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        messages.kafka_stream(spark, "localhost:1", "transactions")


def test_hourly_view_equals_batch(spark, tmp_path):
    documents = views.alert_documents(spark, SF)
    documents.repartition(6).write.parquet(str(tmp_path / "docs"))
    stream = streaming.replay_files(spark, documents.schema, str(tmp_path / "docs"), 1)
    out = str(tmp_path / "hours")
    query = streaming.start_hourly_view(normalize_alerts(stream), out, str(tmp_path / "c"), trigger=None)
    query.awaitTermination()
    live = spark.read.parquet(out).orderBy("hour_of_day").collect()
    batch = reports.hourly_profile(normalize_alerts(documents)).orderBy("hour_of_day").collect()
    assert len(live) == 24
    for a, b in zip(live, batch):
        assert a.asDict() == pytest.approx(b.asDict())


def hours(df):
    return {(r.day, r.hour_of_day): r.asDict() for r in df.collect()}


def test_day_hour_view_survives_crashes(spark, tmp_path, monkeypatch):
    """Batches that fail after writing (a fold among them) run again at the next start; late alerts change earlier days."""
    documents = views.alert_documents(spark, SF)
    documents.repartition(7).write.parquet(str(tmp_path / "docs"))
    stream = normalize_alerts(streaming.replay_files(spark, documents.schema, str(tmp_path / "docs"), 1))
    out, whole = str(tmp_path / "view"), streaming.write_day_hours
    assert streaming.read_day_hours(spark, out, 3).count() == 0
    runs = []

    def failing(batch, batch_id, *args):
        whole(batch, batch_id, *args)
        runs.append(batch_id)
        if batch_id in (0, 2, 5) and runs.count(batch_id) == 1:
            raise RuntimeError("lost before the commit")

    monkeypatch.setattr(streaming, "write_day_hours", failing)
    for _ in range(3):
        with pytest.raises(Exception, match="lost before the commit"):
            streaming.start_day_hour_view(stream, out, str(tmp_path / "c"), None, 3).awaitTermination()
    streaming.start_day_hour_view(stream, out, str(tmp_path / "c"), None, 3).awaitTermination()
    assert runs == [0, 0, 1, 2, 2, 3, 4, 5, 5, 6]
    batch = normalize_alerts(documents)
    want, got = hours(reports.day_hour_figures(batch)), hours(streaming.read_day_hours(spark, out, 3))
    assert got.keys() == want.keys() and len(want) > 24
    for key in want:
        assert got[key] == pytest.approx(want[key])
    live = reports.hourly_profile_of_days(streaming.read_day_hours(spark, out, 3)).orderBy("hour_of_day").collect()
    for a, b in zip(live, reports.hourly_profile(batch).orderBy("hour_of_day").collect(), strict=True):
        assert a.asDict() == pytest.approx(b.asDict())


def test_day_hour_view_on_a_timed_trigger(spark, tmp_path):
    """The view keeps up while its stream runs; alerts without a time have a null day of their own."""
    documents = views.alert_documents(spark, SF)
    first, second = documents.limit(300), documents.limit(20).withColumn("stored_at_utc", F.lit(None).cast("timestamp"))
    first.write.parquet(str(tmp_path / "docs"))
    stream = normalize_alerts(streaming.replay_files(spark, documents.schema, str(tmp_path / "docs"), 10))
    out = str(tmp_path / "view")
    query = streaming.start_day_hour_view(stream, out, str(tmp_path / "c"), "1 second")
    try:
        query.processAllAvailable()
        assert streaming.read_day_hours(spark, out).agg(F.sum("fraud_alerts")).first()[0] == 300
        second.write.mode("append").parquet(str(tmp_path / "docs"))
        query.processAllAvailable()
    finally:
        query.stop()
    rows = streaming.read_day_hours(spark, out)
    assert rows.agg(F.sum("fraud_alerts")).first()[0] == 320
    assert rows.filter("day IS NULL").agg(F.sum("fraud_alerts")).first()[0] == 20


def test_shared_folder_uses_the_session_setting(spark):
    assert shared_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_a_large_day_is_compacted_into_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming, "ROWS_PER_FILE", 100, raising=False)
    path, out = str(tmp_path / "alerts"), str(tmp_path / "compact")
    rows = spark.range(1000).select(
        F.lit("2026-06-03").cast("date").alias("stored_date"), F.col("id").cast("string").alias("transaction_id")
    )
    rows.write.partitionBy("stored_date").parquet(path)
    assert streaming.compact_day(spark, path, out, "2026-06-03") == 1000
    assert streaming.compact_day(spark, path, out, "2026-06-04") == 0
    files = spark.read.parquet(f"{out}/stored_date=2026-06-03")
    assert sorted(int(r.transaction_id) for r in files.collect()) == list(range(1000))
    assert max(r["count"] for r in files.groupBy(F.input_file_name()).count().collect()) <= 200

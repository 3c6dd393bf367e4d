import pytest
from pyspark.sql import functions as F

from riskspark import schema as S
from riskspark.functions import risk, text, times


def values(spark, rows, schema, *columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(row) for row in df.select(*columns).collect()]


def test_schema_sizes():
    assert len(S.BASE_FEATURES) == 30 and len(S.FEATURES) == 34
    assert S.FEATURES[0] == "Time" and S.FEATURES[-1] == "amount_zscore"
    assert len(S.transaction_schema()) == 31 and S.transaction_schema()[-1].name == "Class"


@pytest.mark.parametrize(
    ("given", "probability", "score"),
    [("-3", 0.0, 0.0), ("2.5", 1.0, 2.5), ("145", 1.0, 100.0), ("nan", 0.0, 0.0), ("Infinity", 0.0, 0.0),
     ("x", 0.0, 0.0), (None, 0.0, 0.0), ("-1", 0.0, 0.0), ("0.25", 0.25, 0.25)],
)
def test_clipping(spark, given, probability, score):
    c = F.col("v")
    found = values(spark, [(given,)], "v string", risk.clip_probability(c), risk.clip_risk_score(c))
    assert found == [(probability, score)]


def test_scores_amounts_thresholds(spark):
    c = F.col("v")
    rows = values(
        spark, [(1.8,), (-15.0,), (0.3,)], "v double",
        risk.risk_score(c), risk.normalize_amount(c), risk.normalize_threshold(c, 0.5),
    )
    assert rows == [(100.0, 1.8, 1.0), (0.0, 0.0, 0.5), (30.0, 0.3, 0.5)]


@pytest.mark.parametrize(
    ("p", "band"), [(0.05, "APPROVED"), (0.25, "REVIEW"), (0.65, "FLAGGED"), (0.95, "BLOCKED"), (0.5, "FLAGGED"),
                    (0.9, "BLOCKED"), (0.1, "REVIEW")]
)
def test_bands(spark, p, band):
    verdict = risk.classify(F.col("v"), 0.9, 0.1).alias("c")
    row = spark.createDataFrame([(p,)], "v double").select(verdict).first()["c"]
    assert row["decision"] == band
    assert row["block_threshold"] == 0.9
    assert row["recommended_action"] == S.ACTIONS[band]


def test_texts(spark):
    rows = [(0.9997,), (0.12345,), (None,), (2.5,)]
    found = values(spark, rows, "v double", text.probability_text(F.col("v")), text.risk_text(F.col("v")))
    assert [r[0] for r in found] == ["≥99.95%", "12.35%", "N/A", "≥99.95%"]
    assert [r[1] for r in found] == ["1 / 100", "0 / 100", "0 / 100", "2 / 100"]
    money = values(
        spark, [("1234.5",), ("x",), (None,)], "v string", text.currency(F.col("v")), text.percent(F.col("v"))
    )
    assert money == [("$1,234.50", "123450.0%"), ("$0.00", "0.0%"), ("$0.00", "0.0%")]
    ids = values(spark, [("abcdefghijklm",), ("abcdefghijklmn",), (None,)], "v string", text.short_id(F.col("v")))
    assert [r[0] for r in ids] == ["abcdefghijklm", "abcdefghij...", ""]


def test_paths(spark):
    fallback = F.lit("a\\b")
    rows = [("models\\artifacts\\xgboost_roc_curve.png",), ("",), (None,)]
    found = values(spark, rows, "v string", text.artifact_path(F.col("v"), fallback))
    assert [r[0] for r in found] == ["models/artifacts/xgboost_roc_curve.png", "a/b", "a/b"]


TIMES = {
    "2026-06-01T10:00:00+00:00": "2026-06-01 10:00:00",
    "2026-06-01T10:00:00Z": "2026-06-01 10:00:00",
    "2026-06-01 10:00:00": "2026-06-01 10:00:00",
    "2026-06-01T10:00:00.123456+05:30": "2026-06-01 04:30:00.123456",
    " 2026-06-01 ": "2026-06-01 00:00:00",
    "20260601": "2026-06-01 00:00:00",
    "20260601T101112": "2026-06-01 10:11:12",
    "2026-06-01T10": "2026-06-01 10:00:00",
    "2026-06-01T10:05-02:00": "2026-06-01 12:05:00",
    "2026": None,
    "2026-06": None,
    "2026-13-01": None,
    "2026-06-01T25:00:00": None,
    "today": None,
    "2026-06-01T10:00:00 Europe/Paris": None,
    "": None,
    None: None,
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_timestamps(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(k,) for k in TIMES], "v string")
        micros = F.unix_micros(times.parse_timestamp(F.col("v"))).alias("m")
        found = {r["v"]: r["m"] for r in df.select("v", micros).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    for given, expected in TIMES.items():
        wanted = None
        if expected:
            wanted = spark.sql(f"SELECT unix_micros(timestamp'{expected}')").first()[0]
        assert found[given] == wanted, given


def test_document_hour(spark):
    schema = "event_time_utc string, hour_of_day string, Time string, stored_at_utc string"
    rows = [
        ("2026-01-01T23:30:00Z", "5", "0", None),
        ("bad", "5.9", "0", None),
        (None, "24", "-1", None),
        (None, None, "x", "2026-01-01T03:00:00Z"),
        (None, None, None, "2026-01-01T03:00:00Z"),
        (None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    assert [r[0] for r in df.select(times.document_hour(df)).collect()] == [23, 5, 23, 0, 3, None]


def test_display_times(spark):
    df = spark.createDataFrame([("2026-01-01T01:02:03+01:00",), ("soon",), ("",), (None,)], "stored_at_utc string")
    shown = times.format_time_columns(df, S.DISPLAYED_TIMES).collect()
    assert [r[0] for r in shown] == ["2026-01-01 00:02:03 UTC", "soon", "N/A", "N/A"]

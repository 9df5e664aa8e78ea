"""Golden cases of the point-in-time joins and quality rules."""
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import ordered, quality, timeline

T0 = datetime(2024, 1, 1, 12, 0)
BAR = ("symbol string, close_time timestamp, available_time timestamp, open double, high double, low double, close double, "
       "volume_base double, volume_quote double, trade_count bigint, quality_status string")


def bar(spark, close_time, available=None, status="valid"):
    row = ("A", close_time, available or close_time + timedelta(milliseconds=1), 1.0, 2.0, 0.5, 1.5, 10.0, 15.0, 3, status)
    return spark.createDataFrame([row], BAR)


def taker(spark, end, delay):
    return spark.createDataFrame([("A", end, end + timedelta(minutes=5, seconds=delay), 5.0, 4.0, 1.25, "valid")],
                                 "symbol string, period_end timestamp, available_time timestamp, buy_volume double, sell_volume double, "
                                 "buy_sell_ratio double, quality_status string")


def now():
    return F.lit("2024-01-01 13:00:00").cast("timestamp")


def test_on_time_record_joins_and_late_record_does_not(spark):
    close = T0 + timedelta(minutes=5) - timedelta(milliseconds=1)
    for delay, expected in ((1, 5.0), (6, None)):
        out = timeline.align(bar(spark, close), {"taker_volume": taker(spark, T0, delay)}, now()).first()
        assert out["buy_volume"] == expected
        assert out["open_interest_value"] is None


def test_open_and_invalid_bars_are_absent(spark):
    assert timeline.align(bar(spark, datetime(2024, 1, 1, 14)), {}, now()).count() == 0
    assert timeline.align(bar(spark, T0, status="invalid"), {}, now()).count() == 0


def test_funding_fresh_and_stale(spark):
    aligned = timeline.align(bar(spark, datetime(2024, 1, 1, 12, 5)), {}, now())
    schema = "symbol string, event_time timestamp, available_time timestamp, funding_rate double"
    fresh = spark.createDataFrame([("A", T0, T0 + timedelta(seconds=1), 0.0001)], schema)
    old = datetime(2024, 1, 1, 0, 0)
    stale = spark.createDataFrame([("A", old, old + timedelta(seconds=1), 0.0002)], schema)
    row = timeline.add_funding(aligned, fresh).first()
    assert (row["funding_rate_last_known"], row["funding_age_minutes"]) == (0.0001, 5)
    row = timeline.add_funding(aligned, stale).first()
    assert (row["funding_rate_last_known"], row["funding_age_minutes"]) == (None, None)


def test_as_of_carries_over_empty_slices(spark):
    left = spark.createDataFrame([("A", T0 + timedelta(days=d)) for d in range(40)], "k string, t timestamp")
    right = spark.createDataFrame([("A", T0 + timedelta(days=2), 7), ("A", T0 + timedelta(days=30), 8)], "k string, u timestamp, x int")
    out = {r["t"]: r["x"] for r in ordered.asof_backward(left, right, ["k"], "t", "u", ["x"]).collect()}
    assert [out[T0 + timedelta(days=d)] for d in (0, 2, 29, 30, 39)] == [None, 7, 7, 8, 8]


def test_nearest_prefers_earlier_on_a_tie(spark):
    left = spark.createDataFrame([("A", T0)], "k string, t timestamp")
    right = spark.createDataFrame([("A", T0 - timedelta(minutes=5), 1), ("A", T0 + timedelta(minutes=5), 2)], "k string, u timestamp, x int")
    assert ordered.asof_nearest(left, right, ["k"], "t", "u", ["x"], 600).first()["x"] == 1
    assert ordered.asof_nearest(left, right, ["k"], "t", "u", ["x"], 60).first()["x"] is None


def test_severity_order_and_unique_flags(spark):
    df = spark.createDataFrame([(1, "quarantined", ["small"])], "x int, quality_status string, quality_flags array<string>")
    row = quality.apply_rules(df, [(F.col("x") > 0, "warning", "small"), (F.col("x") > 5, "invalid", "large")]).first()
    assert row["quality_status"] == "warning" and row["quality_flags"] == ["small"]


def test_quality_score_tolerates_absent_columns(spark):
    df = spark.createDataFrame([("A", T0, 1.0, None)], "symbol string, feature_time timestamp, close double, buy_volume double")
    row = quality.timeline_quality(df).first()
    assert row["quality_status"] == "warning" and abs(row["data_quality_score"] - 0.85) < 1e-12
    assert row["quality_reason_codes"] == "optional_missing"

"""Recursive indicators against step-by-step versions, over several blocks and short periods."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import indicators, splits


def bars(spark, n):
    return spark.range(n).selectExpr("'A' AS symbol", "timestamp_seconds(1700000000 + id * 300) AS feature_time", "100D + 20 * sin(id / 9D) + (id * 7919 % 13) AS close",
                                     "130D AS high", "70D AS low")


@pytest.mark.parametrize("period", [2, 5, 14])
def test_smoothed_strength_index(spark, period):
    n = 6000
    df = bars(spark, n)
    close = np.array([r["close"] for r in df.orderBy("feature_time").collect()])
    d = np.diff(close)
    gain, loss = np.maximum(d, 0), np.maximum(-d, 0)
    g, l = gain[:period].mean(), loss[:period].mean()
    want = [None] * period
    for i in range(period, n):
        if i > period:
            g, l = g + (gain[i - 1] - g) / period, l + (loss[i - 1] - l) / period
        want.append(100.0 if l == 0 else 100 - 100 / (1 + g / l))
    got = [r["rsi"] for r in indicators.rsi_smoothed(df, period).orderBy("feature_time").collect()]
    assert got[:period] == want[:period]
    assert np.allclose(got[period:], want[period:], atol=1e-6)


def test_time_cut_of_a_long_history(spark):
    df = spark.range(5000).selectExpr("timestamp_micros(1704067200000000 + id * id * 1000) AS signal_time", "id")
    cut = splits.chronological_cut(df, 0.8)
    fit = cut.where("part = 'fit'").agg(F.max("id"), F.count("id")).first()
    assert fit[1] == fit[0] + 1 and abs(fit[1] - 4000) <= 1

"""Sliced operators against plain windows, with one key holding most rows."""
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ordered, quantiles, sliding

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data = []
    for k, n in (("hot", 900), ("a", 40), ("b", 1)):
        t = T0
        for i in range(n):
            t += timedelta(minutes=rng.choice([5, 5, 5, 30, 59, 60, 61, 3000]))
            data.append((k, t, None if rng.random() < 0.1 else round(rng.gauss(100, 3), 3)))
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, t timestamp, x double")


def w():
    return Window.partitionBy("k").orderBy("t")


def same(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_position(rows):
    got = ordered.with_position(rows, ["k"], ["t"], "t", span=5 * ordered.DAY)
    same(got.select("k", "t", "_pos"), rows.withColumn("_pos", (F.row_number().over(w()) - 1).cast("bigint")).select("k", "t", "_pos"))


def test_position_of_newest_rows(rows):
    got = ordered.with_position(rows, ["k"], ["t"], "t", span=5 * ordered.DAY, last=100)
    want = rows.withColumn("_pos", (F.row_number().over(w()) - 1).cast("bigint"))
    assert got.select("k", "t", "_pos").exceptAll(want.select("k", "t", "_pos")).count() == 0
    newest = want.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("k"))).where("_pos >= n - 100")
    assert newest.select("k", "t").exceptAll(got.select("k", "t")).count() == 0


def test_running_functions(rows):
    run = w().rowsBetween(Window.unboundedPreceding, 0)
    got = ordered.running_last(rows, ["k"], "t", ["t"], F.col("x"), "y", span=3 * ordered.DAY)
    same(got.select("k", "t", "y"), rows.select("k", "t", F.last("x", True).over(run).alias("y")))
    got = ordered.running_sum(rows, ["k"], "t", ["t"], {"n": F.when(F.col("x") > 100, 1)}, span=3 * ordered.DAY)
    same(got.select("k", "t", "n"), rows.select("k", "t", F.sum(F.when(F.col("x") > 100, 1)).over(run).alias("n")))
    got = ordered.running_extreme(rows, ["k"], "t", ["t"], F.col("x"), "m", span=3 * ordered.DAY)
    same(got.select("k", "t", "m"), rows.select("k", "t", F.max("x").over(run).alias("m")))


def test_sessions_split_at_exactly_the_gap(rows):
    got = ordered.sessionize(rows, ["k"], "t", 3600, "s", span=2 * ordered.DAY)
    fresh = F.when(F.coalesce(F.unix_micros("t") - F.unix_micros(F.lag("t").over(w())), F.lit(10**12)) >= 3_600_000_000, F.col("t"))
    want = rows.withColumn("f", fresh).withColumn("s", F.last("f", True).over(w().rowsBetween(Window.unboundedPreceding, 0)))
    same(got.select("k", "t", "s"), want.select("k", "t", "s"))


@pytest.mark.parametrize("width,block", [(50, 64), (50, 200), (7, 64), (300, 301)])
def test_linear_frames_equal_stock_frames(rows, width, block):
    b = ordered.row_blocks(ordered.with_position(rows, ["k"], ["t"], "t"), "_pos", block, before=width + 1)
    got = sliding.sliding_extremes(b, ["k"], "_pos", {"e": "x"}, width)
    got = sliding.sliding_moments(got, ["k"], "_pos", "x", [width], "m").where(ordered.OWN)
    f = w().rowsBetween(1 - width, 0)
    want = rows.select("k", "t", F.min("x").over(f).alias("lo"), F.max("x").over(f).alias("hi"), F.avg("x").over(f).alias("avg"), F.stddev_samp("x").over(f).alias("sd"))
    j = got.join(want, ["k", "t"])
    assert j.count() == rows.count()
    assert j.where("NOT (lo <=> e_min) OR NOT (hi <=> e_max)").count() == 0
    off = j.where(f"abs(avg - m_{width}_avg) > 1e-8 OR abs(sd - m_{width}_std) > 1e-7 OR (avg IS NULL) <> (m_{width}_avg IS NULL) OR (sd IS NULL) <> (m_{width}_std IS NULL)")
    assert off.count() == 0


def test_exact_percentiles_equal_numpy(rows):
    data = {}
    for r in rows.where("x IS NOT NULL").collect():
        data.setdefault(r["k"], []).append(r["x"])
    got = {r["k"]: r for r in quantiles.exact_percentiles(rows, ["k"], F.col("x"), {"a": 0.1, "b": 0.5, "c": 0.95}).collect()}
    for k, v in data.items():
        assert np.allclose([got[k]["a"], got[k]["b"], got[k]["c"]], np.percentile(v, [10, 50, 95]))
    got = {r["k"]: r["b"] for r in quantiles.exact_percentiles(rows, ["k"], F.col("x") - 100, {"b": 0.5}, "index").collect()}
    for k, v in data.items():
        assert abs(got[k] - (sorted(v)[len(v) // 2] - 100)) < 1e-9

"""Metric golden values and brute-force comparisons."""
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics, ml, splits

T0 = datetime(2024, 1, 1)


def test_row_metrics(spark):
    df = spark.createDataFrame([(1, .9), (1, .4), (0, .8), (0, .1)], "label_value int, probability double")
    r = metrics.row_metrics(df).first()
    assert (r["precision"], r["recall"], r["f1"]) == (.5, .5, .5)
    assert r["pr_auc"] == pytest.approx((1 + 2 / 3) / 2)


def test_average_precision_with_ties(spark):
    rng = np.random.default_rng(1)
    p, y = np.round(rng.random(500), 2), (rng.random(500) < 0.3).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label_value int, probability double")
    want, tp, n = 0.0, 0, 0
    for s in sorted(set(p), reverse=True):
        hit = p == s
        tp, n = tp + y[hit].sum(), n + hit.sum()
        want += y[hit].sum() / y.sum() * tp / n
    assert metrics.row_metrics(df).first()["pr_auc"] == pytest.approx(want)


def test_event_metrics(spark):
    rows = [("r1", "e1", 1, 1, 1440.0), ("r2", "e1", 1, 1, 1440.0), ("r3", "e2", 1, 0, None), ("r4", None, 0, 1, None), ("r5", "e3", 0, 0, None)]
    df = spark.createDataFrame(rows, "prediction_id string, event_id string, label_value int, pred_value int, lead_time_minutes double")
    r = metrics.event_metrics(df).first()
    assert (r["event_recall"], r["event_precision"], r["lead_median"], r["n_events"]) == (.5, .5, 1440.0, 4)


def test_edge_rules_differ_at_the_edges(spark):
    df = spark.createDataFrame([(0.3,), (0.0,), (1.0,)], "p double")
    got = {e: [r[0] for r in df.select(metrics.bin_of(F.col("p"), 10, e)).collect()] for e in ("left", "floor", "right")}
    edges = np.linspace(0, 1, 11)
    assert got["left"] == [int(np.clip(np.searchsorted(edges, x, side="right") - 1, 0, 9)) for x in (0.3, 0.0, 1.0)]
    assert got["floor"] == [3, 0, 9]
    assert got["right"][1:] == [0, 9]


def test_performance(spark):
    rows = [(i, T0 + timedelta(hours=i), 1 if i < 7 else -1, .05 if i < 7 else -.02, .06, .01, 10) for i in range(10)]
    df = spark.createDataFrame(rows, "id int, entry_time timestamp, label int, raw_return double, mfe double, mae double, holding_bars int")
    r = metrics.performance(df, order=("entry_time", "id")).first()
    assert r["win_rate"] == .7 and r["profit_factor"] > 2 and .02 < r["expected_value"] < .05
    curve = np.cumprod([1 + x[3] - .0008 for x in rows])
    assert r["max_drawdown"] == pytest.approx((curve / np.maximum.accumulate(curve) - 1).min())


def test_threshold_sweep_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    p, y = np.round(rng.random(400), 2), (rng.random(400) < 0.4).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p)], "label_value int, probability double")
    grid = [(5 + i) / 100.0 for i in range(90)]
    for r in metrics.threshold_sweep(df, [], grid).collect():
        assert r["n_predicted"] == (p >= r["threshold"]).sum() and r["tp"] == y[p >= r["threshold"]].sum()


def test_psi_needs_enough_rows_and_sees_a_shift(spark):
    a = spark.createDataFrame([(float(i),) for i in range(200)], "x double")
    b = spark.createDataFrame([(float(i + 100),) for i in range(200)], "x double")
    few = spark.createDataFrame([(1.0,)], "x double")
    assert metrics.psi_quantile(a, a, [], "x").first()["psi"] == pytest.approx(0.0, abs=1e-9)
    assert metrics.psi_quantile(a, b, [], "x").first()["psi"] > 0.5
    assert metrics.psi_quantile(a, few, [], "x").first()["psi"] == 0.0


def test_bootstrap_covers_the_point_and_repeats(spark):
    cells = spark.createDataFrame([(1, 1, 60), (0, 1, 40), (1, 0, 10)], "actual int, predicted int, n bigint")
    stat = lambda d, x: (d @ (x["actual"] * x["predicted"])) / (d @ x["predicted"])
    a = metrics.bootstrap_interval(cells, "n", ["actual", "predicted"], stat).first()
    assert a["ci_lower"] < 0.6 < a["ci_upper"] and a["ci_upper"] - a["ci_lower"] < 0.3
    assert a == metrics.bootstrap_interval(cells.repartition(3), "n", ["actual", "predicted"], stat).first()


def test_fold_bounds(spark):
    plan = splits.walk_forward_plan(T0, T0 + timedelta(days=200))
    first = {s: (a, b) for f, s, a, b in plan if f == 0}
    assert first["train"] == (T0, T0 + timedelta(days=90))
    assert first["validation"] == (T0 + timedelta(days=91), T0 + timedelta(days=121))
    assert first["test"] == (T0 + timedelta(days=122), T0 + timedelta(days=152))
    starts = [a for f, s, a, b in plan if s == "train"]
    assert all(b - a == timedelta(days=30) for a, b in zip(starts, starts[1:]))
    assert splits.audit_plan(splits.plan_frame(spark, plan)).count() == 0
    bad = [*plan[:2], (0, "test", plan[1][3], plan[1][3] + timedelta(days=1))]
    assert splits.audit_plan(splits.plan_frame(spark, bad)).count() == 1


def test_training_uses_train_medians_and_refuses_answers(spark):
    rows = [(float(i % 10) if i % 4 else None, i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "x double, label_value int")
    med = ml.train_medians(df, ["x"])
    assert med["x"] == (float(np.median([r[0] for r in rows if r[0] is not None])), True)
    with pytest.raises(ValueError):
        ml.fit_classifier(df, ["label_value"])


def test_counted_intervals_are_those_of_a_plain_loop(spark):
    """Kinds with counts and single blocks give what a loop over the same md5 draws gives; nothing gives nulls."""
    import hashlib

    from tidemark.operators import resample
    kinds = [(0, 0, 11), (0, 1, 7), (1, 0, 4), (1, 1, 9)]
    values = [(a * p, p) for a, p, n in sorted(kinds) for _ in range(n)]

    def plain(values, reps, kind):
        n, out = len(values), []
        for b in range(reps):
            drawn = [values[int(hashlib.md5(f"42:{b}:{j}".encode()).hexdigest()[:15], 16) % n] for j in range(n)]
            if sum(x[1] for x in drawn):
                out.append(sum(x[0] for x in drawn) / sum(x[1] for x in drawn))
        out.sort()
        if kind == "index":
            return [out[min(int(len(out) * q), len(out) - 1)] for q in (0.025, 0.975)]
        at = [(len(out) - 1) * q for q in (0.025, 0.975)]
        return [out[int(x)] + (out[min(int(x) + 1, len(out) - 1)] - out[int(x)]) * (x - int(x)) for x in at]

    cells = spark.createDataFrame(kinds, "a int, p int, n long").selectExpr("a", "p", "n", "a * p AS tp")
    got = resample.counted_interval(cells, ["a", "p"], ["tp", "p"], resample.ratio_of("tp", "p"), replicates=200, count="n").first()
    assert (got["n"], round(got["point"], 12)) == (31, round(9 / 16, 12)) and [got["ci_lower"], got["ci_upper"]] == plain(values, 200, "index")
    days = [(d, (d * 7) % 5, 5) for d in range(12)]
    got = resample.counted_interval(spark.createDataFrame(days, "day int, tp int, p int"), ["day"], ["tp", "p"], resample.ratio_of("tp", "p"), replicates=300, kind="linear").first()
    assert all(abs(x - y) < 1e-12 for x, y in zip([got["ci_lower"], got["ci_upper"]], plain([x[1:] for x in days], 300, "linear")))
    none = resample.counted_interval(spark.createDataFrame([], "day int, tp int, p int"), ["day"], ["tp", "p"], resample.ratio_of("tp", "p"), replicates=20).first()
    assert tuple(none) == (0, None, None, None)


def test_grouped_calibration_over_many_blocks(spark):
    """Pools merged over blocks equal pooling at once; curves are stationary points; odd groups have no model."""
    import random

    from tidemark.operators import calibrate
    rng = random.Random(2)
    rows = [(g, round(rng.random(), 3), int(rng.random() < 0.2 + 0.3 * k)) for k, g in enumerate(["a", "b", None]) for _ in range(700)]
    rows += [("one", 0.25, 1), ("one", 0.75, 1), ("nolabel", 0.5, None), ("a", None, 1)]
    df = spark.createDataFrame(rows, "g string, probability double, label_value int")
    models = {r["g"]: [c.asDict() for c in r["pool"]] for r in calibrate.fit_isotonic_groups(df, ["g"], block_rows=32, fan=2).collect()}
    for g in ("a", "b", None, "one"):
        cells = {}
        for k, p, y in rows:
            if k == g and p is not None:
                n, pos = cells.get(p, (0, 0))
                cells[p] = (n + 1, pos + y)
        want = calibrate.pool([{"lo": x, "hi": x, "n": n, "pos": pos} for x, (n, pos) in sorted(cells.items())])
        assert models[g] == want
        shares = [c["pos"] / c["n"] for c in want]
        assert shares == sorted(shares) and sum(c["pos"] for c in want) == sum(pos for _, pos in cells.values())
    assert set(models) == {"a", "b", None, "one"}
    out = calibrate.apply_isotonic_groups(df, spark.createDataFrame([(g, m) for g, m in models.items()], "g string, pool array<struct<lo:double,hi:double,n:long,pos:long>>"), ["g"])
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        m = models.get(r["g"])
        if m and r["probability"] is not None:
            p = r["probability"]
            inside = [c for c in m if c["lo"] <= p <= c["hi"]]
            assert abs(r["calibrated"] - inside[0]["pos"] / inside[0]["n"]) < 1e-12
        else:
            assert r["calibrated"] is None
    curves = {r["g"]: r for r in calibrate.fit_platt_groups(df, ["g"]).collect()}
    assert set(curves) == {"a", "b", None}
    import math
    for g, r in curves.items():
        mine = [(p, y) for k, p, y in rows if k == g and p is not None]
        s = [1 / (1 + math.exp(-(r["a"] * p + r["b"]))) for p, _ in mine]
        assert abs(sum(q - y for q, (_, y) in zip(s, mine))) < 1e-7 and abs(sum((q - y) * p for q, (p, y) in zip(s, mine)) + r["a"]) < 1e-7


def test_gains_of_a_part_over_the_whole(spark):
    columns = "arm string, total_signals long, win_rate double, profit_factor double, expected_value_bps double"
    both = metrics.gains(spark.createDataFrame([("all", 10, 0.4, 1.5, 12.0), ("filtered", 4, 0.5, 2.0, 20.0)], columns), "all", "filtered").collect()
    assert [r["arm"] for r in both] == ["all", "filtered"]
    for r in both:
        assert (r["dropped_signals"], r["pass_rate"], r["ev_improvement_bps"], round(r["winrate_improvement_pct"], 9), r["profit_factor_improvement"]) == (6, 0.4, 8.0, 10.0, 0.5)
    alone = metrics.gains(spark.createDataFrame([("all", 10, 0.4, 1.5, 12.0)], columns), "all", "filtered").first()
    assert (alone["dropped_signals"], alone["pass_rate"], alone["ev_improvement_bps"]) == (10, 0.0, -12.0)
    assert metrics.gains(spark.createDataFrame([], columns), "all", "filtered").count() == 0

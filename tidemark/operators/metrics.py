"""Row, event, calibration, drift and performance metrics as aggregations."""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import elapsed_minutes, safe_div
from tidemark.operators.ordered import running_extreme, running_sum, with_scalar
from tidemark.operators.quantiles import exact_percentiles

ONE = "_one"


def _group(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """A constant key stands in for a missing grouping."""
    return (df, list(keys)) if keys else (df.withColumn(ONE, F.lit(1)), [ONE])


def _attach(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join two grouped results; without grouping ``b`` is one row and comes as a scalar."""
    if by == [ONE]:
        return with_scalar(a, b, *[c for c in b.columns if c != ONE])
    return a.join(b, by, how)


def ratio(num: Column, den: Column) -> Column:
    """Quotient that is 0 when undefined."""
    return F.coalesce(safe_div(num, den), F.lit(0.0))


def row_metrics(df: DataFrame, keys: Sequence[str] = (), *, label: str = "label_value", prob: str = "probability",
                threshold: float = 0.5) -> DataFrame:
    """Confusion counts, precision, recall, F1, FPR, Brier and average precision."""
    df, by = _group(df, keys)
    y, p = F.col(label).cast("int"), F.col(prob)
    scores = df.groupBy(*by, p.alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.sum(y).alias("_pos"),
                                                F.sum(F.pow(p - y, 2)).alias("_sq"))
    hit = F.col("_p") >= threshold
    base = scores.groupBy(*by).agg(
        F.sum("_n").alias("n_rows"), F.sum("_pos").alias("n_positive"),
        F.coalesce(F.sum(F.when(hit, F.col("_n"))), F.lit(0)).alias("n_predicted_positive"),
        F.coalesce(F.sum(F.when(hit, F.col("_pos"))), F.lit(0)).alias("tp"), F.sum("_sq").alias("_sq"))
    ap = average_precision(scores, by)
    out = _attach(base, ap, by)
    tp, n_pred, n_pos = F.col("tp"), F.col("n_predicted_positive"), F.col("n_positive")
    fp, fn = n_pred - tp, n_pos - tp
    precision, recall = ratio(tp, n_pred), ratio(tp, n_pos)
    both = (n_pos > 0) & (n_pos < F.col("n_rows"))
    return out.select(
        *[k for k in by if k != ONE], "n_rows", "n_positive", "n_predicted_positive", "tp", fp.alias("fp"), fn.alias("fn"),
        precision.alias("precision"), recall.alias("recall"),
        ratio(2 * precision * recall, precision + recall).alias("f1"),
        F.when(both, F.col("_ap")).otherwise(0.0).alias("pr_auc"),
        (F.col("_sq") / F.col("n_rows")).alias("brier_score"),
        ratio(fp, F.col("n_rows") - n_pos).alias("false_positive_rate"))


def average_precision(scores: DataFrame, by: list[str]) -> DataFrame:
    """Sum of precision times recall step over falling scores, ties as one step.

    ``scores`` has one row per (group, score) with ``_n`` and ``_pos``; the
    cumulative counts run over slices of each group's own score range, so
    scores packed into a narrow range are spread as well.
    """
    down = scores.withColumn("_neg", -F.col("_p"))
    ends = down.groupBy(*by).agg(F.min("_neg").alias("_low"), F.max("_neg").alias("_high"))
    down = _attach(down, ends, by)
    part = F.coalesce(F.floor(F.try_divide(F.col("_neg") - F.col("_low"), F.col("_high") - F.col("_low")) * 1024), F.lit(0))
    cum = running_sum(down, by, "_neg", ["_neg"], {"_cn": F.col("_n"), "_cp": F.col("_pos")}, slice_by=part)
    return cum.groupBy(*by).agg(
        F.coalesce(safe_div(F.sum(F.col("_pos") * F.col("_cp") / F.col("_cn")), F.sum("_pos")), F.lit(0.0)).alias("_ap"))


def bin_of(p: Column, bins: int = 10, edge: str = "left") -> Column:
    """Uniform bin: ``left`` is ``[lo, hi)`` by edges, ``floor`` is int(p*n), ``right`` is ``(lo, hi]``.

    ``left`` and ``right`` compare with the edges themselves, so a value equal
    to a rounded edge goes where the edge comparison says.
    """
    if edge == "floor":
        return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    edges = np.linspace(0.0, 1.0, bins + 1)[1:-1]
    above = sum(((p >= float(e)) if edge == "left" else (p > float(e))).cast("int") for e in edges)
    return above


def reliability(df: DataFrame, keys: Sequence[str] = (), *, label: str = "label_value", prob: str = "probability",
                bins: int = 10, edge: str = "left") -> DataFrame:
    p = F.col(prob)
    out = df.groupBy(*keys, bin_of(p, bins, edge).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_predicted"),
        F.avg(F.col(label).cast("double")).alias("fraction_positive"))
    return out.withColumns({"lower": F.col("bin") / bins, "upper": (F.col("bin") + 1) / bins})


def calibration_error(df: DataFrame, keys: Sequence[str] = (), **options) -> DataFrame:
    r = reliability(df, keys, **options)
    gap = F.abs(F.col("mean_predicted") - F.col("fraction_positive"))
    return r.groupBy(*keys).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def brier(df: DataFrame, keys: Sequence[str] = (), label: str = "label_value", prob: str = "probability") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.pow(F.col(prob) - F.col(label), 2)).alias("brier_score"))


def event_rows(df: DataFrame, keys: Sequence[str] = (), id_col: str = "prediction_id") -> DataFrame:
    """One row per event; a row without an event is its own event."""
    key = F.coalesce(F.col("event_id"), F.concat(F.lit("__unresolved_"), F.col(id_col)))
    return df.groupBy(*keys, key.alias("event_key")).agg(
        F.max("label_value").alias("actual"), F.max("pred_value").alias("predicted"),
        F.sum("pred_value").alias("predicted_rows"), F.count(F.lit(1)).alias("n_rows"))


def event_metrics(df: DataFrame, keys: Sequence[str] = (), id_col: str = "prediction_id") -> DataFrame:
    df, by = _group(df.where(F.col("label_value").isNotNull()), keys)
    e = event_rows(df, by, id_col)
    a, p = F.col("actual") == 1, F.col("predicted") == 1
    base = e.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(a).alias("n_true_events"), F.count_if(p).alias("n_predicted_events"),
        F.count_if(a & p).alias("tp"), F.sum("predicted_rows").alias("rows_hit"))
    lead = (F.coalesce(F.col("lead_time_minutes"), elapsed_minutes("signal_time", "target_time"))
            if "target_time" in df.columns else F.col("lead_time_minutes"))
    caught = df.where((F.col("pred_value") == 1) & (F.col("label_value") == 1)).withColumn("_lead", lead).where("_lead >= 0")
    q = exact_percentiles(caught, by, F.col("_lead"), {"lead_p25": 0.25, "lead_median": 0.5, "lead_p75": 0.75})
    out = _attach(base, q, by, "left")
    tp, fp = F.col("tp"), F.col("n_predicted_events") - F.col("tp")
    return out.select(
        *[k for k in by if k != ONE], "n_events", "n_true_events", "n_predicted_events",
        ratio(tp, F.col("n_predicted_events")).alias("event_precision"), ratio(tp, F.col("n_true_events")).alias("event_recall"),
        ratio(fp, F.col("n_true_events")).alias("false_alerts_per_event"),
        ratio(F.col("rows_hit") - F.col("n_predicted_events"), F.col("rows_hit")).alias("duplicate_ratio"),
        "lead_p25", "lead_median", "lead_p75")


def quantile_edges(reference: DataFrame, keys: Sequence[str], value: str, buckets: int = 10) -> DataFrame:
    """Inner bucket edges of the reference, one array per group."""
    points = {f"q{i}": i / buckets for i in range(buckets + 1)}
    q = exact_percentiles(reference, keys, F.col(value), points)
    distinct = F.array_distinct(F.array(*points))
    inner = F.when(F.size(distinct) > 1, F.slice(distinct, F.lit(2), F.size(distinct) - 2))
    return q.select(*keys, F.col("n_values").alias("n_reference"), inner.alias("edges"))


def psi_quantile(reference: DataFrame, current: DataFrame, keys: Sequence[str], value: str, *, buckets: int = 10,
                 eps: float = 1e-4) -> DataFrame:
    """Population stability index per group over the reference's quantile buckets.

    The edge table has one row per group and an array of at most nine numbers.
    """
    reference, by = _group(reference, keys)
    current = current if keys else current.withColumn(ONE, F.lit(1))
    edges = quantile_edges(reference, by, value, buckets)
    side = lambda df, s: df.select(*by, F.lit(s).alias("_side"), F.col(value).cast("double").alias("_x")).where(
        "_x IS NOT NULL AND NOT isnan(_x) AND abs(_x) < double('infinity')")
    both = _attach(side(reference, 0).unionByName(side(current, 1)), edges, by)
    cell = F.size(F.filter("edges", lambda e: F.col("_x") >= e))
    counts = (both.groupBy(*by, F.size("edges").alias("_m"), F.when(F.col("edges").isNotNull(), cell).alias("_cell"))
              .agg(F.count_if(F.col("_side") == 0).alias("_e"), F.count_if(F.col("_side") == 1).alias("_a")))
    cells = counts.groupBy(*by).agg(F.collect_list(F.struct("_cell", "_e", "_a")).alias("_rows"), F.max("_m").alias("_m"),
                                    F.sum("_e").alias("_ne"), F.sum("_a").alias("_na"))
    k = F.col("_m") + 1
    share = lambda c, n: (c + F.lit(eps)) / (n + F.lit(eps) * k)
    term = lambda e, a: (share(a, F.col("_na")) - share(e, F.col("_ne"))) * F.log(share(a, F.col("_na")) / share(e, F.col("_ne")))
    filled = F.aggregate("_rows", F.lit(0.0), lambda acc, r: acc + term(r["_e"], r["_a"]))
    # buckets empty on both sides
    empty = (k - F.size("_rows")) * term(F.lit(0), F.lit(0))
    enough = (F.col("_ne") >= buckets) & (F.col("_na") >= buckets) & (F.col("_m") >= 0)
    return cells.select(*[c for c in by if c != ONE], F.col("_ne").alias("n_reference"), F.col("_na").alias("n_current"),
                        F.when(enough, F.greatest(filled + empty, F.lit(0.0))).otherwise(0.0).alias("psi"))


def psi_fixed(reference: DataFrame, current: DataFrame, prob: str = "probability", *, bins: int = 10, floor: float = 1e-6,
              min_samples: int = 30, warning: float = 0.10, critical: float = 0.25) -> DataFrame:
    """Drift of probabilities on fixed bins, with its status; one row."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(prob).cast("double")))
    side = lambda df, s: df.where(F.col(prob).isNotNull()).select(
        F.lit(s).alias("_side"), F.least(F.lit(bins - 1), F.floor(p * bins)).alias("_cell"), F.col(prob).cast("double").alias("_x"))
    counts = side(reference, 0).unionByName(side(current, 1)).groupBy("_cell").agg(
        F.count_if(F.col("_side") == 0).alias("_r"), F.count_if(F.col("_side") == 1).alias("_c"),
        F.sum(F.when(F.col("_side") == 0, F.col("_x"))).alias("_sr"), F.sum(F.when(F.col("_side") == 1, F.col("_x"))).alias("_sc"))
    t = counts.agg(F.collect_list(F.struct("_r", "_c")).alias("_rows"), F.coalesce(F.sum("_r"), F.lit(0)).alias("n_reference"),
                   F.coalesce(F.sum("_c"), F.lit(0)).alias("n_current"), F.sum("_sr").alias("_sr"), F.sum("_sc").alias("_sc"))
    share = lambda c, n: F.greatest(F.lit(floor), F.try_divide(c.cast("double"), n))
    term = lambda r: ((share(r["_c"], F.col("n_current")) - share(r["_r"], F.col("n_reference")))
                      * F.log(share(r["_c"], F.col("n_current")) / share(r["_r"], F.col("n_reference"))))
    psi = F.aggregate("_rows", F.lit(0.0), lambda acc, r: acc + term(r))
    enough = (F.col("n_reference") >= min_samples) & (F.col("n_current") >= min_samples)
    t = t.withColumns({"psi": F.when(enough, psi), "mean_delta": F.when(
        enough, F.col("_sc") / F.col("n_current") - F.col("_sr") / F.col("n_reference"))})
    return t.select("n_reference", "n_current", "psi", "mean_delta",
                    F.when(F.col("psi").isNull(), "insufficient_data").when(F.col("psi") >= critical, "critical")
                    .when(F.col("psi") >= warning, "warning").otherwise("ok").alias("status"))


def drift_health(feature_psi: DataFrame, scores: DataFrame, *, psi_warning: float = 0.10, psi_critical: float = 0.20,
                 brier_critical: float = 0.22, ece_critical: float = 0.15) -> DataFrame:
    """Overall state from feature drift, Brier and calibration error (``scores`` has one row)."""
    worst = feature_psi.agg(F.coalesce(F.max("psi"), F.lit(0.0)).alias("max_psi"),
                            F.count_if(F.col("psi") >= psi_critical).alias("n_critical"),
                            F.count_if((F.col("psi") >= psi_warning) & (F.col("psi") < psi_critical)).alias("n_warning"))
    packed = scores.select(F.struct("brier_score", "ece")).scalar()
    t = worst.withColumn("_s", packed).select("*", "_s.*").drop("_s")
    critical = (F.col("n_critical") > 0) | (F.coalesce(F.col("brier_score") >= brier_critical, F.lit(False)))
    warn = (F.col("n_warning") > 0) | (F.coalesce(F.col("ece") >= ece_critical, F.lit(False)))
    return t.withColumn("status", F.when(critical, "CRITICAL").when(warn, "WARNING").otherwise("HEALTHY"))


def performance(trades: DataFrame, keys: Sequence[str] = (), *, fee_bps: float = 8.0, order: Sequence[str] = ("entry_time",)) -> DataFrame:
    """Win rate, profit factor, expected value after fees, risk ratios and drawdown."""
    trades, by = _group(trades, keys)
    t = trades.withColumn("_net", F.col("raw_return") - fee_bps / 10000.0)
    net, label = F.col("_net"), F.col("label")
    gain, loss = net > 0, net <= 0
    base = t.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(label == 1).alias("win_count"), F.count_if(label == -1).alias("loss_count"),
        F.count_if(label == 0).alias("expired_count"), F.coalesce(F.sum(F.when(gain, net)), F.lit(0.0)).alias("_sg"),
        F.coalesce(-F.sum(F.when(loss, net)), F.lit(0.0)).alias("_sl"), F.count_if(gain).alias("_ng"), F.count_if(loss).alias("_nl"),
        F.avg(net).alias("_mean"), F.stddev_pop(net).alias("_std"), F.stddev_pop(F.when(net < 0, net)).alias("_dstd"),
        F.count_if(net < 0).alias("_nd"), F.avg("mfe").alias("mfe_mean"), F.avg("mae").alias("mae_mean"),
        F.avg("holding_bars").alias("avg_holding_bars"))
    out = _attach(base, max_drawdown(t, by, "_net", order), by)
    n, ng, nl = F.col("n"), F.col("_ng"), F.col("_nl")
    avg_win, avg_loss = ratio(F.col("_sg"), ng), ratio(F.col("_sl"), nl)
    ev = ng / n * avg_win - (1 - ng / n) * avg_loss
    std = F.when(n > 1, F.col("_std")).otherwise(1e-4)
    dstd = F.when(F.col("_nd") > 1, F.col("_dstd")).otherwise(1e-4)
    scale = F.sqrt(F.least(n, F.lit(252)))
    return out.select(
        *[k for k in by if k != ONE], n.alias("total_signals"), "win_count", "loss_count", "expired_count",
        (F.col("win_count") / n).alias("win_rate"),
        F.when(F.col("_sl") > 1e-6, F.col("_sg") / F.col("_sl")).when(F.col("_sg") > 0, 99.0).otherwise(0.0).alias("profit_factor"),
        ev.alias("expected_value"), (ev * 10000.0).alias("expected_value_bps"), avg_win.alias("avg_win_return"),
        (-avg_loss).alias("avg_loss_return"), "mfe_mean", "mae_mean", (F.col("_mean") / (std + 1e-8) * scale).alias("sharpe_ratio"),
        (F.col("_mean") / (dstd + 1e-8) * scale).alias("sortino_ratio"), "max_drawdown", "avg_holding_bars")


def gains(summary: DataFrame, whole: str, part: str, key: str = "arm") -> DataFrame:
    """Add to the performance of two arms what the second, a part of the first, passes and gains; an arm without trades counts as zeros."""
    pick = lambda arm, c: F.coalesce(F.max(F.when(F.col(key) == arm, F.col(c))), F.lit(0))
    delta = lambda c: pick(part, c) - pick(whole, c)
    one = summary.agg((pick(whole, "total_signals") - pick(part, "total_signals")).alias("dropped_signals"),
                      F.try_divide(pick(part, "total_signals").cast("double"), pick(whole, "total_signals")).alias("pass_rate"),
                      delta("expected_value_bps").alias("ev_improvement_bps"), (delta("win_rate") * 100.0).alias("winrate_improvement_pct"),
                      delta("profit_factor").alias("profit_factor_improvement"))
    names = ("dropped_signals", "pass_rate", "ev_improvement_bps", "winrate_improvement_pct", "profit_factor_improvement")
    return with_scalar(summary, one, *names)


def max_drawdown(trades: DataFrame, keys: Sequence[str], net: str, order: Sequence[str], t: str = "entry_time") -> DataFrame:
    """Deepest fall of the compounded return curve below its running peak."""
    curve = running_sum(trades, list(keys), t, list(order), {"_log": F.log1p(F.col(net))})
    peak = running_extreme(curve, list(keys), t, list(order), F.col("_log"), "_peak")
    return peak.groupBy(*keys).agg(F.min(F.exp(F.col("_log") - F.col("_peak")) - 1).alias("max_drawdown"))


def engine_summary(trades: DataFrame, engine: str = "engine") -> DataFrame:
    """Hit and stop rates, excursions and the composite precision per engine."""
    n = F.count(F.lit(1))
    t = trades.groupBy(engine).agg(
        n.alias("total_signals"), F.count_if("hit_tp_4pct").alias("tp1_hits"), F.count_if("hit_tp_8pct").alias("tp2_hits"),
        F.count_if("hit_sl").alias("sl_breaches"), F.avg("mae").alias("avg_mae"), F.avg("mfe").alias("avg_mfe"))
    rate = lambda c: F.col(c) / F.col("total_signals")
    score = (rate("tp1_hits") * 60.0 + rate("tp2_hits") * 40.0 - rate("sl_breaches") * 30.0) * 100.0 / 70.0
    return t.withColumns({
        "tp1_hit_rate": rate("tp1_hits"), "tp2_hit_rate": rate("tp2_hits"), "sl_breach_rate": rate("sl_breaches"),
        "avg_risk_reward": F.col("avg_mfe") / F.when(F.col("avg_mae") > 0.005, F.col("avg_mae")).otherwise(0.005),
        "precision_score": F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))})


def threshold_drift(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups that were scored with more than one threshold."""
    return df.select(*keys, "threshold").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n_thresholds")).where("n_thresholds > 1")


def threshold_sweep(df: DataFrame, keys: Sequence[str], thresholds: Sequence[float], *, label: str = "label_value",
                    prob: str = "probability") -> DataFrame:
    """Precision and recall at each threshold of a rising grid.

    Each row falls into one grid cell; the counts at a threshold are the sums
    of the cells at or above it, so the data is read and shuffled once.
    """
    grid = sorted(thresholds)
    p = F.col(prob)
    df, by = _group(df, keys)
    values = F.array(*[F.lit(float(g)) for g in grid])
    # number of thresholds at or below p: a guess by the even step, then corrected by the edges
    step = (grid[-1] - grid[0]) / max(len(grid) - 1, 1)
    guess = F.greatest(F.lit(0), F.least(F.lit(len(grid)), F.floor((p - grid[0]) / step).cast("int") + 1))
    at = lambda i: F.try_element_at(values, i)
    cell = (F.when((guess < len(grid)) & (at(guess + 1) <= p), guess + 1)
            .when((guess > 0) & (at(F.greatest(guess, F.lit(1))) > p), guess - 1).otherwise(guess))
    counts = df.groupBy(*by, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("int")).alias("_pos"))
    total = Window.partitionBy(*by)
    above = Window.partitionBy(*by).orderBy(F.col("_cell").desc()).rangeBetween(Window.unboundedPreceding, 0)
    spark = df.sparkSession
    cells = spark.createDataFrame([(i + 1, float(g)) for i, g in enumerate(grid)], "_cell int, threshold double")
    groups = counts.select(*by).distinct().withColumn("_cells", F.sequence(F.lit(0), F.lit(len(grid)))).select(
        *by, F.explode("_cells").alias("_cell"))
    full = groups.join(counts, [*by, "_cell"], "left").fillna(0, ["_n", "_pos"])
    full = full.withColumns({"n_predicted": F.sum("_n").over(above), "tp": F.sum("_pos").over(above), "n_positive": F.sum("_pos").over(total)})
    # the grid has a fixed number of entries
    return full.join(F.broadcast(cells), "_cell").select(
        *[k for k in by if k != ONE], "threshold", "n_predicted", "tp", "n_positive", safe_div("tp", "n_predicted").alias("precision"),
        ratio(F.col("tp"), F.col("n_positive")).alias("recall"))


def best_precision_threshold(sweep: DataFrame, keys: Sequence[str] = (), min_recall: float = 0.5) -> DataFrame:
    """Threshold of the highest precision with enough recall, else of the highest precision; the lowest wins ties."""
    order = F.struct("precision", -F.col("threshold"))
    usable = F.col("n_predicted") > 0
    ok = usable & (F.col("recall") >= min_recall)
    out = sweep.groupBy(*keys).agg(F.max_by("threshold", F.when(ok, order)).alias("_a"), F.max_by("threshold", F.when(usable, order)).alias("_b"))
    return out.select(*keys, F.coalesce("_a", "_b", F.lit(0.5)).alias("threshold"))


def best_f1_threshold(sweep: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    f1 = ratio(2 * F.coalesce("precision", F.lit(0.0)) * F.col("recall"), F.coalesce("precision", F.lit(0.0)) + F.col("recall"))
    s = sweep.withColumn("_f1", f1)
    return s.groupBy(*keys).agg(F.max_by("threshold", F.struct("_f1", -F.col("threshold"))).alias("threshold"), F.max("_f1").alias("f1"))


def bootstrap_interval(cells: DataFrame, counts: str, stats: Sequence[str], statistic, *, iterations: int = 1000, level: float = 0.95,
                       seed: int = 42, interpolate: bool = False) -> DataFrame:
    """Interval of a statistic under resampling with replacement.

    ``cells`` holds the distinct observations and how often each occurs.
    Drawing n rows with replacement is a multinomial draw over the cells, so
    a replicate costs the number of cells, not the number of rows.  The
    replicates are spread over tasks and seeded by their number.
    ``statistic`` maps (draws x cells, {name: cell values}) to one number each.
    """
    spark = cells.sparkSession
    packed = cells.agg(F.sort_array(F.collect_list(F.struct(*[F.col(s).cast("double").alias(s) for s in stats],
                                                            F.col(counts).cast("bigint").alias("n")))).alias("cells"))
    reps = spark.range(iterations).withColumn("_c", packed.scalar())

    def draw(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            rows = pdf["_c"].iloc[0]
            n = np.array([r["n"] for r in rows], dtype=np.int64) if rows is not None else np.zeros(0, np.int64)
            if n.sum() == 0:
                continue
            values = {s: np.array([r[s] for r in rows], dtype=float) for s in stats}
            draws = np.stack([np.random.default_rng([seed, int(i)]).multinomial(n.sum(), n / n.sum()) for i in pdf["id"]])
            yield pd.DataFrame({"id": pdf["id"], "value": statistic(draws, values).astype(float)})

    values = reps.mapInPandas(draw, "id long, value double")
    tail = (1.0 - level) / 2.0
    if interpolate:
        return exact_percentiles(values, (), F.col("value"), {"ci_lower": tail, "ci_upper": 1 - tail}).select("ci_lower", "ci_upper")
    return exact_percentiles(values, (), F.col("value"), {"ci_lower": tail, "ci_upper": 1 - tail}, "index").select("ci_lower", "ci_upper")

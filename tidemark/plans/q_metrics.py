"""Queries of the metrics, drift, baseline and bootstrap operators."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemark.functions.columns import with_exprs
from tidemark.operators import features, metrics, ordered, resample, scoring
from tidemark.operators.quantiles import exact_percentiles
from tidemark.plans.q_labels import BARRIER, STOPS, moved, stop_outcomes
from tidemark.plans.q_timeline import SCORED_VIEW, scored
from tidemark.plans.registry import query
from tidemark.sources.tables import materialize
from tidemark.plans.views import Views

AP = """(SELECT {k} sum(pos * cp / cn) / nullif(sum(pos), 0) AS ap FROM (SELECT *, sum(n) OVER (PARTITION BY {g} ORDER BY probability DESC) AS cn,
    sum(pos) OVER (PARTITION BY {g} ORDER BY probability DESC) AS cp FROM (SELECT {k} probability, count(*) AS n, sum(label_value)::DOUBLE AS pos
      FROM judged GROUP BY ALL)) {gb})"""

ROW_SQL = """
  SELECT {k} n_rows, n_positive, n_predicted_positive, tp, n_predicted_positive - tp AS fp, n_positive - tp AS fn,
    coalesce(tp / nullif(n_predicted_positive, 0), 0) AS precision, coalesce(tp / nullif(n_positive, 0), 0) AS recall,
    coalesce(2 * tp / nullif(n_predicted_positive + n_positive, 0), 0) AS f1, CASE WHEN n_positive > 0 AND n_positive < n_rows THEN ap ELSE 0 END AS pr_auc, brier_score,
    coalesce((n_predicted_positive - tp) / nullif(n_rows - n_positive, 0), 0) AS false_positive_rate
  FROM (SELECT {k} count(*) AS n_rows, sum(label_value)::DOUBLE AS n_positive, count(*) FILTER (probability >= 0.55)::DOUBLE AS n_predicted_positive,
      count(*) FILTER (probability >= 0.55 AND label_value = 1)::DOUBLE AS tp, avg((probability - label_value) ** 2) AS brier_score FROM judged {gb}) {join}"""
ROW_F = "precision recall f1 pr_auc brier_score false_positive_rate"
ROW_I = "n_rows n_positive n_predicted_positive tp fp fn"


@query("met_row", ROW_SQL.format(k="", gb="", join=", " + AP.format(k="", g="1", gb="") + " AS a"), floats=ROW_F, ints=ROW_I)
def _row(v: Views):
    return metrics.row_metrics(v.judged, threshold=0.55)


@query("met_row_by_model", ROW_SQL.format(k="model_id,", gb="GROUP BY model_id", join="JOIN " + AP.format(
    k="model_id,", g="model_id", gb="GROUP BY model_id") + " AS a USING (model_id)"), floats=ROW_F, ints=ROW_I)
def _row_model(v: Views):
    return metrics.row_metrics(v.judged, ["model_id"], threshold=0.55)


@query("met_brier", "SELECT model_id, avg((probability - label_value) ** 2) AS brier_score FROM judged GROUP BY model_id", floats="brier_score")
def _brier(v: Views):
    return metrics.brier(v.judged, ["model_id"])


@query("met_reliability", """
  SELECT least(floor(probability * 10), 9) AS bin, count(*) AS n, avg(probability) AS mean_predicted, avg(label_value) AS fraction_positive,
    least(floor(probability * 10), 9) / 10 AS lower, (least(floor(probability * 10), 9) + 1) / 10 AS upper FROM judged GROUP BY 1""",
       floats="mean_predicted fraction_positive lower upper", ints="bin n")
def _reliability(v: Views):
    return metrics.reliability(v.judged, edge="floor")


def _ece_sql(expr: str) -> str:
    return f"""SELECT sum(n * abs(c - a)) / sum(n) FROM (SELECT {expr} AS b, count(*) AS n, avg(probability) AS c, avg(label_value) AS a FROM judged GROUP BY 1)"""


EDGES = [float(e) for e in np.linspace(0, 1, 11)[1:-1]]


@query("met_ece", f"""
  SELECT 'left' AS edge, ({_ece_sql(' + '.join(f'(probability >= {e!r}::DOUBLE)::INT' for e in EDGES))}) AS ece UNION ALL
  SELECT 'floor', ({_ece_sql('least(floor(probability * 10), 9)')}) UNION ALL
  SELECT 'right', ({_ece_sql(' + '.join(f'(probability > {e!r}::DOUBLE)::INT' for e in EDGES))})""", floats="ece")
def _ece(v: Views):
    """All three edge rules in one read: each row gets its three bins."""
    j = v.judged.select("probability", "label_value")
    p = F.col("probability")
    long = j.select("probability", "label_value", F.explode(F.array(*[
        F.struct(F.lit(e).alias("edge"), metrics.bin_of(p, 10, e).alias("bin")) for e in ("left", "floor", "right")])).alias("_e"))
    r = long.groupBy("_e.edge", "_e.bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("c"), F.avg("label_value").alias("a"))
    return r.groupBy("edge").agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))


@query("met_calibration_report", """
  SELECT kind, brier_score, ece FROM (SELECT 'raw' AS kind, avg((probability - label_value) ** 2) AS brier_score FROM judged UNION ALL
      SELECT 'calibrated', avg((least(greatest(probability * 0.6 - 0.1, 0), 1) - label_value) ** 2) FROM judged)
  JOIN (SELECT kind, sum(n * abs(c - a)) / sum(n) AS ece FROM (SELECT kind, least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS c, avg(label_value) AS a
      FROM (SELECT 'raw' AS kind, probability AS p, label_value FROM judged UNION ALL SELECT 'calibrated', least(greatest(probability * 0.6 - 0.1, 0), 1), label_value
        FROM judged) GROUP BY ALL) GROUP BY kind) USING (kind)""", floats="brier_score ece")
def _calibration(v: Views):
    j = v.judged.select("label_value", F.explode(F.expr(
        "array(struct('raw' AS kind, probability AS p), struct('calibrated' AS kind, least(greatest(probability * 0.6D - 0.1D, 0D), 1D) AS p))")).alias("s"))
    j = j.select("label_value", "s.kind", F.col("s.p").alias("probability"))
    return metrics.brier(j, ["kind"]).join(metrics.calibration_error(j, ["kind"], edge="floor"), "kind")


EVENT_SQL = """
  SELECT {k} n_events, n_true_events, n_predicted_events, coalesce(tp / nullif(n_predicted_events, 0), 0) AS event_precision,
    coalesce(tp / nullif(n_true_events, 0), 0) AS event_recall, coalesce((n_predicted_events - tp) / nullif(n_true_events, 0), 0) AS false_alerts_per_event,
    coalesce((rows_hit - n_predicted_events) / nullif(rows_hit, 0), 0) AS duplicate_ratio, q[1] AS lead_p25, q[2] AS lead_median, q[3] AS lead_p75
  FROM (SELECT {k} count(*)::DOUBLE AS n_events, count(*) FILTER (a = 1)::DOUBLE AS n_true_events, count(*) FILTER (p = 1)::DOUBLE AS n_predicted_events,
      count(*) FILTER (a = 1 AND p = 1)::DOUBLE AS tp, sum(s)::DOUBLE AS rows_hit FROM (SELECT {k} coalesce(event_id, '__' || prediction_id) AS ek, max(label_value) AS a,
        max(pred_value) AS p, sum(pred_value) AS s FROM judged GROUP BY ALL) {gb}) {join}"""
LEAD = "(SELECT {k} quantile_cont(lead_time_minutes, [0.25, 0.5, 0.75]) AS q FROM judged WHERE pred_value = 1 AND label_value = 1 {gb})"
EV_F = "event_precision event_recall false_alerts_per_event duplicate_ratio lead_p25 lead_median lead_p75"
EV_I = "n_events n_true_events n_predicted_events"


@query("met_event", EVENT_SQL.format(k="", gb="", join=", " + LEAD.format(k="", gb="") + " AS l"), floats=EV_F, ints=EV_I)
def _event(v: Views):
    return metrics.event_metrics(v.judged)


@query("met_binary_by_model", EVENT_SQL.format(k="model_id,", gb="GROUP BY model_id", join="LEFT JOIN " + LEAD.format(
    k="model_id,", gb="GROUP BY model_id") + " AS l USING (model_id)"), floats=EV_F, ints=EV_I)
def _event_model(v: Views):
    return metrics.event_metrics(v.judged, ["model_id"])


@query("met_threshold_drift", """
  SELECT model_id, count(DISTINCT t) AS n_thresholds FROM (SELECT model_id, CASE WHEN model_id = 'm_odd' AND cell % 7 = 0 THEN 0.6 ELSE 0.55 END AS t FROM judged)
  GROUP BY model_id HAVING count(DISTINCT t) > 1""")
def _drift(v: Views):
    j = v.judged.withColumn("threshold", F.expr("CASE WHEN model_id = 'm_odd' AND cell % 7 = 0 THEN 0.6D ELSE 0.55D END"))
    return metrics.threshold_drift(j, ["model_id"])


# Feature drift: the older half of the time against the newer, three columns.
PSI = {"longf": """
  SELECT f, x, h FROM (SELECT unnest(['close', 'volume', 'trades']) AS f, unnest([close, volume_base, trade_count::DOUBLE]) AS x, cell < mid AS h FROM bars_1h, (SELECT (min(cell) + max(cell)) // 2 AS mid FROM bars_1h))""",
       "edges": """
  SELECT f, list_sort(list_distinct(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM longf WHERE h GROUP BY f""",
       "bins": """
  SELECT f, len(e) - 1 AS k, b, count(*) FILTER (h) AS ne, count(*) FILTER (NOT h) AS na FROM (
    SELECT l.f, e, h, len(list_filter(e[2:len(e) - 1], lambda z: x >= z)) AS b FROM longf l JOIN edges USING (f)) GROUP BY ALL""",
       "psi": """
  SELECT f, max(tn) AS n_reference, max(ta) AS n_current, greatest(sum((a - r) * ln(a / r)), 0) AS psi FROM (
    SELECT *, (ne + 1e-4) / (tn + 1e-4 * k) AS r, (na + 1e-4) / (ta + 1e-4 * k) AS a FROM (
      SELECT *, sum(ne) OVER (PARTITION BY f) AS tn, sum(na) OVER (PARTITION BY f) AS ta FROM bins)) GROUP BY f"""}


def older(df):
    """Whether a row's cell (column ``h``) lies in the older half of the cells' range."""
    return ordered.with_scalar(df, df.agg(F.expr("(min(cell) + max(cell)) DIV 2").alias("_mid")), "_mid").withColumn("h", F.expr("cell < _mid")).drop("_mid")


def long_features(v: Views):
    return older(v.bars_1h).selectExpr("h", "stack(3, 'close', close, 'volume', volume_base, 'trades', CAST(trade_count AS DOUBLE)) AS (f, x)")


def feature_psi(v: Views):
    lf = long_features(v)
    return metrics.psi_quantile(lf.where("h"), lf.where("NOT h"), ["f"], "x")


@query("met_psi_quantile", "SELECT * FROM psi", views=PSI, floats="psi", ints="n_reference n_current")
def _psi(v: Views):
    return feature_psi(v)


@query("met_psi_fixed", """
  SELECT tn AS n_reference, ta AS n_current, psi, mean_delta, CASE WHEN psi >= 0.25 THEN 'critical' WHEN psi >= 0.10 THEN 'warning' ELSE 'ok' END AS status
  FROM (SELECT max(tn) AS tn, max(ta) AS ta, sum((a - r) * ln(a / r)) AS psi FROM (SELECT tn, ta, greatest(1e-6, ne / tn) AS r, greatest(1e-6, na / ta) AS a
      FROM (SELECT *, sum(ne) OVER () AS tn, sum(na) OVER () AS ta FROM (SELECT least(9, floor(probability * 10)) AS b,
        count(*) FILTER (h)::DOUBLE AS ne, count(*) FILTER (NOT h)::DOUBLE AS na FROM halves GROUP BY 1)))),
    (SELECT avg(probability) FILTER (NOT h) - avg(probability) FILTER (h) AS mean_delta FROM halves)""",
       views={"halves": "SELECT probability, cell < mid AS h FROM predictions, (SELECT (min(cell) + max(cell)) // 2 AS mid FROM predictions)"},
       floats="psi mean_delta", ints="n_reference n_current")
def _psi_fixed(v: Views):
    p = older(v.rule_probs.selectExpr("probability", "unix_micros(signal_time) DIV 3600000000L AS cell"))
    return metrics.psi_fixed(p.where("h"), p.where("NOT h"))


@query("met_drift_health", """
  SELECT max_psi, n_critical, n_warning, brier_score, ece, CASE WHEN n_critical > 0 OR brier_score >= 0.22 THEN 'CRITICAL' WHEN n_warning > 0 OR ece >= 0.15 THEN 'WARNING'
    ELSE 'HEALTHY' END AS status
  FROM (SELECT coalesce(max(psi), 0) AS max_psi, count(*) FILTER (psi >= 0.2) AS n_critical, count(*) FILTER (psi >= 0.1 AND psi < 0.2) AS n_warning FROM psi),
    (SELECT avg((probability - label_value) ** 2) AS brier_score FROM judged),
    (""" + _ece_sql(' + '.join(f'(probability > {e!r}::DOUBLE)::INT' for e in EDGES)).replace("SELECT sum(n * abs(c - a)) / sum(n)", "SELECT sum(n * abs(c - a)) / sum(n) AS ece") + ")",
       views=PSI, floats="max_psi brier_score ece")
def _health(v: Views):
    j = v.judged
    s = metrics.brier(j).withColumn("ece", metrics.calibration_error(j, edge="right").scalar())
    return metrics.drift_health(feature_psi(v), s)


PERF_SQL = """
  SELECT n AS total_signals, wc AS win_count, lc AS loss_count, ec AS expired_count, wc / n AS win_rate,
    CASE WHEN sl > 1e-6 THEN sg / sl WHEN sg > 0 THEN 99.0 ELSE 0 END AS profit_factor, ng / n * coalesce(sg / nullif(ng, 0), 0) - (1 - ng / n) * coalesce(sl / nullif(nl, 0), 0) AS expected_value,
    10000 * (ng / n * coalesce(sg / nullif(ng, 0), 0) - (1 - ng / n) * coalesce(sl / nullif(nl, 0), 0)) AS expected_value_bps,
    coalesce(sg / nullif(ng, 0), 0) AS avg_win_return, -coalesce(sl / nullif(nl, 0), 0) AS avg_loss_return, mfe_mean, mae_mean,
    m / (sd + 1e-8) * sqrt(least(n, 252)) AS sharpe_ratio, m / (CASE WHEN nd > 1 THEN dsd ELSE 1e-4 END + 1e-8) * sqrt(least(n, 252)) AS sortino_ratio, max_drawdown, avg_holding_bars
  FROM (SELECT count(*)::DOUBLE AS n, count(*) FILTER (label = 1) AS wc, count(*) FILTER (label = -1) AS lc, count(*) FILTER (label = 0) AS ec,
      coalesce(sum(r) FILTER (r > 0), 0) AS sg, coalesce(-sum(r) FILTER (r <= 0), 0) AS sl, count(*) FILTER (r > 0)::DOUBLE AS ng, count(*) FILTER (r <= 0) AS nl,
      avg(r) AS m, stddev_pop(r) AS sd, stddev_pop(r) FILTER (r < 0) AS dsd, count(*) FILTER (r < 0) AS nd, avg(mfe) AS mfe_mean, avg(mae) AS mae_mean, avg(holding_bars) AS avg_holding_bars
    FROM (SELECT *, raw_return - 0.0008 AS r FROM moved)),
  (SELECT min(exp(c - p) - 1) AS max_drawdown FROM (SELECT c, max(c) OVER (ORDER BY entry_time, signal_id) AS p FROM (
    SELECT entry_time, signal_id, sum(ln(1 + raw_return - 0.0008)) OVER (ORDER BY entry_time, signal_id) AS c FROM moved)))"""
PERF_F = ("win_rate profit_factor expected_value expected_value_bps avg_win_return avg_loss_return mfe_mean mae_mean sharpe_ratio sortino_ratio "
          "max_drawdown avg_holding_bars")


@query("met_performance", PERF_SQL, views=BARRIER, floats=PERF_F, ints="total_signals win_count loss_count expired_count")
def _performance(v: Views):
    return metrics.performance(moved(v), order=("entry_time", "signal_id"))


@query("win_max_drawdown", """
  SELECT symbol, min(exp(c - p) - 1) AS max_drawdown FROM (SELECT symbol, c, max(c) OVER (PARTITION BY symbol ORDER BY entry_time, signal_id) AS p FROM (
    SELECT symbol, entry_time, signal_id, sum(ln(1 + raw_return)) OVER (PARTITION BY symbol ORDER BY entry_time, signal_id) AS c FROM moved)) GROUP BY symbol""",
       views=BARRIER, floats="max_drawdown")
def _drawdown(v: Views):
    from tidemark.plans.q_labels import trades
    return metrics.max_drawdown(trades(v), ["symbol"], "raw_return", ["entry_time", "signal_id"])


# Two engines: all signals after a fall in price, and those near the high.
ENGINE_SQL = """
  SELECT engine, n AS total_signals, tp1 AS tp1_hits, tp2 AS tp2_hits, sl AS sl_breaches, mae AS avg_mae, mfe AS avg_mfe, tp1 / n AS tp1_hit_rate, tp2 / n AS tp2_hit_rate,
    sl / n AS sl_breach_rate, mfe / CASE WHEN mae > 0.005 THEN mae ELSE 0.005 END AS avg_risk_reward,
    greatest(0, least(100, (tp1 / n * 60 + tp2 / n * 40 - sl / n * 30) * 100 / 70)) AS precision_score
  FROM (SELECT engine, count(*)::DOUBLE AS n, count(*) FILTER (hit_tp_4pct) AS tp1, count(*) FILTER (hit_tp_8pct) AS tp2, count(*) FILTER (hit_sl) AS sl, avg(mae) AS mae, avg(mfe) AS mfe
    FROM (SELECT s.*, unnest(CASE WHEN r.probability >= 0.6 THEN ['v1', 'v2'] ELSE ['v1'] END) AS engine FROM stops s JOIN rule_probs r USING (symbol, signal_time) WHERE r.probability >= 0.5)
    GROUP BY engine)"""


@query("met_engine_compare", ENGINE_SQL, views=STOPS, ints="total_signals tp1_hits tp2_hits sl_breaches",
       floats="avg_mae avg_mfe tp1_hit_rate tp2_hit_rate sl_breach_rate avg_risk_reward precision_score")
def _engines(v: Views):
    r = v.rule_probs.where("probability >= 0.5").select("symbol", "signal_time", "probability")
    t = stop_outcomes(v).join(r, ["symbol", "signal_time"]).withColumn("engine", F.expr(
        "explode(CASE WHEN probability >= 0.6D THEN array('v1', 'v2') ELSE array('v1') END)"))
    return metrics.engine_summary(t)


@query("met_benchmark_detail", """
  SELECT b.*, s.p50_mae, s.p90_mae, s.p50_mfe, s.p90_mfe FROM (
    SELECT count(*) AS n, avg(hit_tp_3pct::INT) AS tp3, avg(hit_tp_4pct::INT) AS tp4, avg(hit_tp_6pct::INT) AS tp6, avg(hit_tp_8pct::INT) AS tp8, avg(hit_tp_12pct::INT) AS tp12,
      avg(hit_sl::INT) AS sl, avg(mae) AS avg_mae, avg(mfe) AS avg_mfe, coalesce(sum(net_pnl) FILTER (net_pnl > 0), 0) / coalesce(-sum(net_pnl) FILTER (net_pnl < 0), 0.0001) AS profit_factor,
      avg(net_pnl) AS avg_pnl, count(*) FILTER (mfe >= 0.1) AS n_extreme, coalesce(avg(hit_tp_4pct::INT) FILTER (mfe >= 0.1), 0) AS extreme_rate FROM stops) b,
  (SELECT max(mae) FILTER (ra = n // 2) AS p50_mae, max(mae) FILTER (ra = floor(n * 0.9::DOUBLE)) AS p90_mae, max(mfe) FILTER (rf = n // 2) AS p50_mfe,
      max(mfe) FILTER (rf = floor(n * 0.9::DOUBLE)) AS p90_mfe FROM (SELECT mae, mfe, row_number() OVER (ORDER BY mae) - 1 AS ra, row_number() OVER (ORDER BY mfe) - 1 AS rf,
      count(*) OVER () AS n FROM stops)) s""", views=STOPS,
       floats="tp3 tp4 tp6 tp8 tp12 sl avg_mae avg_mfe profit_factor avg_pnl extreme_rate p50_mae p90_mae p50_mfe p90_mfe", ints="n n_extreme")
def _benchmark(v: Views):
    t = stop_outcomes(v)
    rate = lambda c: f"avg(CAST({c} AS INT))"
    aggs = ["count(1) AS n", *[f"{rate(f'hit_tp_{x}pct')} AS tp{x}" for x in (3, 4, 6, 8, 12)], f"{rate('hit_sl')} AS sl", "avg(mae) AS avg_mae", "avg(mfe) AS avg_mfe",
            "coalesce(sum(net_pnl) FILTER (WHERE net_pnl > 0), 0D) / coalesce(-sum(net_pnl) FILTER (WHERE net_pnl < 0), 0.0001D) AS profit_factor",
            "avg(net_pnl) AS avg_pnl", "count_if(mfe >= 0.1D) AS n_extreme", "coalesce(avg(CAST(hit_tp_4pct AS INT)) FILTER (WHERE mfe >= 0.1D), 0D) AS extreme_rate"]
    base = t.agg(*[F.expr(a) for a in aggs])
    long = t.selectExpr("stack(2, 'mae', mae, 'mfe', mfe) AS (what, x)")
    q = exact_percentiles(long, ["what"], F.col("x"), {"p50": 0.5, "p90": 0.9}, "index")
    q = q.agg(*[F.expr(f"max(p{a}) FILTER (WHERE what = '{w}') AS p{a}_{w}") for w in ("mae", "mfe") for a in (50, 90)])
    return ordered.with_scalar(base, q, "p50_mae", "p90_mae", "p50_mfe", "p90_mfe")


def newest_third(df, t: str, out: str):
    """Whether a row lies in the newest third of the table's time."""
    span = df.agg(F.expr(f"min(unix_micros({t})) + (max(unix_micros({t})) - min(unix_micros({t}))) * 2 DIV 3").alias("_from"))
    return ordered.with_scalar(df, span, "_from").withColumn(out, F.unix_micros(t) >= F.col("_from")).drop("_from")


@query("met_frozen_eval", """
  SELECT n_rows, precision, recall, brier_score, precision_train, recall_train, recall - recall_train AS recall_delta, abs(precision - precision_train) > 0.1 AS drifted FROM (
    SELECT count(*) FILTER (fwd) AS n_rows, coalesce(count(*) FILTER (fwd AND pred_value = 1 AND label_value = 1)::DOUBLE / nullif(count(*) FILTER (fwd AND pred_value = 1), 0), 0) AS precision,
      coalesce(count(*) FILTER (fwd AND pred_value = 1 AND label_value = 1)::DOUBLE / nullif(count(*) FILTER (fwd AND label_value = 1), 0), 0) AS recall,
      avg((probability - label_value) ** 2) FILTER (fwd) AS brier_score,
      coalesce(count(*) FILTER (NOT fwd AND pred_value = 1 AND label_value = 1)::DOUBLE / nullif(count(*) FILTER (NOT fwd AND pred_value = 1), 0), 0) AS precision_train,
      coalesce(count(*) FILTER (NOT fwd AND pred_value = 1 AND label_value = 1)::DOUBLE / nullif(count(*) FILTER (NOT fwd AND label_value = 1), 0), 0) AS recall_train
    FROM (SELECT j.*, epoch_us(signal_time) >= lo + wide * 2 // 3 AS fwd FROM judged j, (SELECT min(epoch_us(signal_time)) AS lo, max(epoch_us(signal_time)) - min(epoch_us(signal_time)) AS wide FROM judged)))""",
       floats="precision recall brier_score precision_train recall_train recall_delta")
def _frozen(v: Views):
    """Figures of the newest third of the time against those of the rows before it."""
    j = newest_third(v.judged, "signal_time", "fwd")
    hit = "pred_value = 1 AND label_value = 1"
    div = lambda a, b: f"coalesce(try_divide(count_if({a}), count_if({b})), 0D)"
    t = j.agg(*[F.expr(e) for e in (
        "count_if(fwd) AS n_rows", f"{div(f'fwd AND {hit}', 'fwd AND pred_value = 1')} AS precision",
        f"{div(f'fwd AND {hit}', 'fwd AND label_value = 1')} AS recall", "avg(pow(probability - label_value, 2)) FILTER (WHERE fwd) AS brier_score",
        f"{div(f'NOT fwd AND {hit}', 'NOT fwd AND pred_value = 1')} AS precision_train", f"{div(f'NOT fwd AND {hit}', 'NOT fwd AND label_value = 1')} AS recall_train")])
    return with_exprs(t, recall_delta="recall - recall_train", drifted="abs(precision - precision_train) > 0.1D")


BASE = {"base": """
  SELECT l.symbol, l.signal_time, l.label_value, f.price_ret_4h, f.funding_percentile_7d, f.oi_change_4h FROM labels_24 l
  JOIN features f ON f.symbol = l.symbol AND f.feature_time = l.signal_time WHERE l.label_value IS NOT NULL""",
        "preds": " UNION ALL ".join(
            [f"SELECT 'B1_price_ret_{t}' AS baseline, price_ret_4h > {t} AS p, label_value FROM base WHERE price_ret_4h IS NOT NULL" for t in ("0.0", "0.02", "0.05")]
            + [f"SELECT 'B2_funding_{t}', funding_percentile_7d > {t}, label_value FROM base WHERE funding_percentile_7d IS NOT NULL" for t in ("0.5", "0.8", "0.9")]
            + ["SELECT 'B3_oi_0.01', oi_change_4h > 0.01, label_value FROM base",
               "SELECT 'B4_funding_oi', funding_percentile_7d > 0.5 AND oi_change_4h > 0.0, label_value FROM base WHERE funding_percentile_7d IS NOT NULL"])}


def labelled_features(v: Views, groups=("price", "funding", "oi")):
    f = features.build_features(v.timeline, groups).withColumnRenamed("feature_time", "signal_time")
    lab = v.labels.where("label_value IS NOT NULL").select("symbol", "signal_time", "label_value")
    return f.join(lab, ["symbol", "signal_time"])


@query("met_rule_baselines", """
  SELECT baseline, count(*) AS n, coalesce(count(*) FILTER (p AND label_value = 1)::DOUBLE / nullif(count(*) FILTER (p), 0), 0) AS precision,
    coalesce(count(*) FILTER (p AND label_value = 1)::DOUBLE / nullif(count(*) FILTER (label_value = 1), 0), 0) AS recall, avg(abs(p::INT - label_value)) AS brier
  FROM preds GROUP BY baseline""", views=BASE, floats="precision recall brier")
def _baselines(v: Views):
    g = baseline_counts(v)
    return g.select("baseline", "n", metrics.ratio(F.col("tp"), F.col("np")).alias("precision"), metrics.ratio(F.col("tp"), F.col("pos")).alias("recall"), "brier")


def baseline_counts(v: Views):
    """Counts of the rule baselines over the labelled rows on which each is defined."""
    rules = ([(f"B1_price_ret_{t}", f"price_ret_4h > {t}D") for t in ("0.0", "0.02", "0.05")]
             + [(f"B2_funding_{t}", f"funding_percentile_7d > {t}D") for t in ("0.5", "0.8", "0.9")]
             + [("B3_oi_0.01", "oi_change_4h > 0.01D"), ("B4_funding_oi", "CASE WHEN funding_percentile_7d IS NOT NULL THEN funding_percentile_7d > 0.5D AND oi_change_4h > 0D END")])
    arms = ", ".join(f"struct('{n}' AS baseline, {e} AS p)" for n, e in rules)
    long = labelled_features(v).selectExpr("label_value", f"inline(array({arms}))").where("p IS NOT NULL")
    return long.groupBy("baseline").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("p AND label_value = 1")).alias("tp"), F.count_if("p").alias("np"),
                                        F.count_if(F.col("label_value") == 1).alias("pos"), F.avg(F.abs(F.col("p").cast("int") - F.col("label_value"))).alias("brier"))


@query("met_rule_baseline_random", "SELECT count(*) AS n, avg(label_value) AS prevalence, TRUE AS near FROM judged", floats="prevalence")
def _random(v: Views):
    """Random predictions at the prevalence, decided by a hash of the row id."""
    j = v.judged.select("prediction_id", "label_value")
    j = ordered.with_scalar(j, j.agg(F.avg("label_value").alias("prevalence")), "prevalence")
    p = F.pmod(F.xxhash64("prediction_id", F.lit(42)), F.lit(1_000_000)) / 1_000_000 < F.col("prevalence")
    return j.agg(F.count(F.lit(1)).alias("n"), F.avg("prevalence").alias("prevalence"), F.avg(p.cast("int")).alias("_share"),
                 metrics.ratio(F.count_if(p & (F.col("label_value") == 1)), F.count_if(p)).alias("_precision")).selectExpr(
        # both lie within five standard errors of the prevalence
        "n", "prevalence", "abs(_share - prevalence) <= 2.5 / sqrt(n) AND abs(_precision - prevalence) <= 2.5 / sqrt(n * prevalence) AS near")


def _held(cells, num, den, interval):
    """Size and point estimate of what was resampled, and whether the interval holds the point and is no wider than the range."""
    n = F.col("n")
    t = cells.agg(F.sum("n").alias("n"), metrics.ratio(F.sum(n * num).cast("double"), F.sum(n * den)).alias("point"))
    t = t.withColumn("_i", interval.select(F.struct("ci_lower", "ci_upper")).scalar())
    return t.selectExpr("n", "point", "_i.ci_lower <= point + 1e-9 AND point <= _i.ci_upper + 1e-9 AND _i.ci_upper - _i.ci_lower < 1 AS holds")


def _precision(draws, values):
    tp = draws @ (values["actual"] * values["predicted"])
    return tp / np.maximum(draws @ values["predicted"], 1)


@query("met_bootstrap_rows", "SELECT count(*) AS n, coalesce(count(*) FILTER (pred_value = 1 AND label_value = 1)::DOUBLE / nullif(count(*) FILTER (pred_value = 1), 0), 0) AS point, TRUE AS holds FROM judged", floats="point")
def _boot_rows(v: Views):
    """Precision interval over rows; four kinds of rows carry all the information."""
    cells = v.judged.groupBy(F.col("label_value").alias("actual"), F.col("pred_value").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    return _held(cells, F.col("actual") * F.col("predicted"), F.col("predicted"), metrics.bootstrap_interval(cells, "n", ["actual", "predicted"], _precision))


def drawn_sql(name: str, rows: str, order: str, values: str, replicates: int) -> dict[str, str]:
    """Views of the observations in order and of the sums of each replicate's draws."""
    sums = ", ".join(f"sum({v}) AS {v}" for v in values.split())
    return {f"{name}_o": f"SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS i FROM ({rows})",
            f"{name}_d": f"""SELECT b, {sums} FROM (SELECT k // n AS b, ('0x' || substr(md5('42:' || (k // n) || ':' || (k % n)), 1, 15))::BIGINT % n AS i
    FROM (SELECT unnest(range({replicates} * n)) AS k, n FROM (SELECT count(*) AS n FROM {name}_o))) JOIN {name}_o USING (i) GROUP BY b"""}


def interval_sql(name: str, kind: str, point: str, statistic: str, linear: bool = False) -> str:
    ends = [f"quantile_cont(s, {q})" if linear else f"list_sort(list(s))[least(floor(count(s) * {q}), count(s) - 1)::INT + 1]" for q in (0.025, 0.975)]
    return f"""SELECT '{kind}' AS kind, n, point, ci_lower, ci_upper FROM (SELECT count(*) AS n, {point} AS point FROM {name}_o),
    (SELECT {ends[0]} AS ci_lower, {ends[1]} AS ci_upper FROM (SELECT {statistic} AS s FROM {name}_d))"""


DRAWN = {**drawn_sql("bev", "SELECT max(label_value) * max(pred_value) AS tp, max(pred_value) AS p, max(label_value) AS a FROM judged GROUP BY coalesce(event_id, prediction_id)", "a, p", "tp p", 1000),
          **drawn_sql("bday", "SELECT CAST(signal_time AS DATE) AS day, sum(label_value * pred_value) AS tp, sum(pred_value) AS p FROM judged GROUP BY 1", "day", "tp p", 1000)}
_SHARE, _SHARE_SUM = "tp::DOUBLE / nullif(p, 0)", "sum(tp)::DOUBLE / nullif(sum(p), 0)"


@query("met_bootstrap_groups", interval_sql("bev", "event", _SHARE_SUM, _SHARE) + " UNION ALL " + interval_sql("bday", "block", _SHARE_SUM, _SHARE), views=DRAWN, floats="point ci_lower ci_upper", ints="n")
def _boot_groups(v: Views):
    """Precision over whole events and over contiguous blocks of a day."""
    j = materialize(v.judged.select("prediction_id", "event_id", "label_value", "pred_value", "signal_time"), "judged")
    kinds = metrics.event_rows(j).groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n")).withColumn("tp", F.col("actual") * F.col("predicted"))
    event = resample.counted_interval(kinds.withColumn("p", F.col("predicted")), ["actual", "predicted"], ["tp", "p"], resample.ratio_of("tp", "p"), count="n")
    days = day_blocks(j)
    block = resample.counted_interval(days, ["day"], ["tp", "p"], resample.ratio_of("tp", "p"))
    return event.select(F.lit("event").alias("kind"), "*").unionByName(block.select(F.lit("block").alias("kind"), "*"))


def day_blocks(judged):
    return judged.groupBy(F.to_date("signal_time").alias("day")).agg(F.sum(F.col("label_value") * F.col("pred_value")).alias("tp"), F.sum("pred_value").alias("p"))


SWEEP = {"grid": "SELECT unnest(range(90)) AS i", "sweep": """
  SELECT threshold, n_predicted, tp, n_positive, tp::DOUBLE / nullif(n_predicted, 0) AS precision, tp::DOUBLE / n_positive AS recall FROM (
    SELECT t AS threshold, (SELECT count(*) FROM judged WHERE probability >= t) AS n_predicted, (SELECT count(*) FROM judged WHERE probability >= t AND label_value = 1) AS tp,
      (SELECT count(*) FROM judged WHERE label_value = 1) AS n_positive FROM (SELECT (5 + i) / 100.0::DOUBLE AS t FROM grid))"""}
GRID = [(5 + i) / 100.0 for i in range(90)]


@query("ml_threshold_sweep", "SELECT * FROM sweep", views=SWEEP, floats="threshold precision recall", ints="n_predicted tp n_positive")
def _sweep(v: Views):
    return metrics.threshold_sweep(v.judged, [], GRID)


@query("ml_threshold_precision_first", """
  SELECT coalesce((SELECT threshold FROM sweep WHERE recall >= 0.5 AND n_predicted > 0 ORDER BY precision DESC, threshold LIMIT 1),
    (SELECT threshold FROM sweep WHERE n_predicted > 0 ORDER BY precision DESC, threshold LIMIT 1), 0.5) AS threshold""", views=SWEEP, floats="threshold")
def _precision_first(v: Views):
    return metrics.best_precision_threshold(metrics.threshold_sweep(v.judged, [], GRID))


@query("ml_threshold_f1", """
  SELECT threshold, f1 FROM (SELECT threshold, coalesce(2 * coalesce(precision, 0) * recall / nullif(coalesce(precision, 0) + recall, 0), 0) AS f1 FROM sweep
    WHERE threshold IN (SELECT (5 + 5 * i) / 100.0::DOUBLE FROM grid)) ORDER BY round(f1, 12) DESC, threshold LIMIT 1""", views=SWEEP, floats="threshold f1")
def _best_f1(v: Views):
    return metrics.best_f1_threshold(metrics.threshold_sweep(v.judged, [], [(5 + 5 * i) / 100.0 for i in range(19)]))

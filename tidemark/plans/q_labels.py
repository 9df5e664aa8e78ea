"""Queries of future paths, labels, events, outcomes and indicators."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import micros, with_exprs
from tidemark.operators import indicators, labels, ordered, path
from tidemark.plans.registry import query
from tidemark.plans.views import EVENT_GAP, GAP_MINUTES, Views

LABEL_FLOATS = "signal_price lead_time_minutes max_adverse_excursion max_favorable_excursion future_max_high future_min_low"

# Every bar with the bars of its next 24 hours.
PAIRS = {"pairs": """
  SELECT s.symbol, s.feature_time AS signal_time, s.close AS p, f.feature_time AS ft, f.open, f.high, f.low, f.close
  FROM path_bars s LEFT JOIN path_bars f ON s.symbol = f.symbol AND f.feature_time > s.feature_time
    AND f.feature_time <= s.feature_time + INTERVAL 24 HOUR"""}


def _paths(v: Views, lower: float = 0.08, upper: float = 0.04):
    s = v.path_bars.select("symbol", F.col("feature_time").alias("signal_time"), F.col("close").alias("p"))
    return path.forward_path(s, v.path_bars, ["symbol"], id_cols=["signal_time", "p"], signal_t="signal_time",
                             until=labels.hours_after("signal_time", 24), lower=F.col("p") * (1 - lower),
                             upper=F.col("p") * (1 + upper), horizon_seconds=86400)


@query("join_interval_future", """
  SELECT symbol, signal_time, count(ft) AS n_future, max(high) AS max_high, min(low) AS min_low, max(ft) AS last_t
  FROM pairs GROUP BY symbol, signal_time""", floats="max_high min_low", views=PAIRS)
def _future(v: Views):
    return _paths(v).select("symbol", "signal_time", "n_future", "max_high", "min_low", "last_t")


@query("join_target_detect", """
  SELECT symbol, signal_time, min(ft) AS target_time FROM pairs WHERE low <= p * (1 - 0.08::DOUBLE) GROUP BY symbol, signal_time""", views=PAIRS)
def _target(v: Views):
    return labels.target_detection(v.path_bars).select("symbol", "signal_time", "target_time")


TARGET = {**PAIRS, "hits": "SELECT symbol, signal_time, min(ft) AS target_time FROM pairs WHERE low <= p * (1 - 0.08::DOUBLE) GROUP BY symbol, signal_time",
          "ae": """SELECT h.symbol, h.signal_time, h.target_time, max(CASE WHEN ft = target_time THEN high / p - 1 END) AS ae_at_target,
              coalesce(max(CASE WHEN ft < target_time THEN high / p - 1 END), 0) AS prior_max_ae
            FROM hits h JOIN pairs USING (symbol, signal_time) GROUP BY ALL"""}


@query("join_correlated_max", "SELECT symbol, signal_time, ae_at_target, prior_max_ae FROM ae", floats="ae_at_target prior_max_ae", views=TARGET)
def _correlated(v: Views):
    return labels.target_detection(v.path_bars).select("symbol", "signal_time", "ae_at_target", "prior_max_ae")


@query("join_forward_path", """
  SELECT symbol, signal_time, count(ft) AS n_future, arg_max(close, ft) AS last_close FROM pairs GROUP BY symbol, signal_time
  HAVING count(ft) >= 12""", floats="last_close", views=PAIRS)
def _forward(v: Views):
    return _paths(v).where("n_future >= 12").select("symbol", "signal_time", "n_future", "last_close")


@query("label_v1", "SELECT * FROM labels_24", floats=LABEL_FLOATS, ints="horizon_hours label_value")
def _label_v1(v: Views):
    return v.labels


@query("label_v1_horizons", "SELECT * FROM labels_all", floats=LABEL_FLOATS, ints="horizon_hours label_value")
def _horizons(v: Views):
    return labels.label_paths(v.path_bars, gap_minutes=GAP_MINUTES)


@query("set_union_horizons", "SELECT * FROM labels_all", floats=LABEL_FLOATS, ints="horizon_hours label_value")
def _union_horizons(v: Views):
    one = lambda h: labels.label_paths(v.path_bars, (h,), gap_minutes=GAP_MINUTES)
    return one(6).unionByName(one(12)).unionByName(one(24))


WIDE = {**TARGET, "gaps": """
  SELECT *, CASE WHEN epoch_us(feature_time) - epoch_us(lag(feature_time) OVER (PARTITION BY symbol ORDER BY feature_time)) > 10800000000
    THEN 1 ELSE 0 END AS hole FROM path_bars""",
        "wide": """
  SELECT symbol, feature_time AS signal_time, close AS signal_close, quality_status AS signal_quality, max(high) OVER w AS future_max_high,
    min(low) OVER w AS future_min_low, max(1 - low / close) OVER w AS max_fe, max(high / close - 1) OVER w AS max_ae_any,
    max(feature_time) OVER w AS last_future_time, count(*) OVER w AS future_count, max(hole) OVER w AS gap_exceeded
  FROM gaps WINDOW w AS (PARTITION BY symbol ORDER BY feature_time ROWS BETWEEN 1 FOLLOWING AND 26 FOLLOWING)""",
        "v01": """
  SELECT *, CASE WHEN signal_quality IN ('invalid','quarantined') THEN 'invalid_signal_quality' WHEN signal_close <= 0 THEN 'invalid_signal_price'
      WHEN future_count = 0 THEN 'missing_future_data' WHEN gap_exceeded = 1 THEN 'gap_exceeds_threshold'
      WHEN last_future_time < signal_time + INTERVAL 24 HOUR - INTERVAL 5 MINUTE THEN 'missing_future_data'
      WHEN target_time IS NOT NULL AND prior <= 0.04 AND atv > 0.04 THEN 'ambiguous_intrabar' END AS reason
  FROM (SELECT w.*, ae.target_time, coalesce(ae.prior_max_ae, 0) AS prior, coalesce(ae.ae_at_target, 0) AS atv
    FROM wide w LEFT JOIN ae USING (symbol, signal_time))"""}


@query("win_forward_extremes", "SELECT * FROM wide", floats="signal_close future_max_high future_min_low max_fe max_ae_any",
       ints="future_count gap_exceeded", views=WIDE)
def _wide(v: Views):
    return labels.forward_rows(v.path_bars, 26, GAP_MINUTES)


@query("win_gap_flag", "SELECT symbol, signal_time, gap_exceeded FROM wide", ints="gap_exceeded", views=WIDE)
def _gap(v: Views):
    return labels.forward_rows(v.path_bars, 26, GAP_MINUTES).select("symbol", "signal_time", "gap_exceeded")


@query("label_v01", """
  SELECT symbol, signal_time, CASE WHEN reason IS NULL THEN CASE WHEN target_time IS NOT NULL AND prior <= 0.04 THEN 1 ELSE 0 END END AS label_value,
    target_time, (epoch_us(target_time) - epoch_us(signal_time)) // 60000000 AS lead_time_minutes,
    signal_time + INTERVAL 24 HOUR AS invalidation_time FROM v01""", ints="label_value lead_time_minutes", views=WIDE)
def _v01(v: Views):
    return labels.label_first_generation(v.path_bars, rows=26, gap_minutes=GAP_MINUTES)


@query("label_v01_detail", """
  SELECT symbol, signal_time, CASE WHEN reason IS NULL THEN CASE WHEN target_time IS NOT NULL AND prior <= 0.04 THEN 1 ELSE 0 END END AS label_value,
    CASE WHEN shown THEN target_time IS NOT NULL END AS target_reached, CASE WHEN shown THEN target_time END AS target_time,
    CASE WHEN shown THEN (epoch_us(target_time) - epoch_us(signal_time)) // 60000000 END AS lead_time_minutes,
    CASE WHEN shown THEN CASE WHEN target_time IS NOT NULL THEN greatest(prior, atv) ELSE coalesce(max_ae_any, 0) END END AS max_adverse_excursion,
    CASE WHEN shown THEN coalesce(max_fe, 0) END AS max_favorable_excursion, CASE WHEN shown THEN future_max_high END AS future_max_high,
    CASE WHEN shown THEN future_min_low END AS future_min_low, reason AS exclusion_reason
  FROM (SELECT *, reason IS NULL OR reason = 'ambiguous_intrabar' AS shown FROM v01)""",
       floats="max_adverse_excursion max_favorable_excursion future_max_high future_min_low", ints="label_value lead_time_minutes", views=WIDE)
def _v01_detail(v: Views):
    return labels.label_first_generation(v.path_bars, rows=26, gap_minutes=GAP_MINUTES, detail=True)


@query("set_except_determinism", "SELECT symbol, signal_time, label_value FROM labels_24 WHERE FALSE", ints="label_value")
def _determinism(v: Views):
    """Two runs of the labels, the second on reshuffled input, leave no difference."""
    again = labels.label_paths(v.path_bars.repartition(5, "close"), (24,), gap_minutes=GAP_MINUTES)
    cols = ["symbol", "signal_time", "label_value"]
    return v.labels.select(*cols).exceptAll(again.select(*cols))


@query("win_sessionize_events", "SELECT symbol, signal_time, label_value, event_id FROM label_events WHERE label_value = 1", ints="label_value")
def _sessions(v: Views):
    return v.label_events.where("label_value = 1").select("symbol", "signal_time", "label_value", "event_id")


@query("join_event_map", "SELECT symbol, signal_time, event_id FROM label_events")
def _event_map(v: Views):
    return v.label_events.select("symbol", "signal_time", "event_id")


@query("agg_event_summary", """
  SELECT event_id, symbol, min(signal_time) AS event_start_time, max(signal_time) AS event_end_time, count(*) AS member_rows,
    min(target_time) AS first_target_time, min(max_favorable_excursion) AS peak_favorable_excursion
  FROM label_events WHERE event_id IS NOT NULL GROUP BY event_id, symbol""", floats="peak_favorable_excursion")
def _summary(v: Views):
    return labels.event_summary(v.label_events)


@query("agg_label_counts", """
  SELECT count(*) AS n_total, count(*) FILTER (label_value = 1) AS n_positive, count(*) FILTER (label_value = 0) AS n_negative,
    count(*) FILTER (label_value IS NULL) AS n_excluded FROM labels_24""")
def _counts(v: Views):
    return labels.label_counts(v.labels)


@query("agg_label_stats_symbol", """
  SELECT symbol, count(*) AS n_total, count(*) FILTER (label_value = 1) AS n_positive, count(*) FILTER (label_value = 0) AS n_negative,
    min(signal_time) AS first_time, max(signal_time) AS last_time FROM labels_24 GROUP BY symbol""")
def _stats_symbol(v: Views):
    return (v.labels.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_total"), F.expr("count_if(label_value = 1) AS n_positive"),
        F.expr("count_if(label_value = 0) AS n_negative"), F.min("signal_time").alias("first_time"),
        F.max("signal_time").alias("last_time")).orderBy(F.col("n_positive").desc(), "symbol"))


ATR = {"tr": """
  SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS true_range, row_number() OVER w - 1 AS pos
  FROM path_bars WINDOW w AS (PARTITION BY symbol ORDER BY feature_time)""",
       "atr": """
  SELECT *, greatest(avg(true_range) OVER (PARTITION BY symbol ORDER BY feature_time ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) / close, 1e-4) AS volatility
  FROM tr"""}


@query("ind_true_range_atr", "SELECT symbol, feature_time, true_range, volatility FROM atr", floats="true_range volatility", views=ATR)
def _atr(v: Views):
    return indicators.relative_atr(v.path_bars).select("symbol", "feature_time", "true_range", "volatility")


def barrier_signals(v: Views):
    """Every hour, one minute after the bar: long on even, short on odd cells."""
    return v.bars_1h.selectExpr("symbol", "concat_ws('-', symbol, CAST(cell AS STRING)) AS signal_id",
                        "close_time + INTERVAL 61 SECONDS AS signal_time", "CASE WHEN cell % 2 = 0 THEN 1 ELSE -1 END AS side")


BARRIER = {**ATR, "bsig": """
  SELECT symbol, symbol || '-' || cell AS signal_id, close_time + INTERVAL 61 SECONDS AS signal_time,
    CASE WHEN cell % 2 = 0 THEN 1 ELSE -1 END AS side FROM bars_1h""",
           "entries": """
  SELECT s.symbol, s.signal_id, s.side, a.feature_time AS entry_time, a.close AS entry_price, greatest(a.volatility, 0.005) AS target_vol,
    a.close * (1.0 + s.side * greatest(a.volatility, 0.005) * 2.0) AS tp_price, a.close * (1.0 - s.side * greatest(a.volatility, 0.005) * 1.0) AS sl_price
  FROM bsig s ASOF JOIN atr a ON s.symbol = a.symbol AND s.signal_time >= a.feature_time""",
           "bpath": """
  SELECT e.*, b.feature_time AS ft, b.high, b.low, b.close, row_number() OVER (PARTITION BY e.signal_id ORDER BY b.feature_time) AS k,
    CASE WHEN side = 1 THEN high >= tp_price ELSE low <= tp_price END AS hit_tp, CASE WHEN side = 1 THEN low <= sl_price ELSE high >= sl_price END AS hit_sl
  FROM entries e JOIN path_bars b ON e.symbol = b.symbol AND b.feature_time > e.entry_time AND b.feature_time <= e.entry_time + INTERVAL 12 HOUR""",
           "trades": """
  SELECT symbol, signal_id, entry_time, entry_price, side, target_vol, tp_price, sl_price,
    CASE touch_type WHEN 'sl' THEN slt WHEN 'tp' THEN tpt ELSE lt END AS exit_time,
    CASE touch_type WHEN 'sl' THEN sl_price WHEN 'tp' THEN tp_price ELSE lc END AS exit_price, touch_type,
    CASE touch_type WHEN 'sl' THEN -1 WHEN 'tp' THEN 1 ELSE 0 END AS label,
    side * (CASE touch_type WHEN 'sl' THEN sl_price WHEN 'tp' THEN tp_price ELSE lc END - entry_price) / entry_price AS raw_return,
    CASE touch_type WHEN 'sl' THEN slk WHEN 'tp' THEN tpk ELSE n END AS holding_bars
  FROM (SELECT *, CASE WHEN slk IS NOT NULL AND (tpk IS NULL OR slk <= tpk) THEN 'sl' WHEN tpk IS NOT NULL THEN 'tp' ELSE 'time' END AS touch_type
    FROM (SELECT symbol, signal_id, entry_time, entry_price, side, target_vol, tp_price, sl_price, min(k) FILTER (hit_tp) AS tpk,
        min(k) FILTER (hit_sl) AS slk, min(ft) FILTER (hit_tp) AS tpt, min(ft) FILTER (hit_sl) AS slt, max(ft) AS lt, arg_max(close, ft) AS lc, count(*) AS n
      FROM bpath GROUP BY ALL))""",
           "moved": """
  SELECT t.*, CASE WHEN n > 1 THEN greatest(CASE WHEN side = 1 THEN (mh - entry_price) / entry_price ELSE (entry_price - ml) / entry_price END, 0) ELSE 0 END AS mfe,
    CASE WHEN n > 1 THEN greatest(CASE WHEN side = 1 THEN (entry_price - ml) / entry_price ELSE (mh - entry_price) / entry_price END, 0) ELSE 0 END AS mae
  FROM (SELECT t.symbol, t.signal_id, t.entry_time, t.entry_price, t.side, t.exit_time, t.label, t.raw_return, t.holding_bars, count(*) AS n,
      max(b.high) AS mh, min(b.low) AS ml
    FROM trades t JOIN path_bars b ON t.symbol = b.symbol AND b.feature_time BETWEEN t.entry_time AND t.exit_time GROUP BY ALL) t"""}


def trades(v: Views):
    return labels.triple_barrier(indicators.relative_atr(v.path_bars), barrier_signals(v))


def moved(v: Views):
    return labels.excursions(trades(v), v.path_bars)


@query("label_triple_barrier", "SELECT * FROM trades", views=BARRIER, ints="side label holding_bars",
       floats="entry_price target_vol tp_price sl_price exit_price raw_return")
def _barrier(v: Views):
    return trades(v)


@query("met_mfe_mae", """
  SELECT signal_id, mfe, mae, mfe / CASE WHEN mae = 0 THEN 1e-4 ELSE mae END AS mfe_mae_ratio FROM moved""", views=BARRIER,
       floats="mfe mae mfe_mae_ratio")
def _mfe(v: Views):
    return moved(v).select("signal_id", "mfe", "mae", "mfe_mae_ratio")


# Signals on the hour after a fall, judged by take levels and a stop.
STOPS = {**PAIRS, "spath": """
  SELECT *, min(CASE WHEN high >= p * (1 + 0.04::DOUBLE) THEN ft END) OVER (PARTITION BY symbol, signal_time) AS slt FROM pairs""",
         "stops": """
  SELECT symbol, signal_time, p AS entry_price, n_future, greatest(0.0, (mh - p) / p) AS mae, greatest(0.0, (p - ml) / p) AS mfe, slt IS NOT NULL AS hit_sl,
    coalesce((p - mb) / p >= 0.03, FALSE) AS hit_tp_3pct, coalesce((p - mb) / p >= 0.04, FALSE) AS hit_tp_4pct, coalesce((p - mb) / p >= 0.06, FALSE) AS hit_tp_6pct,
    coalesce((p - mb) / p >= 0.08, FALSE) AS hit_tp_8pct, coalesce((p - mb) / p >= 0.12, FALSE) AS hit_tp_12pct,
    CASE WHEN slt IS NOT NULL THEN -0.04 WHEN coalesce((p - mb) / p >= 0.08, FALSE) THEN 0.08 WHEN coalesce((p - mb) / p >= 0.04, FALSE) THEN 0.04
      ELSE (p - lc) / p END AS net_pnl
  FROM (SELECT symbol, signal_time, p, slt, count(ft) AS n_future, max(high) AS mh, min(low) AS ml, arg_max(close, ft) AS lc,
      min(low) FILTER (slt IS NULL OR ft < slt) AS mb FROM spath GROUP BY ALL HAVING count(ft) >= 12)"""}


def stop_outcomes(v: Views):
    s = v.path_bars.select("symbol", F.col("feature_time").alias("signal_time"), F.col("close").alias("entry_price"))
    return labels.stop_take_outcomes(s, v.path_bars, id_cols=["symbol"], min_bars=12)


@query("outcome_path_tp_sl", "SELECT * FROM stops", views=STOPS, floats="entry_price mae mfe net_pnl", ints="n_future")
def _stops(v: Views):
    return stop_outcomes(v)


OPPS = {"opps": """
  SELECT symbol || '-' || cell AS opportunity_id, symbol, close_time + INTERVAL 30 SECONDS AS observed_at, close AS reference_price,
    close_time + INTERVAL 30 SECONDS + INTERVAL 6 HOUR AS due_at FROM bars_1h""",
        "tape": """
  SELECT *, epoch_us(ft) - epoch_us(coalesce(lag(ft) OVER (PARTITION BY opportunity_id ORDER BY ft), observed_at)) AS gap FROM (
    SELECT o.*, b.close_time AS ft, b.high, b.low FROM opps o LEFT JOIN bars_5m b ON o.symbol = b.symbol AND b.close_time > o.observed_at
      AND b.close_time <= o.due_at WHERE o.due_at <= (SELECT max(ts) FROM events))""",
        "tapeout": """
  SELECT opportunity_id, symbol, observed_at, reference_price AS p, count(ft) AS n, greatest(max(gap), epoch_us(due_at) - epoch_us(max(ft))) / 6e7 AS hole,
    min(ft) FILTER (low <= reference_price * (1.0 - 0.02::DOUBLE)) AS lo, min(ft) FILTER (high >= reference_price * (1.0 + 0.04::DOUBLE)) AS up,
    max(high) AS mh, min(low) AS ml FROM tape GROUP BY opportunity_id, symbol, observed_at, due_at, reference_price""",
        "tapereason": """
  SELECT *, CASE WHEN n = 0 THEN 'missing_future_data' WHEN hole > 90 THEN 'data_gap' WHEN lo = up THEN 'ambiguous_intrabar' END AS reason FROM tapeout"""}


@query("outcome_filter_tape", """
  SELECT opportunity_id, symbol, CASE WHEN reason IS NULL THEN CASE WHEN lo IS NOT NULL AND (up IS NULL OR lo < up) THEN 1 ELSE 0 END END AS label_value,
    CASE WHEN reason IS NULL AND (up IS NULL OR lo < up) THEN lo END AS target_time,
    CASE WHEN reason IS NULL AND (up IS NULL OR lo < up) THEN (epoch_us(lo) - epoch_us(observed_at)) / 6e7 END AS lead_time_minutes,
    CASE WHEN reason IS NULL OR reason = 'ambiguous_intrabar' THEN mh / p - 1.0 END AS mae,
    CASE WHEN reason IS NULL OR reason = 'ambiguous_intrabar' THEN ml / p - 1.0 END AS mfe,
    CASE WHEN reason IS NULL THEN 'resolved' ELSE 'excluded' END AS outcome_status, reason AS exclusion_reason FROM tapereason""",
       views=OPPS, floats="lead_time_minutes mae mfe", ints="label_value")
def _tape(v: Views):
    opps = v.bars_1h.selectExpr(
        "concat_ws('-', symbol, CAST(cell AS STRING)) AS opportunity_id", "symbol", "close_time + INTERVAL 30 SECONDS AS observed_at",
        "close AS reference_price", "close_time + INTERVAL 30 SECONDS + INTERVAL 6 HOURS AS due_at", "0.02D AS target_drawdown",
        "0.04D AS max_adverse_excursion")
    tape = v.bars_5m.selectExpr("symbol", "close_time AS observed_at", "high", "low", "close")
    return labels.tape_outcomes(opps, tape, v.as_of, horizon_hours=6, gap_minutes=90)


# Predictions already judged: every third cell.
PENDING = {"outcomes": "SELECT * FROM predictions WHERE cell % 3 = 0 AND coalesce(exclusion_reason, '') <> 'missing_future_data'",
           "pending": """
  SELECT p.prediction_id, p.model_id, p.symbol, p.signal_time, p.horizon_hours FROM predictions p WHERE p.invalidation_time <= (SELECT max(ts) FROM events)
    AND NOT EXISTS (SELECT 1 FROM outcomes o WHERE o.prediction_id = p.prediction_id)"""}


def open_predictions(v: Views):
    p = v.rule_probs.selectExpr("*", "unix_micros(signal_time) DIV 3600000000L AS cell").selectExpr(
        "concat_ws('-', symbol, CAST(cell AS STRING)) AS prediction_id", "CASE WHEN cell % 2 = 0 THEN 'm_even' ELSE 'm_odd' END AS model_id",
        "symbol", "signal_time", "24 AS horizon_hours", "signal_time + INTERVAL 24 HOURS AS invalidation_time", "cell", "probability",
        "0.55D AS threshold")
    return p


def outcomes(v: Views):
    return v.predictions.where("cell % 3 = 0 AND coalesce(exclusion_reason, '') <> 'missing_future_data'")


@query("join_anti_pending", "SELECT * FROM pending", views=PENDING, ints="horizon_hours")
def _pending(v: Views):
    return labels.pending_rows(open_predictions(v), outcomes(v), v.as_of).select(
        "prediction_id", "model_id", "symbol", "signal_time", "horizon_hours")


@query("outcome_predictions", """
  SELECT p.symbol, p.signal_time, p.horizon_hours, p.prediction_id, p.model_id, l.label_value, l.target_time, l.lead_time_minutes,
    l.max_adverse_excursion AS mae, l.max_favorable_excursion AS mfe, l.exclusion_reason, l.label_version AS outcome_engine_version,
    CASE WHEN l.label_value IS NULL THEN 'excluded' ELSE 'materialized' END AS outcome_status
  FROM pending p JOIN labels_24 l USING (symbol, signal_time, horizon_hours) WHERE coalesce(l.exclusion_reason, '') <> 'missing_future_data'""",
       views=PENDING, floats="lead_time_minutes mae mfe", ints="horizon_hours label_value")
def _resolve(v: Views):
    return labels.resolve_predictions(labels.pending_rows(open_predictions(v), outcomes(v), v.as_of), v.labels)


@query("outcome_alerts", """
  SELECT a.symbol, a.signal_time, w.label_value = 1 AS hit FROM (SELECT symbol, signal_time FROM rule_probs WHERE probability >= 0.55
      AND signal_time + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events)) a
  JOIN (SELECT symbol, signal_time, CASE WHEN reason IS NULL THEN CASE WHEN target_time IS NOT NULL AND prior <= 0.04 THEN 1 ELSE 0 END END AS label_value
    FROM v01) w USING (symbol, signal_time) WHERE w.label_value IS NOT NULL""", views=WIDE)
def _alerts(v: Views):
    due = v.rule_probs.where("probability >= 0.55").select("symbol", "signal_time").where(
        F.expr("signal_time + INTERVAL 24 HOURS") <= v.as_of)
    lab = labels.label_first_generation(v.path_bars, rows=26, gap_minutes=GAP_MINUTES).where("label_value IS NOT NULL")
    return due.join(lab, ["symbol", "signal_time"]).selectExpr("symbol", "signal_time", "label_value = 1 AS hit")


@query("win_event_ids_predictions", """
  SELECT prediction_id, symbol || '_' || (epoch_us(min(signal_time) OVER (PARTITION BY model_id, horizon_hours, symbol, seq)) // 1000000) || '_24' AS event_id
  FROM (SELECT *, sum(nw) OVER (PARTITION BY model_id, horizon_hours, symbol ORDER BY signal_time) AS seq FROM (
    SELECT *, CASE WHEN lag(signal_time) OVER w IS NULL OR epoch_us(signal_time) - epoch_us(lag(signal_time) OVER w) >= 10800000000 THEN 1 ELSE 0 END AS nw
    FROM (SELECT prediction_id, model_id, horizon_hours, symbol, signal_time FROM predictions WHERE label_value = 1)
    WINDOW w AS (PARTITION BY model_id, horizon_hours, symbol ORDER BY signal_time)))""")
def _event_ids(v: Views):
    p = v.predictions.where("label_value = 1").select("prediction_id", "model_id", "horizon_hours", "symbol", "signal_time", "label_value")
    return labels.group_events(p, keys=("model_id", "horizon_hours", "symbol"), gap_minutes=EVENT_GAP,
                               suffix=F.col("horizon_hours").cast("string")).select("prediction_id", "event_id")


@query("ind_ewm_vol", """
  SELECT symbol, feature_time, coalesce(v, median(v) OVER (PARTITION BY symbol), 0.01) AS ewm_vol FROM (
    SELECT symbol, feature_time, CASE WHEN pos >= 10 THEN sqrt(greatest(wxx / w - (wx / w) * (wx / w), 0) * w * w / (w * w - w2)) END AS v FROM (
      SELECT a.symbol, a.feature_time, a.pos, sum(g) AS w, sum(g * g) AS w2, sum(g * r) AS wx, sum(g * r * r) AS wxx FROM (
        SELECT a.symbol, a.feature_time, a.pos, pow(1 - 2.0::DOUBLE / 101, a.pos - b.pos) AS g, b.r FROM rets a LEFT JOIN rets b
          ON a.symbol = b.symbol AND b.pos <= a.pos AND b.r IS NOT NULL) a GROUP BY ALL))""",
       views={**ATR, "rets": "SELECT symbol, feature_time, pos, close / lag(close) OVER (PARTITION BY symbol ORDER BY feature_time) - 1 AS r FROM tr"},
       floats="ewm_vol")
def _ewm(v: Views):
    return indicators.ewm_volatility(v.path_bars).select("symbol", "feature_time", "ewm_vol")


REGIME = {**ATR, "ema": """
  SELECT a.symbol, a.feature_time, sum(pow(1 - 2.0::DOUBLE / 51, a.pos - b.pos) * b.close) / sum(pow(1 - 2.0::DOUBLE / 51, a.pos - b.pos)) AS e50,
    sum(pow(1 - 2.0::DOUBLE / 201, a.pos - b.pos) * b.close) / sum(pow(1 - 2.0::DOUBLE / 201, a.pos - b.pos)) AS e200
  FROM tr a JOIN tr b ON a.symbol = b.symbol AND b.pos <= a.pos GROUP BY ALL""",
          "dm": """
  SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS mdm FROM (
    SELECT *, high - lag(high) OVER w AS up, lag(low) OVER w - low AS down FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY feature_time))""",
          "di": """
  SELECT *, 100 * (avg(pdm) OVER w / (avg(true_range) OVER w + 1e-8)) AS plus_di, 100 * (avg(mdm) OVER w / (avg(true_range) OVER w + 1e-8)) AS minus_di,
    4 * coalesce(stddev_samp(close) OVER w20, 0) / (avg(close) OVER w20 + 1e-8) AS bb_width, greatest(avg(true_range) OVER w / close, 1e-4) AS atr_pct
  FROM dm WINDOW w AS (PARTITION BY symbol ORDER BY feature_time ROWS BETWEEN 13 PRECEDING AND CURRENT ROW),
    w20 AS (PARTITION BY symbol ORDER BY feature_time ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
          "dx": """
  SELECT *, avg(100 * (abs(plus_di - minus_di) / (plus_di + minus_di + 1e-8))) OVER (PARTITION BY symbol ORDER BY feature_time ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS adx,
    CASE WHEN pos >= 19 THEN quantile_cont(bb_width, 0.75) OVER (PARTITION BY symbol ORDER BY feature_time ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)
      ELSE median(bb_width) OVER (PARTITION BY symbol) END AS bb_threshold FROM di""",
          "regimes": """
  SELECT *, CASE WHEN adx >= 25 THEN CASE WHEN trend_slope > 0 AND plus_di > minus_di THEN 'TRENDING_BULL' ELSE 'TRENDING_BEAR' END
    WHEN bb_width >= bb_threshold THEN 'HIGH_VOLATILITY_CHOP' ELSE 'SIDEWAY_DISTRIBUTION' END AS regime
  FROM (SELECT d.*, (e50 - e200) / (e200 + 1e-8) AS trend_slope FROM dx d JOIN ema USING (symbol, feature_time))"""}


def _ind(name: str, columns: str, text: str = "*"):
    cols = columns.split()
    @query(name, f"SELECT symbol, feature_time, {', '.join(cols)} FROM regimes", views=REGIME, floats=columns)
    def build(v: Views):
        return indicators.market_regimes(v.path_bars).select("symbol", "feature_time", *cols)


_ind("ind_ema_slope", "trend_slope")
_ind("ind_adx", "adx plus_di minus_di")
_ind("ind_bollinger_width", "bb_width")
_ind("ind_rolling_quantile", "bb_threshold")


@query("ind_regime", """
  SELECT symbol, feature_time, regime, regime <> 'TRENDING_BULL' AS allow_short, regime <> 'TRENDING_BEAR' AS allow_long,
    CASE WHEN regime = 'HIGH_VOLATILITY_CHOP' THEN 0.5 ELSE 1.0 END AS risk_multiplier FROM regimes""", views=REGIME, floats="risk_multiplier")
def _regime(v: Views):
    return indicators.market_regimes(v.path_bars).select("symbol", "feature_time", "regime", "allow_short", "allow_long", "risk_multiplier")


@query("ind_regime_latest", """
  SELECT symbol, feature_time, regime, adx, bb_width, trend_slope, atr_pct FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY feature_time DESC) AS rn
    FROM regimes) WHERE rn = 1""", views=REGIME, floats="adx bb_width trend_slope atr_pct")
def _regime_latest(v: Views):
    r = indicators.market_regimes(v.path_bars).select("symbol", "feature_time", "regime", "adx", "bb_width", "trend_slope", "atr_pct")
    return ordered.latest_per_key(r, ["symbol"], ["feature_time"])


MOVES = {**ATR, "moves": "SELECT symbol, feature_time, pos, close - lag(close) OVER (PARTITION BY symbol ORDER BY feature_time) AS d FROM tr"}


@query("ind_rsi_simple", """
  SELECT symbol, feature_time, CASE WHEN pos >= 14 THEN CASE WHEN l = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + g / l) END END AS rsi FROM (
    SELECT symbol, feature_time, pos, avg(greatest(d, 0)) OVER w AS g, avg(greatest(-d, 0)) OVER w AS l FROM moves
    WINDOW w AS (PARTITION BY symbol ORDER BY feature_time ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))""", views=MOVES, floats="rsi")
def _rsi(v: Views):
    return indicators.rsi_simple(v.path_bars)


@query("ind_rsi_wilder", """
  SELECT symbol, feature_time, CASE WHEN pos >= 14 THEN CASE WHEN l = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + g / l) END END AS rsi FROM (
    SELECT a.symbol, a.feature_time, a.pos,
      sum(greatest(b.d, 0) * CASE WHEN b.pos <= 14 THEN pow(13.0::DOUBLE / 14, a.pos - 14) / 14 ELSE pow(13.0::DOUBLE / 14, a.pos - b.pos) / 14 END) AS g,
      sum(greatest(-b.d, 0) * CASE WHEN b.pos <= 14 THEN pow(13.0::DOUBLE / 14, a.pos - 14) / 14 ELSE pow(13.0::DOUBLE / 14, a.pos - b.pos) / 14 END) AS l
    FROM moves a LEFT JOIN moves b ON a.symbol = b.symbol AND b.pos BETWEEN 1 AND a.pos GROUP BY ALL)""", views=MOVES, floats="rsi")
def _wilder(v: Views):
    return indicators.rsi_smoothed(v.path_bars)

"""Queries of the operational reports and of latest-row selections."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import labels, metrics, ordered, reports, resample, selection
from tidemark.plans.q_labels import PENDING, open_predictions, outcomes
from tidemark.plans.q_metrics import drawn_sql, interval_sql, labelled_features
from tidemark.plans.registry import query
from tidemark.plans.views import Views
from tidemark.sources.tables import materialize, shared_folder

NOW = "(SELECT max(ts) FROM events)"


@query("agg_alert_stats", """
  SELECT 'ALL' AS risk_level, count(*) AS n, count(*) FILTER (sent AND hit IS NOT NULL) AS n_judged, count(*) FILTER (sent AND hit) AS n_hit,
    count(*) FILTER (sent AND hit) / count(*) FILTER (sent AND hit IS NOT NULL)::DOUBLE AS hit_rate FROM alerts UNION ALL
  SELECT risk_level, count(*), NULL, NULL, NULL FROM alerts GROUP BY risk_level""", floats="hit_rate")
def _alert_stats(v: Views):
    return reports.alert_stats(v.alerts)


@query("agg_precision_by_risk", """
  SELECT risk_level, count(*) FILTER (hit IS NOT NULL) AS n_judged, count(*) FILTER (hit) AS n_hit, count(*) FILTER (hit) / nullif(count(*) FILTER (hit IS NOT NULL), 0)::DOUBLE AS precision
  FROM alerts GROUP BY risk_level""", floats="precision")
def _precision(v: Views):
    return reports.precision_by_level(v.alerts)


@query("agg_lead_time", """
  SELECT count(h) AS n_samples, round(avg(h), 1) AS mean_hours, round(min(h), 1) AS min_hours, round(max(h), 1) AS max_hours, round(median(h), 1) AS median_hours,
    quantile_cont(h, 0.25) * 60 AS p25_minutes, quantile_cont(h, 0.75) * 60 AS p75_minutes
  FROM (SELECT (epoch_us(hit_time) - epoch_us(signal_time)) / 3.6e9 AS h FROM alerts WHERE hit AND hit_time IS NOT NULL)""",
       floats="mean_hours min_hours max_hours median_hours p25_minutes p75_minutes")
def _lead(v: Views):
    return reports.lead_time(v.alerts)


@query("agg_daily_alert_count", f"""
  SELECT symbol, count(*) AS n FROM alerts WHERE sent AND NOT shadow AND sent_at >= {NOW} - INTERVAL 24 HOUR AND sent_at <= {NOW} GROUP BY symbol
  UNION ALL SELECT 'ALL', count(*) FROM alerts WHERE sent AND NOT shadow AND sent_at >= {NOW} - INTERVAL 24 HOUR AND sent_at <= {NOW}""")
def _daily_count(v: Views):
    a = v.alerts.where(f"sent AND NOT shadow AND sent_at >= {v.now} - INTERVAL 24 HOURS AND sent_at <= {v.now}")
    return a.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).unionByName(a.agg(F.count(F.lit(1)).alias("n")).select(F.lit("ALL").alias("symbol"), "n"))


@query("agg_scan_per_day", """
  SELECT CAST(scan_time + INTERVAL 7 HOUR AS DATE) AS day, count(*) AS n_rows, count(DISTINCT cycle) AS n_cycles, count(DISTINCT symbol) AS n_symbols
  FROM scans GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")
def _scan_day(v: Views):
    return reports.distinct_per_day(v.scans, "scan_time", {"n_cycles": "cycle", "n_symbols": "symbol"})


@query("agg_signals_per_day", """
  SELECT CAST(signal_time + INTERVAL 7 HOUR AS DATE) AS day, count(*) AS n_signals, count(*) FILTER (sent) AS n_sent, count(*) FILTER (hit) AS n_hit
  FROM alerts GROUP BY 1 ORDER BY 1 DESC LIMIT 30""")
def _signals_day(v: Views):
    return reports.per_local_day(v.alerts, "signal_time", [F.count(F.lit(1)).alias("n_signals"), F.count_if("sent").alias("n_sent"), F.count_if("hit").alias("n_hit")])


@query("agg_table_freshness", """
  SELECT 'events' AS table_name, count(*) AS n_rows, min(ts) AS first_time, max(ts) AS last_time FROM events UNION ALL
  SELECT 'orders', count(*), min(o_orderdate), max(o_orderdate) FROM orders UNION ALL SELECT 'lineitem', count(*), min(l_shipdate), max(l_shipdate) FROM lineitem""")
def _fresh(v: Views):
    return reports.table_freshness({"events": (v.table("events"), "ts"), "orders": (v.table("orders"), "o_orderdate"), "lineitem": (v.table("lineitem"), "l_shipdate")})


@query("agg_ops_metrics", """
  SELECT 'recommendation' AS metric, recommendation AS value, count(*) AS n FROM scans GROUP BY recommendation UNION ALL
  SELECT 'symbol', symbol, count(*) FROM scans GROUP BY symbol UNION ALL
  SELECT 'events', 'distinct_positive', count(DISTINCT event_id) FROM label_events WHERE label_value = 1 UNION ALL
  SELECT 'latency', 'p' || q, max(CASE WHEN rn = round_even((n - 1) * q / 100.0, 0) THEN x END)::BIGINT FROM (SELECT cell % 97 AS x, row_number() OVER (ORDER BY cell % 97) - 1 AS rn, count(*) OVER () AS n FROM scans),
    (VALUES (50), (95)) t(q) GROUP BY q""", ints="n")
def _ops(v: Views):
    h = reports.histograms(v.scans, ["recommendation", "symbol"])
    ev = v.label_events.where("label_value = 1").select("event_id").distinct().agg(F.count("event_id").alias("n")).selectExpr("'events' AS metric", "'distinct_positive' AS value", "n")
    from tidemark.operators.quantiles import exact_percentiles
    lat = exact_percentiles(v.scans, (), F.expr("cell % 97"), {"p50": 0.5, "p95": 0.95}, "nearest").selectExpr(
        "stack(2, 'p50', CAST(p50 AS BIGINT), 'p95', CAST(p95 AS BIGINT)) AS (value, n)").selectExpr("'latency' AS metric", "value", "n")
    return h.unionByName(ev).unionByName(lat)


@query("agg_daily_monitor", f"""
  SELECT recommendation, count(*) AS n, round(avg(probability), 4) AS avg_prob, count(DISTINCT cycle) AS cycles, min(scan_time) AS first_scan, max(scan_time) AS last_scan
  FROM scans WHERE scan_time >= {NOW} - INTERVAL 24 HOUR AND scan_time <= {NOW} GROUP BY recommendation""", floats="avg_prob", digits=4)
def _monitor(v: Views):
    s = v.scans.where(f"scan_time >= {v.now} - INTERVAL 24 HOURS AND scan_time <= {v.now}")
    return s.groupBy("recommendation").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("probability"), 4).alias("avg_prob"), F.count_distinct("cycle").alias("cycles"),
                                           F.min("scan_time").alias("first_scan"), F.max("scan_time").alias("last_scan"))


@query("agg_weekly_review", f"""
  WITH w AS (SELECT * FROM judged WHERE signal_time >= {NOW} - INTERVAL 7 DAY),
  e AS (SELECT coalesce(event_id, prediction_id) AS k, max(label_value) AS a, max(pred_value) AS p FROM w GROUP BY 1)
  SELECT count(*) AS n_events, coalesce(count(*) FILTER (a = 1 AND p = 1)::DOUBLE / nullif(count(*) FILTER (p = 1), 0), 0) AS event_precision,
    coalesce(count(*) FILTER (a = 1 AND p = 1)::DOUBLE / nullif(count(*) FILTER (a = 1), 0), 0) AS event_recall,
    (SELECT sum(n * abs(c - b)) / sum(n) FROM (SELECT least(floor(probability * 10), 9) AS g, count(*) AS n, avg(probability) AS c, avg(label_value) AS b FROM w GROUP BY 1)) AS ece FROM e HAVING count(*) > 0""",
       floats="event_precision event_recall ece")
def _weekly(v: Views):
    """Event figures of the newest week; a quotient over nothing is 0, and a week without judged rows gives no row."""
    w = v.judged.where(f"signal_time >= {v.now} - INTERVAL 7 DAYS")
    m = metrics.event_metrics(w).select("n_events", "event_precision", "event_recall")
    return m.withColumn("ece", metrics.calibration_error(w, edge="floor").scalar())


@query("topk_symbols_by_alerts", "SELECT symbol, count(*) AS n FROM alerts GROUP BY symbol ORDER BY n DESC, symbol LIMIT 10")
def _top_symbols(v: Views):
    return v.alerts.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "symbol").limit(10)


@query("topk_alert_query", f"""
  SELECT symbol, signal_time, probability, risk_level, hit FROM alerts WHERE risk_level IN ('HIGH','MEDIUM') AND NOT dismissed AND signal_time >= {NOW} - INTERVAL 20 DAY
  ORDER BY signal_time DESC, symbol LIMIT 200""")
def _alert_query(v: Views):
    a = v.alerts.where(F.col("risk_level").isin("HIGH", "MEDIUM") & ~F.col("dismissed")).where(f"signal_time >= {v.now} - INTERVAL 20 DAYS")
    return a.orderBy(F.col("signal_time").desc(), "symbol").limit(200).select("symbol", "signal_time", "probability", "risk_level", "hit")


@query("topk_digest_order", """
  SELECT a.symbol, a.signal_time, a.probability, s.score AS total_score FROM alerts a LEFT JOIN scans s ON a.symbol = s.symbol AND a.signal_time = s.scan_time WHERE a.sent
  ORDER BY a.probability DESC, total_score DESC, a.symbol, a.signal_time""", floats="total_score")
def _digest(v: Views):
    """Every alert that qualifies, the most probable first, equal ones by total score."""
    scores = v.scans.select("symbol", F.col("scan_time").alias("signal_time"), F.col("score").alias("total_score"))
    return v.alerts.where("sent").join(scores, ["symbol", "signal_time"], "left").select("symbol", "signal_time", "probability", "total_score").orderBy(
        F.col("probability").desc(), F.col("total_score").desc(), "symbol", "signal_time")


@query("sort_global_stable", "SELECT symbol, signal_time, label_value FROM labels_24 ORDER BY symbol, signal_time", ints="label_value")
def _sort(v: Views):
    return v.labels.select("symbol", "signal_time", "label_value").orderBy("symbol", "signal_time")


@query("agg_data_quality_report", """
  SELECT 'null:' || c AS item, n::DOUBLE AS value FROM (SELECT unnest(['price_ret_24h','funding_zscore_30d','funding_percentile_7d','oi_acceleration_1h','price_ret_1h']) AS c,
    unnest([count(*) FILTER (price_ret_24h IS NULL), count(*) FILTER (funding_zscore_30d IS NULL), count(*) FILTER (funding_percentile_7d IS NULL), count(*) FILTER (oi_acceleration_1h IS NULL),
      count(*) FILTER (price_ret_1h IS NULL)]) AS n FROM features) UNION ALL
  SELECT 'duplicates', 0 UNION ALL SELECT 'rows', count(*) FROM features UNION ALL SELECT 'days', (epoch_us(max(feature_time)) - epoch_us(min(feature_time))) / 86400e6 FROM features""", floats="value")
def _quality_report(v: Views):
    f = v.features
    cols = ["price_ret_24h", "funding_zscore_30d", "funding_percentile_7d", "oi_acceleration_1h", "price_ret_1h"]
    nulls = reports.null_report(f, cols).selectExpr("concat('null:', column_name) AS item", "CAST(n_null AS DOUBLE) AS value")
    dup = reports.duplicate_rows(f, ["symbol", "feature_time"]).selectExpr("'duplicates' AS item", "CAST(n_duplicates AS DOUBLE) AS value")
    size = f.agg(F.count(F.lit(1)).alias("n"), F.expr("(unix_micros(max(feature_time)) - unix_micros(min(feature_time))) / 86400e6 AS d")).selectExpr(
        "stack(2, 'rows', CAST(n AS DOUBLE), 'days', d) AS (item, value)")
    return nulls.unionByName(dup).unionByName(size)


@query("agg_regime_breakdown", """
  SELECT CASE WHEN r > 0.02 THEN 'bull' WHEN r < -0.02 THEN 'bear' WHEN r IS NOT NULL THEN 'side' ELSE 'unknown' END AS regime, count(*) AS n_rows,
    count(*) FILTER (label_value = 1) AS n_positive, count(*) FILTER (label_value = 0) AS n_negative, coalesce(avg(label_value), 0) AS prevalence
  FROM (SELECT f.price_ret_4h AS r, l.label_value FROM labels_24 l JOIN features f ON f.symbol = l.symbol AND f.feature_time = l.signal_time WHERE label_value IS NOT NULL) GROUP BY 1""", floats="prevalence")
def _regime(v: Views):
    return reports.regime_breakdown(labelled_features(v, ("price",)), "price_ret_4h")


@query("join_features_labels", """
  SELECT f.symbol, f.feature_time AS signal_time, f.price_ret_4h, f.taker_buy_ratio, l.label_value FROM features f JOIN labels_24 l ON f.symbol = l.symbol AND f.feature_time = l.signal_time
  WHERE l.label_value IS NOT NULL""", floats="price_ret_4h taker_buy_ratio", ints="label_value")
def _feature_labels(v: Views):
    return labelled_features(v, ("price", "taker")).select("symbol", "signal_time", "price_ret_4h", "taker_buy_ratio", "label_value")


@query("agg_materialization_stats", """
  SELECT (SELECT count(*) FROM predictions) AS predictions, (SELECT count(*) FROM outcomes) AS outcomes, (SELECT count(*) FROM outcomes WHERE label_value IS NULL) AS excluded,
    (SELECT count(*) FROM pending) AS pending, 'backlog' AS status""", views=PENDING)
def _materialization(v: Views):
    o = outcomes(v)
    return reports.materialization(v.predictions, o, labels.pending_rows(open_predictions(v), o, v.as_of))


@query("agg_learning_readiness", """
  SELECT count(*) AS n_rows, count(*) FILTER (label_value = 1) AS n_positive, count(*) FILTER (model_id = 'm_even') AS n_live, count(*) FILTER (signal_time >= TIMESTAMP '2024-01-15') AS n_recent,
    (SELECT count(DISTINCT event_id) FROM judged WHERE label_value = 1) AS n_events FROM judged""")
def _readiness(v: Views):
    j = v.judged
    n = j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label_value") == 1).alias("n_positive"), F.count_if(F.col("model_id") == "m_even").alias("n_live"),
              F.expr("count_if(signal_time >= TIMESTAMP '2024-01-15 00:00:00') AS n_recent"))
    events = j.where("label_value = 1").select("event_id").distinct().agg(F.count("event_id"))
    return n.withColumn("n_events", events.scalar())


@query("agg_dataset_fingerprint", "SELECT count(*) AS n_rows, TRUE AS same FROM judged")
def _fingerprint(v: Views):
    """Content hash of the judged rows; reshuffled rows must give the same."""
    cols = ["prediction_id", "label_value"]
    first = reports.dataset_fingerprint(v.judged.select(*cols), cols)
    second = reports.dataset_fingerprint(v.judged.select(*cols).repartition(7, "label_value"), cols)
    return first.withColumn("other", second.select("fingerprint").scalar()).selectExpr("n_rows", "fingerprint = other AS same")


@query("agg_market_index", """
  SELECT avg(score) AS avg_score, CASE WHEN avg(score) >= 60 THEN 'high' WHEN avg(score) >= 40 THEN 'moderate' ELSE 'low' END AS regime FROM (
    SELECT score, row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) AS rn FROM scans) WHERE rn = 1""", floats="avg_score")
def _index(v: Views):
    return reports.market_index(ordered.latest_per_key(v.scans, ["symbol"], ["seq"]))


@query("agg_run_history", """
  SELECT date_trunc('hour', o_orderdate) AS run_time, count(*) AS n_coins, count(*) FILTER (o_orderkey % 4 > 0) AS n_valid,
    count(*) FILTER (o_orderkey % 5 > 0 AND o_totalprice / 500000 > 0.3 AND o_totalprice > 0) AS n_edge, arg_max(symbol, (p, symbol)) AS best_coin, round(max(p), 4) AS best_precision
  FROM (SELECT *, 'C' || o_custkey AS symbol, o_totalprice / 500000 AS p FROM orders) GROUP BY 1""", floats="best_precision")
def _runs(v: Views):
    o = v.table("orders").selectExpr("o_orderdate AS created_at", "concat('C', o_custkey) AS symbol", "o_totalprice / 500000 AS precision", "0.3D AS baseline", "o_orderkey % 4 AS n_folds",
                                     "CASE WHEN o_orderkey % 5 > 0 THEN 'passed' ELSE 'failed' END AS leakage")
    return reports.run_history(o)


@query("win_cycle_tail", """
  SELECT arg_max(scan_time, seq) AS last_scan_time, max(cycle) AS cycle, count(*) AS n_symbols, count(*) FILTER (recommendation = 'SHORT_CANDIDATE') AS n_alerts FROM scans
  WHERE seq > (SELECT max(seq) FROM scans WHERE cycle <> (SELECT arg_max(cycle, seq) FROM scans))""")
def _tail(v: Views):
    return reports.cycle_tail(v.scans)


@query("win_latest_per_symbol", f"""
  SELECT symbol, scan_time, score, recommendation FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) AS rn FROM scans WHERE scan_time >= {NOW} - INTERVAL 6 HOUR AND scan_time <= {NOW})
  WHERE rn = 1 ORDER BY score DESC, symbol LIMIT 200""", floats="score")
def _latest(v: Views):
    s = v.scans.where(f"scan_time >= {v.now} - INTERVAL 6 HOURS AND scan_time <= {v.now}")
    return selection.latest_snapshot(s).select("symbol", "scan_time", "score", "recommendation")


@query("win_first_change", """
  SELECT symbol, period_end, 100 * (open_interest_value / f - 1) AS change_pct FROM (SELECT *, first_value(open_interest_value) OVER (PARTITION BY symbol, CAST(period_end AS DATE) ORDER BY period_end) AS f FROM oi)""",
       floats="change_pct")
def _first_change(v: Views):
    """Change against the first value of each day's fetched window."""
    return v.oi.selectExpr("symbol", "period_end", "coalesce(100D * (open_interest_value / first(open_interest_value, true) OVER (PARTITION BY symbol, to_date(period_end) ORDER BY period_end) - 1D), 0D) AS change_pct")


@query("win_recent_weight", """
  SELECT symbol, signal_time, CASE WHEN signal_time >= (SELECT max(signal_time) FROM judged) - INTERVAL 14 DAY THEN 2.0 ELSE 1.0 END AS weight FROM judged""", floats="weight")
def _weight(v: Views):
    j = ordered.with_scalar(v.judged, v.judged.agg(F.max("signal_time").alias("newest")), "newest")
    return j.selectExpr("symbol", "signal_time", "CASE WHEN signal_time >= newest - INTERVAL 14 DAYS THEN 2D ELSE 1D END AS weight")


@query("join_scalar_cross", """
  SELECT b.symbol, b.feature_time, b.close FROM path_bars b, (SELECT max(feature_time) AS m FROM path_bars) x WHERE b.feature_time <= x.m - INTERVAL 24 HOUR""", floats="close")
def _mature(v: Views):
    newest = v.path_bars.agg(F.expr("max(feature_time) - INTERVAL 24 HOURS"))
    return v.path_bars.where(F.col("feature_time") <= newest.scalar()).select("symbol", "feature_time", "close")


@query("join_signal_feed", f"""
  WITH a AS (SELECT symbol, sent_at AS event_time, probability, 'alert' AS kind FROM alerts WHERE NOT dismissed),
  s AS (SELECT symbol, scan_time, probability, row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) AS rn FROM scans),
  p AS (SELECT symbol, signal_time, probability, row_number() OVER (PARTITION BY symbol ORDER BY signal_time DESC) AS rn FROM predictions)
  SELECT * FROM (SELECT * FROM a UNION ALL SELECT symbol, scan_time, probability, 'scan' FROM s WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.symbol = s.symbol AND a.event_time >= s.scan_time)
    UNION ALL SELECT symbol, signal_time, probability, 'prediction' FROM p WHERE rn = 1)
  WHERE event_time <= greatest((SELECT max(event_time) FROM a), (SELECT max(scan_time) FROM scans), (SELECT max(signal_time) FROM predictions))""")
def _feed(v: Views):
    """The feed as of the newest time that any of the three tables holds."""
    newest = F.greatest(*[df.agg(F.max(t)).scalar() for df, t in ((v.alerts, "sent_at"), (v.scans, "scan_time"), (v.predictions, "signal_time"))])
    return reports.signal_feed(v.alerts, v.scans, v.predictions, newest)


@query("join_position_enrich", f"""
  WITH e AS (SELECT symbol, signal_time + INTERVAL 400 MILLISECONDS AS source_time, close * 1.001 AS source_price, CASE WHEN cell % 2 = 0 THEN signal_time + INTERVAL 20 HOUR END AS end_time FROM
      (SELECT *, epoch_us(signal_time) // 3600000000 AS cell FROM rule_probs) ),
  j AS (SELECT e.symbol, e.source_time, coalesce(a.close_price, e.source_price) AS src, s.close_price AS cur, a.hit, coalesce(a.invalidation_time, e.end_time) AS fin FROM e
    LEFT JOIN alerts a ON e.symbol = a.symbol AND abs(epoch_us(e.source_time) - epoch_us(a.signal_time)) < 1000000
    LEFT JOIN (SELECT symbol, close_price, row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) AS rn FROM scans) s ON s.symbol = e.symbol AND s.rn = 1)
  SELECT symbol, source_time, src AS source_price, cur AS current_price, CASE WHEN hit THEN 'HIT' WHEN fin <= {NOW} THEN 'EXPIRED' WHEN fin IS NOT NULL THEN 'ACTIVE' ELSE 'NO_SIGNAL' END AS signal_status,
    round((cur - src) / src * 100, 2) AS signal_change_pct, round(greatest(0, least(1, (src - cur) / (src - round(src * 0.92, 8)))) * 100, 1) AS signal_progress_pct FROM j""",
       floats="source_price current_price signal_change_pct signal_progress_pct")
def _positions(v: Views):
    e = v.rule_probs.selectExpr("*", "unix_micros(signal_time) DIV 3600000000L AS cell").selectExpr(
        "symbol", "signal_time + INTERVAL '0.4' SECOND AS source_time", "close * 1.001D AS source_price", "CASE WHEN cell % 2 = 0 THEN signal_time + INTERVAL 20 HOURS END AS end_time")
    return reports.tracked_positions(e, v.alerts, v.tickers, v.scans, v.as_of)


@query("join_price_reconcile", """
  SELECT t.symbol, t.last_px AS price, n.p_retailprice AS other_price, abs(t.last_px - p_retailprice) / p_retailprice AS price_diff,
    CASE WHEN n.p_retailprice IS NULL OR n.p_retailprice <= 0 THEN 'NO_DATA' WHEN abs(t.last_px - p_retailprice) / p_retailprice > 0.5 THEN 'PRICE_MISMATCH' ELSE 'OK' END AS flag
  FROM tickers t LEFT JOIN part n ON t.part = n.p_partkey AND n.p_partkey % 7 <> 0""", floats="price other_price price_diff", digits=8)
def _reconcile(v: Views):
    ours = v.tickers.selectExpr("symbol", "last_px AS price")
    ids = v.tickers.selectExpr("symbol", "part AS asset_id")
    other = v.table("part").where("p_partkey % 7 <> 0").selectExpr("p_partkey AS asset_id", "p_retailprice AS other_price")
    return reports.reconcile_prices(ours, ids, other, 0.5).select("symbol", "price", "other_price", "price_diff", "flag")


@query("join_labels_one_to_one", "SELECT p.prediction_id, p.probability, l.label_value FROM predictions p LEFT JOIN labels_24 l USING (symbol, signal_time)", ints="label_value")
def _attach(v: Views):
    p = v.rule_probs.selectExpr("*", "unix_micros(signal_time) DIV 3600000000L AS cell").selectExpr("concat_ws('-', symbol, CAST(cell AS STRING)) AS prediction_id", "symbol", "signal_time", "probability")
    return reports.attach_labels(p, v.labels, ["symbol", "signal_time"]).select("prediction_id", "probability", "label_value")


@query("dq_validate_predictions", """
  SELECT count(*) AS n_rows, count(*) FILTER (probability IS NULL OR label_value IS NULL) AS n_missing, count(*) FILTER (probability < 0 OR probability > 1) AS n_bad_probability,
    0 AS n_bad_threshold, count(*) FILTER (label_value NOT IN (0, 1)) AS n_bad_label, count(event_id) AS n_with_event, 0 AS n_duplicate_ids FROM predictions""",
       ints="n_bad_threshold n_duplicate_ids")
def _validate(v: Views):
    return reports.validate_predictions(v.predictions)


@query("join_resolved_training", """
  SELECT f.symbol, f.feature_time, f.price_ret_4h, r.prediction_id, r.label_value AS target_label, 'live' AS training_source FROM features f JOIN (
    SELECT *, row_number() OVER (PARTITION BY symbol, signal_time, horizon_hours ORDER BY prediction_id DESC) AS rn FROM outcomes WHERE label_value IN (0, 1)) r
  ON f.symbol = r.symbol AND f.feature_time = r.signal_time WHERE rn = 1""", views=PENDING, floats="price_ret_4h", ints="target_label")
def _resolved(v: Views):
    from tidemark.operators import features
    o = ordered.latest_per_key(outcomes(v).where("label_value IN (0, 1)").select("symbol", "signal_time", "horizon_hours", "prediction_id", "label_value"),
                               ["symbol", "signal_time", "horizon_hours"], ["prediction_id"])
    f = features.build_features(v.bare_timeline, ("price",)).select("symbol", "feature_time", "price_ret_4h")
    return f.join(o.withColumnRenamed("signal_time", "feature_time"), ["symbol", "feature_time"]).selectExpr(
        "symbol", "feature_time", "price_ret_4h", "prediction_id", "label_value AS target_label", "'live' AS training_source")


@query("join_historical_training", """
  SELECT f.symbol, f.feature_time, f.price_ret_4h, l.label_value AS target_label, 'historical:' || f.symbol || ':' || (epoch_us(f.feature_time) // 1000000) || ':24' AS prediction_id
  FROM features f JOIN labels_24 l ON f.symbol = l.symbol AND f.feature_time = l.signal_time WHERE l.label_value IN (0, 1)""", floats="price_ret_4h", ints="target_label")
def _historical(v: Views):
    f = labelled_features(v, ("price",))
    return f.selectExpr("symbol", "signal_time AS feature_time", "price_ret_4h", "label_value AS target_label",
                        "concat_ws(':', 'historical', symbol, CAST(unix_seconds(signal_time) AS STRING), '24') AS prediction_id")


@query("sink_append_idempotent", """
  SELECT user_id, epoch_us(ts) // 3600000000 AS cell, coalesce(min(seq) FILTER (seq % 5 = 0), min(seq)) AS seq FROM ticks GROUP BY ALL""")
def _append(v: Views):
    t = v.ticks.selectExpr("user_id", "unix_micros(ts) DIV 3600000000L AS cell", "seq")
    path = shared_folder(v.spark, "appended")
    # a first load of some rows, then all of them, and all of them again
    for rows in (t.where("seq % 5 = 0"), t, t):
        table = selection.append_new(rows, path, ["user_id", "cell"], ["seq"])
    return table


@query("sink_latest_snapshot", """
  SELECT symbol, seq, score FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) AS rn FROM scans) WHERE rn = 1 ORDER BY score DESC, symbol LIMIT 200""", floats="score")
def _snapshot(v: Views):
    newest = selection.latest_snapshot(v.scans).select("symbol", "seq", "score")
    path = shared_folder(v.spark, "snapshot")
    newest.coalesce(1).write.mode("overwrite").json(path)
    return v.spark.read.schema(newest.schema).json(path).orderBy(F.col("score").desc(), "symbol")


@query("sink_backfill_hits", """
  SELECT a.symbol, a.signal_time, coalesce(a.h, b.hit) AS hit, a.h IS NULL AND b.hit IS NOT NULL AS filled FROM (SELECT symbol, signal_time, CASE WHEN cell % 3 = 0 THEN hit END AS h FROM alerts) a
  LEFT JOIN alerts b USING (symbol, signal_time)""")
def _backfill(v: Views):
    open_ = v.alerts.selectExpr("symbol", "signal_time", "CASE WHEN cell % 3 = 0 THEN hit END AS hit", "CASE WHEN cell % 3 = 0 THEN hit_time END AS hit_time")
    return materialize(selection.fill_missing_hits(open_, v.alerts), "alerts").select("symbol", "signal_time", "hit", "filled")


COMPARE = {
    "truth": """
  SELECT symbol, signal_time, symbol || '_' || (epoch_us(min(target_time) OVER (PARTITION BY symbol, g)) // 1000000) AS truth_event, min(target_time) OVER (PARTITION BY symbol, g) AS event_target FROM (
    SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY target_time, signal_time ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT symbol, signal_time, target_time,
      CASE WHEN lag(target_time) OVER w IS NULL OR epoch_us(target_time) - epoch_us(lag(target_time) OVER w) >= 14400000000 THEN 1 ELSE 0 END AS nw
      FROM labels_24 WHERE label_value = 1 WINDOW w AS (PARTITION BY symbol ORDER BY target_time, signal_time)))""",
    "fdec": """
  SELECT *, CASE WHEN selected THEN row_number() OVER (PARTITION BY arm, signal_time, selected ORDER BY probability DESC, symbol) END AS rank FROM (
    SELECT r.symbol, r.signal_time, r.probability, l.label_value, x.a AS arm, x.s AS selected, r.symbol || '-' || (epoch_us(r.signal_time) // 43200000000) AS episode_id
    FROM (SELECT *, unnest([{'a': 'champion', 's': probability >= 0.5}, {'a': 'challenger', 's': ret_1 >= 0}]) AS x FROM rule_probs) r JOIN labels_24 l USING (symbol, signal_time))""",
    "fbase": """
  SELECT arm, count(*) AS anchors, count(label_value) AS resolved, count(*) FILTER (selected AND label_value IS NOT NULL) AS selected_resolved, count(*) FILTER (selected AND label_value = 1) AS tp,
    count(*) FILTER (label_value = 1) AS positive_anchors, count(DISTINCT CAST(signal_time AS DATE)) AS evaluation_days,
    count(*) FILTER (selected AND rank <= 10 AND label_value = 1)::DOUBLE / nullif(count(*) FILTER (selected AND rank <= 10 AND label_value IS NOT NULL), 0) AS precision_at_10,
    greatest(1.0, (epoch_us(max(signal_time)) - epoch_us(min(signal_time))) / 86400e6) AS days FROM fdec GROUP BY arm""",
    "fev": """
  SELECT arm, truth_event, min(event_target) AS target, min(signal_time) FILTER (selected AND label_value = 1) AS first_ FROM fdec JOIN truth USING (symbol, signal_time) GROUP BY arm, truth_event""",
    "fevents": """
  SELECT arm, count(*) AS positive_events, count(first_) AS caught_events, median(greatest(0.0, (epoch_us(target) - epoch_us(first_)) / 6e7)) FILTER (first_ IS NOT NULL) AS median_lead_time_minutes FROM fev GROUP BY arm""",
    "fepi": """
  SELECT arm, count(*) AS episodes_resolved, count(*) FILTER (y = 1) AS good, count(*) FILTER (y = 0) AS bad FROM (
    SELECT arm, episode_id, arg_min(label_value, (signal_time, symbol)) AS y FROM fdec WHERE selected AND label_value IS NOT NULL GROUP BY ALL) GROUP BY arm""",
    "fcmp": """
  SELECT arm, anchors, resolved, selected_resolved, tp, positive_anchors, evaluation_days, positive_events, caught_events, median_lead_time_minutes, episodes_resolved,
    tp::DOUBLE / nullif(selected_resolved, 0) AS anchor_precision, tp::DOUBLE / nullif(positive_anchors, 0) AS anchor_recall, caught_events::DOUBLE / nullif(positive_events, 0) AS event_recall, precision_at_10,
    good::DOUBLE / nullif(episodes_resolved, 0) AS episode_precision, bad / days AS false_candidates_per_day FROM fbase JOIN fevents USING (arm) JOIN fepi USING (arm)"""}


@query("met_filter_comparison", "SELECT * FROM fcmp", views=COMPARE,
       floats="median_lead_time_minutes anchor_precision anchor_recall event_recall precision_at_10 episode_precision false_candidates_per_day")
def _comparison(v: Views):
    return compared(v)


def compared(v: Views):
    # the labels are read for the decisions and for the truth events
    lab = materialize(v.labels.select("symbol", "signal_time", "label_value", "target_time"), "labels")
    return reports.filter_comparison(filter_decisions(v, lab), truth_rows(lab))


def filter_decisions(v: Views, lab):
    r = v.rule_probs.selectExpr("symbol", "signal_time", "probability", "concat_ws('-', symbol, CAST(unix_micros(signal_time) DIV 43200000000L AS STRING)) AS episode_id",
                                "inline(array(struct('champion' AS arm, probability >= 0.5D AS selected), struct('challenger' AS arm, ret_1 >= 0D AS selected)))")
    d = r.join(lab.select("symbol", "signal_time", "label_value"), ["symbol", "signal_time"])
    # ranks are kept with the decisions: one per scan, over the symbols of the scan
    return d.withColumn("rank", F.when(F.col("selected"), F.expr("row_number() OVER (PARTITION BY arm, signal_time, selected ORDER BY probability DESC, symbol)")))


def truth_rows(lab):
    from tidemark.operators.candidates import truth_events
    t = truth_events(lab.where("label_value = 1"))
    return t.select("symbol", "signal_time", "truth_event", F.expr("min(target_time) OVER (PARTITION BY truth_event) AS event_target"))


_FIRST = "arm = 'champion'", "arm = 'challenger'"
PAIRED = {**COMPARE,
    **drawn_sql("pev", f"SELECT truth_event, max(CASE WHEN {_FIRST[0]} AND first_ IS NOT NULL THEN 1 ELSE 0 END) AS a, max(CASE WHEN {_FIRST[1]} AND first_ IS NOT NULL THEN 1 ELSE 0 END) AS c, 1 AS one FROM fev GROUP BY 1", "a, c", "a c one", 10_000),
    **drawn_sql("pday", "SELECT CAST(signal_time AS DATE) AS day, " + ", ".join(f"count(*) FILTER ({w} AND label_value = 1) AS {x}h, count(*) FILTER ({w}) AS {x}n" for w, x in zip(_FIRST, "ac"))
                + " FROM fdec WHERE selected AND rank <= 10 AND label_value IS NOT NULL GROUP BY 1", "day", "ah an ch cn", 10_000),
    "paired": interval_sql("pev", "event_recall", "(sum(c) - sum(a))::DOUBLE / sum(one)", "(c - a)::DOUBLE / one", True) + " UNION ALL "
              + interval_sql("pday", "precision_at_10", "sum(ch)::DOUBLE / nullif(sum(cn), 0) - sum(ah)::DOUBLE / nullif(sum(an), 0)", "ch::DOUBLE / nullif(cn, 0) - ah::DOUBLE / nullif(an, 0)", True)}


@query("met_bootstrap_paired", "SELECT * FROM paired", views=PAIRED, floats="point ci_lower ci_upper", ints="n")
def _paired(v: Views):
    """Differences of two filters under the same draws of events and of days."""
    lab = materialize(v.labels.select("symbol", "signal_time", "label_value", "target_time"), "labels")
    return resample.paired_filter_intervals(materialize(filter_decisions(v, lab), "decisions"), materialize(truth_rows(lab), "truth"))


@query("met_filter_gates", """
  WITH x AS (SELECT least(a.resolved, b.resolved) >= 200 AS g1, a.positive_events >= 50 AS g2, greatest(a.evaluation_days, b.evaluation_days) >= 14 AS g3,
      coalesce(b.precision_at_10 >= a.precision_at_10 * 1.1::DOUBLE, FALSE) AS p1, coalesce(b.event_recall >= a.event_recall - 0.05::DOUBLE, FALSE) AS p2,
      b.false_candidates_per_day <= a.false_candidates_per_day AS p3, coalesce(b.event_recall >= 0.8::DOUBLE, FALSE) AS p4,
      (SELECT coalesce(max(ci_lower) > 0, FALSE) FROM paired WHERE kind = 'precision_at_10') AS p5, (SELECT coalesce(max(ci_lower) >= -0.05::DOUBLE, FALSE) FROM paired WHERE kind = 'event_recall') AS p6
      FROM fcmp a, fcmp b WHERE a.arm = 'champion' AND b.arm = 'challenger')
  SELECT unnest(['insufficient_resolved_outcomes','insufficient_positive_events','evaluation_window_too_short','precision_at_10_gate_failed','recall_guardrail_failed','false_candidate_guardrail_failed',
      'minimum_event_recall_failed','precision_ci_gate_failed','recall_ci_guardrail_failed']) AS reason,
    unnest([g1, g2, g3, CASE WHEN g1 AND g2 AND g3 THEN p1 END, CASE WHEN g1 AND g2 AND g3 THEN p2 END, CASE WHEN g1 AND g2 AND g3 THEN p3 END, CASE WHEN g1 AND g2 AND g3 THEN p4 END,
      CASE WHEN g1 AND g2 AND g3 THEN p5 END, CASE WHEN g1 AND g2 AND g3 THEN p6 END]) AS passed FROM x""",
       views=PAIRED)
def _gates(v: Views):
    """All nine gates; a missing interval fails its gate."""
    lab = materialize(v.labels.select("symbol", "signal_time", "label_value", "target_time"), "labels")
    decisions, truth = materialize(filter_decisions(v, lab), "decisions"), materialize(truth_rows(lab), "truth")
    low = resample.lower_ends(resample.paired_filter_intervals(decisions, truth))
    return reports.promotion_gates(materialize(reports.filter_comparison(decisions, truth), "comparison"), materialize(low, "intervals"))

"""Queries of sources, sinks, splits, training and streaming."""
from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions.columns import with_exprs
from tidemark.operators import calibrate, champion, features, indicators, labels, metrics, ml, ordered, reports, resample, splits
from tidemark.plans.q_labels import REGIME, barrier_signals, moved
from tidemark.plans.q_metrics import AP, BASE, DRAWN, EDGES, _ece_sql, baseline_counts, day_blocks, interval_sql, labelled_features, newest_third
from tidemark.plans.q_scoring import small_bars
from tidemark.plans.registry import query
from tidemark.plans.views import Views
from tidemark.sources import envelopes, tables
from tidemark.streaming import jobs

START, END = datetime(2024, 1, 1), datetime(2024, 1, 30)


def pages(v: Views, rows, payload: str, endpoint: str):
    """Pages as they land: one JSON object per symbol and day, holding at most a day of records."""
    g = rows.withColumn("_day", F.expr("cell DIV 24")).groupBy("symbol", "_day").agg(F.expr(f"sort_array(collect_list(struct(cell, {payload} AS p))) AS ps"))
    return g.selectExpr(
        "'run-1' AS collection_run_id", "concat(symbol, '-', _day) AS request_id", "'venue' AS provider", "'usdm' AS product", f"'{endpoint}' AS endpoint",
        "to_json(named_struct('symbol', symbol, 'period', '1h')) AS request_params_json", "'2024-02-01T00:00:00Z' AS requested_at", "'2024-02-01T00:00:01Z' AS received_at",
        "200 AS http_status", "'' AS response_hash_sha256", "'v1' AS source_version", "'c1' AS collector_version",
        "concat('[', array_join(transform(ps, x -> x.p), ','), ']') AS payload_json")


def bar_pages(v: Views):
    ms = lambda c: f"unix_millis({c})"
    return pages(v, v.bars_1h, f"concat('[', {ms('open_time')}, ',\"', open, '\",\"', high, '\",\"', low, '\",\"', close, '\",\"', volume_base, '\",', {ms('close_time')}, "
                 "',\"', CAST(CAST(volume_quote AS DECIMAL(20,8)) AS STRING), '\",', trade_count, ',\"', taker_buy_base, '\",\"0\"]')", "klines")


BAR_SQL = """SELECT symbol, '1h' AS interval, close_time AS event_time, close_time + INTERVAL 1 SECOND AS available_time, open_time, open, high, low, close, volume_base, volume_quote, trade_count,
    taker_buy_base FROM bars_1h"""
BAR_COLS = ["symbol", "interval", "event_time", "available_time", "open_time", "open", "high", "low", "close", "volume_base", "volume_quote", "trade_count", "taker_buy_base"]
BAR_F = "open high low close volume_base volume_quote taker_buy_base"


@query("norm_kline", BAR_SQL, floats=BAR_F)
def _kline(v: Views):
    return envelopes.normalize_bars(bar_pages(v)).select(*BAR_COLS)


@query("src_envelope_jsonl", BAR_SQL, floats=BAR_F)
def _jsonl(v: Views):
    path = tables.shared_folder(v.spark, "raw")
    bar_pages(v).write.json(path)
    return envelopes.normalize_bars(envelopes.read_envelopes(v.spark, path)).select(*BAR_COLS)


@query("src_inventory", """
  SELECT symbol, 'klines' AS endpoint, count(*) AS n_rows, TIMESTAMP '2024-02-01 00:00:01' AS first_received, TIMESTAMP '2024-02-01 00:00:01' AS last_received, TRUE AS has_files FROM bars_1h GROUP BY symbol""", ints="n_rows")
def _inventory(v: Views):
    path = tables.shared_folder(v.spark, "raw")
    bar_pages(v).write.json(path)
    return envelopes.inventory(envelopes.read_envelopes(v.spark, path)).withColumn("has_files", F.col("n_files") >= 1).drop("n_files")


@query("norm_funding", "SELECT symbol, event_time, available_time, round(funding_rate, 6) AS funding_rate, round(mark_price, 6) AS mark_price FROM funding", floats="funding_rate mark_price", digits=8)
def _norm_funding(v: Views):
    f = v.funding.selectExpr("symbol", "unix_micros(event_time) DIV 3600000000L AS cell", "event_time", "funding_rate", "mark_price")
    p = pages(v, f, "to_json(named_struct('symbol', symbol, 'fundingTime', unix_millis(event_time), 'fundingRate', format_number(round(funding_rate, 6), '0.000000'), "
                    "'markPrice', format_number(round(mark_price, 6), '0.000000')))", "funding")
    return envelopes.normalize_funding(p).select("symbol", "event_time", "available_time", "funding_rate", "mark_price")


def side_pages(v: Views, side, fields: str, endpoint: str):
    s = side.withColumn("cell", F.expr("unix_micros(period_end) DIV 3600000000L"))
    return pages(v, s, f"to_json(named_struct('symbol', symbol, {fields}, 'timestamp', unix_millis(period_end)))", endpoint)


def _clock(cols: str, view: str) -> str:
    return (f"SELECT symbol, period_end AS period_start, period_end + INTERVAL 5 MINUTE AS period_end, period_end + INTERVAL 5 MINUTE + INTERVAL 1 SECOND AS available_time, {cols} FROM {view}")


CLOCK = ["symbol", "period_start", "period_end", "available_time"]


@query("norm_open_interest", _clock("open_interest_contracts, open_interest_value", "oi"), floats="open_interest_contracts open_interest_value")
def _norm_oi(v: Views):
    p = side_pages(v, v.oi, "'sumOpenInterest', CAST(CAST(open_interest_contracts AS DECIMAL(20,8)) AS STRING), 'sumOpenInterestValue', CAST(CAST(open_interest_value AS DECIMAL(20,8)) AS STRING)", "oi")
    return envelopes.normalize_open_interest(p).select(*CLOCK, "open_interest_contracts", "open_interest_value")


@query("norm_taker", _clock("buy_volume, sell_volume, buy_sell_ratio", "taker"), floats="buy_volume sell_volume buy_sell_ratio", digits=8)
def _norm_taker(v: Views):
    p = side_pages(v, v.taker, "'buyVol', CAST(CAST(buy_volume AS DECIMAL(20,8)) AS STRING), 'sellVol', CAST(CAST(sell_volume AS DECIMAL(20,8)) AS STRING), "
                               "'buySellRatio', CAST(CAST(buy_sell_ratio AS DECIMAL(20,8)) AS STRING)", "taker")
    return envelopes.normalize_taker(p).select(*CLOCK, "buy_volume", "sell_volume", "buy_sell_ratio")


RATIO_FIELDS = ("'longShortRatio', CAST(CAST(long_short_ratio AS DECIMAL(20,8)) AS STRING), 'longAccount', CAST(CAST(long_account AS DECIMAL(20,8)) AS STRING), "
                "'shortAccount', CAST(CAST(short_account AS DECIMAL(20,8)) AS STRING)")


@query("norm_global_ratio", _clock("long_account, short_account, long_short_ratio", "global_ratio"), floats="long_account short_account long_short_ratio")
def _norm_global(v: Views):
    return envelopes.normalize_account_ratio(side_pages(v, v.global_ratio, RATIO_FIELDS, "global")).select(*CLOCK, "long_account", "short_account", "long_short_ratio")


@query("norm_top_ratio", _clock("long_account, short_account, long_short_ratio, 'top_trader_accounts' AS population", "top_ratio"), floats="long_account short_account long_short_ratio")
def _norm_top(v: Views):
    return envelopes.normalize_account_ratio(side_pages(v, v.top_ratio, RATIO_FIELDS, "top"), top=True).select(
        *CLOCK, "long_account", "short_account", "long_short_ratio", "population")


@query("norm_top_position", _clock("round(long_position, 4) AS long_position, round(short_position, 4) AS short_position, round(long_position, 4) / round(short_position, 4) AS long_short_ratio, 'top_trader_positions' AS population", "top_position WHERE round(short_position, 4) > 0"),
       floats="long_position short_position long_short_ratio", digits=8)
def _norm_position(v: Views):
    """Pages without a ratio: it is derived, and underivable records are rejected."""
    p = side_pages(v, v.top_position, "'longPosition', CAST(CAST(round(long_position, 4) AS DECIMAL(20,8)) AS STRING), 'shortPosition', CAST(CAST(round(short_position, 4) AS DECIMAL(20,8)) AS STRING)", "position")
    return envelopes.normalize_top_position(p)[0].select(*CLOCK, "long_position", "short_position", "long_short_ratio", "population")


@query("src_high_watermark", """
  SELECT t.symbol, t.seq, t.ts FROM ticks t LEFT JOIN (SELECT symbol, max(ts) AS m FROM ticks WHERE seq % 2 = 0 AND symbol <> 'view' AND ts < TIMESTAMP '2024-01-20' GROUP BY symbol) w USING (symbol)
  WHERE m IS NULL OR t.ts > m""")
def _watermark(v: Views):
    t = v.ticks.select("symbol", "seq", "ts")
    marks = envelopes.high_watermark(t.where("seq % 2 = 0 AND symbol <> 'view' AND ts < TIMESTAMP '2024-01-20 00:00:00'"), ["symbol"], "ts")
    return envelopes.after_watermark(t, marks, ["symbol"], "ts")


@query("src_parquet_glob", "SELECT symbol, cell, close, CASE WHEN cell % 2 = 0 THEN trade_count END AS trade_count FROM bars_1h", floats="close")
def _glob(v: Views):
    """Two folders with different columns read as one table by name."""
    root = tables.shared_folder(v.spark, "lake")
    b = v.bars_1h.select("symbol", "cell", "close", "trade_count")
    b.where("cell % 2 = 0").write.parquet(f"{root}/a/one")
    b.where("cell % 2 = 1").drop("trade_count").write.parquet(f"{root}/b/two")
    return tables.read_merged(v.spark, root).select("symbol", "cell", "close", "trade_count")


@query("src_evidence_table", "SELECT prediction_id, probability, label_value FROM judged", floats="probability", ints="label_value")
def _evidence(v: Views):
    """The same evidence written and read as CSV, JSON and Parquet must agree."""
    root = tables.shared_folder(v.spark, "evidence")
    j = v.judged.select("prediction_id", "probability", "label_value")
    schema = "prediction_id string, probability double, label_value int"
    j.write.parquet(f"{root}/p.parquet")
    saved = tables.read_evidence(v.spark, f"{root}/p.parquet")
    saved.write.option("header", True).csv(f"{root}/c.csv")
    saved.write.json(f"{root}/j.jsonl")
    c, k = tables.read_evidence(v.spark, f"{root}/c.csv", schema), tables.read_evidence(v.spark, f"{root}/j.jsonl", schema)
    return c.intersect(k).intersect(saved.select(*c.columns))


@query("sink_partition_layout", "SELECT symbol, cell, close, '1h' AS interval, CAST(close_time AS DATE) AS date FROM bars_1h", floats="close")
def _layout(v: Views):
    path = tables.layout(tables.shared_folder(v.spark, "lake"), "normalized", kind="klines")
    tables.write_partitioned(v.bars_1h.selectExpr("symbol", "cell", "close", "'1h' AS interval", "to_date(close_time) AS date"), path, ["interval", "date"])
    return v.spark.read.parquet(path)


@query("sink_parquet_atomic", "SELECT symbol, period_end, open_interest_contracts FROM oi", floats="open_interest_contracts")
def _atomic(v: Views):
    path = tables.shared_folder(v.spark, "oi")
    v.oi.select("symbol", "period_end", "open_interest_contracts").write.mode("errorifexists").parquet(path)
    return v.spark.read.parquet(path)


@query("sink_dataset_export", "SELECT count(*) AS n_rows, min(feature_time) AS first_time, max(feature_time) AS last_time, TRUE AS same_content FROM aligned")
def _export(v: Views):
    path = tables.shared_folder(v.spark, "dataset")
    out = tables.export_dataset(v.aligned, path, "feature_time", ["symbol", "feature_time", "close"])
    source = reports.dataset_fingerprint(v.aligned, ["symbol", "feature_time", "close"]).select("fingerprint")
    return out.withColumn("same_content", F.col("fingerprint") == source.scalar()).drop("fingerprint")


FOLD_PLAN = splits.walk_forward_plan(START, END, train=10, val=4, test=4, step=4, embargo_hours=24, holdout=3)
FOLDS = {"plan": "SELECT * FROM (VALUES " + ", ".join(f"({f}, '{s}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for f, s, a, b in FOLD_PLAN) + ") t(fold_idx, split, a, b)"}


@query("split_walk_forward", "SELECT j.prediction_id, p.fold_idx, p.split FROM judged j JOIN plan p ON j.signal_time >= p.a AND j.signal_time < p.b", views=FOLDS)
def _walk(v: Views):
    return splits.assign_splits(v.judged.select("prediction_id", "signal_time"), FOLD_PLAN).select("prediction_id", "fold_idx", "split")


RUN_PLAN = splits.expanding_plan(START, END)
RUNS = {"rplan": "SELECT * FROM (VALUES " + ", ".join(f"({f}, '{s}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for f, s, a, b in RUN_PLAN) + ") t(fold_idx, split, a, b)"}


@query("split_runner_folds", "SELECT p.fold_idx, p.split, count(*) AS n, sum(j.label_value)::BIGINT AS n_positive FROM judged j JOIN rplan p ON j.signal_time >= p.a AND j.signal_time < p.b GROUP BY ALL", views=RUNS)
def _runner(v: Views):
    return splits.assign_splits(v.judged.select("label_value", "signal_time"), RUN_PLAN).groupBy("fold_idx", "split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label_value").alias("n_positive"))


@query("split_audit", """
  SELECT fold_idx, count(*) AS n FROM judged j JOIN plan p ON j.signal_time >= p.a AND j.signal_time < p.b WHERE p.split = 'test' AND EXISTS (
    SELECT 1 FROM plan h WHERE h.split = 'holdout' AND p.b > h.a - INTERVAL 24 HOUR) GROUP BY fold_idx""", views=FOLDS)
def _audit(v: Views):
    """Test rows of folds that break the plan; a sound plan has none."""
    bad = splits.audit_plan(splits.plan_frame(v.spark, FOLD_PLAN)).select("fold_idx").distinct()
    rows = splits.assign_splits(v.judged.select("signal_time"), FOLD_PLAN).where("split = 'test'")
    return rows.join(F.broadcast(bad), "fold_idx").groupBy("fold_idx").agg(F.count(F.lit(1)).alias("n"))


@query("split_event_safe", """
  WITH m AS (SELECT j.event_id, j.signal_time, p.fold_idx || ':' || p.split AS s FROM judged j LEFT JOIN plan p ON j.signal_time >= p.a AND j.signal_time < p.b WHERE event_id IS NOT NULL),
  bad AS (SELECT event_id FROM m GROUP BY event_id HAVING count(DISTINCT coalesce(s, '-')) > 1)
  SELECT prediction_id, event_id FROM judged WHERE event_id IS NULL OR event_id NOT IN (SELECT event_id FROM bad)""", views=FOLDS)
def _safe(v: Views):
    return splits.event_safe(v.judged.select("prediction_id", "event_id", "signal_time"), FOLD_PLAN)[0].select("prediction_id", "event_id")


@query("join_semi_anti_events", """
  SELECT prediction_id FROM judged WHERE event_id IS NULL OR event_id NOT IN (SELECT event_id FROM judged WHERE event_id IS NOT NULL GROUP BY event_id HAVING min(cell % 2) <> max(cell % 2))""")
def _semi(v: Views):
    j = v.judged.select("prediction_id", "event_id", "cell")
    bad = j.where("event_id IS NOT NULL").groupBy("event_id").agg(F.min(F.col("cell") % 2).alias("a"), F.max(F.col("cell") % 2).alias("b")).where("a <> b")
    return j.join(bad.select("event_id"), "event_id", "left_anti").select("prediction_id")


@query("split_chrono_fraction", """
  SELECT prediction_id, CASE WHEN epoch_us(signal_time) < (SELECT quantile_cont(epoch_us(signal_time)::DOUBLE, 0.8) FROM judged) THEN 'fit' ELSE 'calibrate' END AS part FROM judged""")
def _chrono(v: Views):
    return splits.chronological_cut(v.judged.select("prediction_id", "signal_time"), 0.8).select("prediction_id", "part")


@query("sink_report_by_fold", "SELECT j.prediction_id, p.fold_idx, j.probability FROM judged j JOIN plan p ON j.signal_time >= p.a AND j.signal_time < p.b WHERE p.split = 'test'", views=FOLDS, floats="probability")
def _by_fold(v: Views):
    path = tables.shared_folder(v.spark, "report")
    tables.write_by_fold(splits.assign_splits(v.judged.select("prediction_id", "signal_time", "probability"), FOLD_PLAN).where("split = 'test'"), path)
    # no row, no file: the schema can't come from the folder
    return v.spark.read.schema("prediction_id string, fold_idx int, probability double").parquet(path)


# --- inputs of models ------------------------------------------------------------------------------------------------

# All features; those that the training window hardly has are left out by each run.
COLS = list(features.FEATURE_NAMES)
GROUPS = tuple(features.FEATURES)
TREES = 40


@query("prj_ablation", "SELECT variant, count(*) AS n, count(price_ret_4h) AS price, count(volume_percentile_24h) AS volume, count(funding_rate_raw) AS funding, count(oi_change_4h) AS oi, count(taker_buy_ratio) AS taker "
       "FROM (SELECT variant, CASE WHEN variant <> '' THEN price_ret_4h END AS price_ret_4h, CASE WHEN variant NOT IN ('price_only','price_derivs') THEN volume_percentile_24h END AS volume_percentile_24h, "
       "CASE WHEN variant NOT IN ('price_only','price_volume','no_funding') THEN funding_rate_raw END AS funding_rate_raw, CASE WHEN variant NOT IN ('price_only','price_volume','no_oi') THEN oi_change_4h END AS oi_change_4h, "
       "CASE WHEN variant NOT IN ('price_only','price_volume','no_taker') THEN taker_buy_ratio END AS taker_buy_ratio FROM features, "
       "(SELECT unnest(['full','price_only','price_volume','price_derivs','no_funding','no_oi','no_taker','no_ratios']) AS variant)) GROUP BY variant")
def _ablation(v: Views):
    f = ml.ablate(v.features)
    return f.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(n) for n, c in (
        ("price", "price_ret_4h"), ("volume", "volume_percentile_24h"), ("funding", "funding_rate_raw"), ("oi", "oi_change_4h"), ("taker", "taker_buy_ratio"))])


@query("prj_ablation_eval", "SELECT variant, count(*) AS n, avg((p >= 0.5)::INT) AS share FROM (SELECT variant, 1 / (1 + exp(-(coalesce(price_ret_4h, 0) * 10 + CASE WHEN variant IN ('price_only','price_volume','no_taker') THEN 0 ELSE taker_buy_ratio - 0.5 END))) AS p "
       "FROM features, (SELECT unnest(['full','price_only','price_volume','price_derivs','no_funding','no_oi','no_taker','no_ratios']) AS variant)) GROUP BY variant", floats="share")
def _ablation_eval(v: Views):
    """One evaluator over all variants."""
    f = ml.ablate(v.features.select("price_ret_4h", "taker_buy_ratio", "symbol"))
    p = F.expr("1 / (1 + exp(-(coalesce(price_ret_4h, 0D) * 10 + coalesce(taker_buy_ratio - 0.5D, 0D))))")
    return f.groupBy("variant").agg(F.count(F.lit(1)).alias("n"), F.avg((p >= 0.5).cast("int")).alias("share"))


@query("flt_null_heavy_features", "SELECT unnest(['price_ret_24h','funding_change_24h','oi_acceleration_1h','taker_buy_ratio']) AS column_name, "
       "unnest([avg((price_ret_24h IS NULL)::INT), avg((funding_change_24h IS NULL)::INT), avg((oi_acceleration_1h IS NULL)::INT), avg((taker_buy_ratio IS NULL)::INT)]) AS null_share FROM features", floats="null_share")
def _nulls(v: Views):
    return ml.null_shares(v.features, ["price_ret_24h", "funding_change_24h", "oi_acceleration_1h", "taker_buy_ratio"])


@query("flt_feature_availability", "SELECT column_name, null_share <= 0.5 AS usable FROM (SELECT unnest(['price_ret_24h','funding_change_24h','oi_acceleration_1h','taker_buy_ratio']) AS column_name, "
       "unnest([avg((price_ret_24h IS NULL)::INT), avg((funding_change_24h IS NULL)::INT), avg((oi_acceleration_1h IS NULL)::INT), avg((taker_buy_ratio IS NULL)::INT)]) AS null_share FROM features WHERE feature_time < TIMESTAMP '2024-01-15')")
def _availability(v: Views):
    """Availability in the training window only."""
    f = v.features.where("feature_time < TIMESTAMP '2024-01-15 00:00:00'")
    return ml.null_shares(f, ["price_ret_24h", "funding_change_24h", "oi_acceleration_1h", "taker_buy_ratio"]).selectExpr("column_name", "null_share <= 0.5 AS usable")


@query("prj_median_impute", "SELECT symbol, feature_time, coalesce(price_ret_4h, m) AS price_ret_4h, (price_ret_4h IS NULL)::INT AS missing FROM features, (SELECT median(price_ret_4h) AS m FROM features WHERE feature_time < TIMESTAMP '2024-01-15')", floats="price_ret_4h")
def _impute(v: Views):
    from tidemark.operators.quantiles import exact_percentiles
    f = features.build_features(v.bare_timeline, ("price",)).select("symbol", "feature_time", "price_ret_4h")
    m = exact_percentiles(f.where("feature_time < TIMESTAMP '2024-01-15 00:00:00'"), (), F.col("price_ret_4h"), {"m": 0.5})
    return ordered.with_scalar(f, m, "m").selectExpr("symbol", "feature_time", "coalesce(price_ret_4h, m) AS price_ret_4h", "CAST(price_ret_4h IS NULL AS INT) AS missing")


@query("prj_missing_policy", "SELECT symbol, feature_time, last_value(fr IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY feature_time ROWS UNBOUNDED PRECEDING) AS filled, coalesce(fr, 0.0) AS zero FROM (SELECT symbol, feature_time, funding_rate_last_known AS fr FROM timeline)",
       floats="filled zero", digits=8)
def _missing(v: Views):
    t = v.timeline.select("symbol", "feature_time", F.col("funding_rate_last_known").alias("fr"))
    return ordered.running_last(t, ["symbol"], "feature_time", ["feature_time"], F.col("fr"), "filled").selectExpr("symbol", "feature_time", "filled", "coalesce(fr, 0D) AS zero")


@query("dq_leakage_columns", "SELECT symbol, 0 AS n_backward FROM timeline GROUP BY symbol", ints="n_backward")
def _leakage(v: Views):
    """Rows whose position and time disagree per symbol; forbidden names fail before any job runs."""
    assert ml.forbidden_columns(COLS) == []
    t = ordered.row_blocks(v.bare_timeline, "_pos", 4096, before=1)
    back = t.selectExpr("symbol", ordered.OWN, f"lag(feature_time) OVER (PARTITION BY symbol, {ordered.SLICE} ORDER BY _pos) > feature_time AS b").where(ordered.OWN)
    return back.groupBy("symbol").agg(F.count_if("b").alias("n_backward"))


@query("ml_scaler", "SELECT symbol, feature_time, (close - a) / CASE WHEN s = 0 THEN 1 ELSE s END AS close FROM path_bars, (SELECT avg(close) AS a, stddev_pop(close) AS s FROM path_bars)", floats="close")
def _scaler(v: Views):
    return ml.standard_scale(v.path_bars.select("symbol", "feature_time", "close"), ["close"])


def _train_test(v: Views):
    f = tables.materialize(labelled_features(v, GROUPS).select("symbol", "signal_time", "label_value", *COLS), "train")
    # the horizon of a training row ends before the newest third begins
    f = newest_third(f.withColumn("_end", F.expr("signal_time + INTERVAL 24 HOURS")), "signal_time", "_test")
    begin = f.where("_test").agg(F.min("signal_time")).scalar()
    return f.where(F.col("_end") < begin).drop("_end", "_test"), f.where("_test").drop("_end", "_test")


@query("ml_logistic")
def _logistic(v: Views):
    train, test = _train_test(v)
    return ml.evaluate(ml.score(ml.fit_classifier(train, ml.usable_columns(train, COLS), balanced=True), test), 0.5)


@query("ml_gbt")
def _gbt(v: Views):
    train, test = _train_test(v)
    """Boosted trees on the older four fifths of the training rows; calibration and threshold on the rest of them."""
    cut = splits.chronological_cut(train, 0.8)
    fit, rest = cut.where("part = 'fit'").drop("part"), cut.where("part = 'calibrate'").drop("part")
    model = ml.fit_classifier(fit, ml.usable_columns(fit, COLS), kind="trees", trees=TREES)
    calibrated = ml.fit_isotonic(ml.score(model, rest))
    apply = lambda df: ml.apply_isotonic(calibrated, ml.score(model, df)).drop("probability").withColumnRenamed("calibrated", "probability")
    threshold = ml.pick_threshold(apply(rest))
    return ml.evaluate(apply(test), threshold).withColumn("threshold", F.lit(threshold))


HORIZON_PARTS = {
    "span": "SELECT min(epoch_us(signal_time)) AS lo, max(epoch_us(signal_time)) - min(epoch_us(signal_time)) AS wide FROM labels_all WHERE label_value IS NOT NULL",
    "hparts": """
  SELECT horizon_hours, label_value, CASE WHEN t + h < lo + wide * 6 // 10 THEN 'train' WHEN t < lo + wide * 6 // 10 THEN NULL WHEN t + h < lo + wide * 8 // 10 THEN 'calibrate' WHEN t < lo + wide * 8 // 10 THEN NULL ELSE 'score' END AS part
  FROM span, (SELECT *, epoch_us(signal_time) AS t, horizon_hours * 3600000000 AS h FROM labels_all WHERE label_value IS NOT NULL)"""}


def horizon_rows(v: Views):
    """One long table of features and labels keyed by horizon, in parts by time. A row whose horizon reaches into the next part is in none."""
    f = features.build_features(v.timeline, GROUPS).withColumnRenamed("feature_time", "signal_time").select("symbol", "signal_time", *COLS)
    lab = labels.label_paths(v.path_bars, gap_minutes=180).where("label_value IS NOT NULL").select("symbol", "signal_time", "horizon_hours", "label_value")
    lab = tables.materialize(lab, "labels")
    t = F.unix_micros("signal_time")
    lab = lab.withColumn("_s", lab.agg(F.min(t).alias("lo"), (F.max(t) - F.min(t)).alias("wide")).select(F.struct("lo", "wide")).scalar())
    end = "unix_micros(signal_time) + horizon_hours * 3600000000L"
    cut = lambda tenths: f"_s.lo + _s.wide * {tenths} DIV 10"
    lab = lab.selectExpr("* EXCEPT (_s)", f"CASE WHEN {end} < {cut(6)} THEN 'train' WHEN unix_micros(signal_time) < {cut(6)} THEN NULL "
                         f"WHEN {end} < {cut(8)} THEN 'calibrate' WHEN unix_micros(signal_time) < {cut(8)} THEN NULL ELSE 'score' END AS part").where("part IS NOT NULL")
    return tables.materialize(lab.join(f, ["symbol", "signal_time"]), "horizon-rows")


def horizon_scores(rows):
    """All horizons' models fitted at once from the long table; raw scores of the calibration and scoring rows."""
    train = rows.where("part = 'train'")
    usable = ml.usable_by(train, "horizon_hours", COLS)
    models = ml.fit_concurrently({h: train.where(F.col("horizon_hours") == h) for h in usable}, usable)
    out = None
    for h, model in models.items():
        s = ml.score(model, rows.where((F.col("part") != "train") & (F.col("horizon_hours") == h))).select("symbol", "signal_time", "horizon_hours", "label_value", "part", "probability")
        out = s if out is None else out.unionByName(s)
    return tables.materialize(out, "horizon-scores")


@query("ml_horizon_models", """
  SELECT horizon_hours, count(*) FILTER (part = 'train') AS n_train, sum(label_value) FILTER (part = 'train') AS n_positive, count(*) FILTER (part = 'calibrate') AS n_calibrate, count(*) FILTER (part = 'score') AS n_scored,
    avg(label_value) FILTER (part = 'calibrate') AS prevalence, avg(label_value) FILTER (part = 'calibrate') AS isotonic_mean, avg(label_value) FILTER (part = 'calibrate') AS platt_mean, TRUE AS bounded, TRUE AS rising
  FROM hparts GROUP BY horizon_hours""", views=HORIZON_PARTS, floats="prevalence isotonic_mean platt_mean", ints="horizon_hours n_train n_positive n_calibrate n_scored")
def _horizons(v: Views):
    """A model and two calibrators per horizon.

    Whatever the coefficients, a fitted calibrator keeps the positives: on its own rows the calibrated mean is the prevalence. Scores stay in [0, 1],
    and the isotonic ones never fall where the raw ones rise.
    """
    rows = horizon_rows(v)
    scores = horizon_scores(rows)
    fit, key = scores.where("part = 'calibrate'"), ["horizon_hours"]
    both = calibrate.apply_isotonic_groups(scores, calibrate.fit_isotonic_groups(fit, key), key, out="isotonic")
    both = tables.materialize(calibrate.apply_platt_groups(both, calibrate.fit_platt_groups(fit, key), key, out="platt"), "calibrated")
    # stretches of equal raw scores to four digits, in order, have maxima and minima that rise
    order = both.groupBy("horizon_hours", F.floor(F.col("probability") * 10_000).alias("cell")).agg(F.min("isotonic").alias("lo"), F.max("isotonic").alias("hi"))
    order = order.selectExpr("horizon_hours", "coalesce(lag(hi) OVER (PARTITION BY horizon_hours ORDER BY cell) <= lo + 1e-12, true) AS ok").groupBy("horizon_hours").agg(F.bool_and("ok").alias("rising"))
    own = F.col("part") == "calibrate"
    out = both.groupBy("horizon_hours").agg(
        F.count_if(own).alias("n_calibrate"), F.count_if(~own).alias("n_scored"), F.avg(F.when(own, F.col("label_value"))).alias("prevalence"),
        F.avg(F.when(own, F.col("isotonic"))).alias("isotonic_mean"), F.avg(F.when(own, F.col("platt"))).alias("platt_mean"),
        F.bool_and(F.expr("isotonic BETWEEN 0 AND 1 AND platt BETWEEN 0 AND 1")).alias("bounded"))
    n = rows.where("part = 'train'").groupBy("horizon_hours").agg(F.count(F.lit(1)).alias("n_train"), F.sum("label_value").alias("n_positive"))
    return out.join(n, "horizon_hours").join(order, "horizon_hours").select(
        "horizon_hours", "n_train", "n_positive", "n_calibrate", "n_scored", "prevalence", "isotonic_mean", "platt_mean", "bounded", "rising")


CALIBRATE = {
    "cal": """
  SELECT prediction_id, symbol, round(probability, 6) AS x, label_value AS y, epoch_us(signal_time) - min(epoch_us(signal_time)) OVER () < quantile_cont((epoch_us(signal_time) - f)::DOUBLE, 0.8) OVER () AS fit
  FROM judged, (SELECT min(epoch_us(signal_time)) AS f FROM judged)""",
    "cell": "SELECT symbol, x, count(*) AS n, sum(y) AS pos FROM cal WHERE fit GROUP BY ALL",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY x) AS i FROM cell",
    "spans": """
  SELECT a.symbol, a.i AS a, b.i AS b, sum(b.pos) OVER w::DOUBLE / sum(b.n) OVER w AS m FROM ranked a JOIN ranked b ON a.symbol = b.symbol AND b.i >= a.i WINDOW w AS (PARTITION BY a.symbol, a.i ORDER BY b.i)""",
    "least": "SELECT symbol, a, b AS i, min(m) OVER (PARTITION BY symbol, a ORDER BY b DESC) AS m FROM spans",
    "steps": "SELECT r.symbol, r.x, max(l.m) AS y FROM ranked r JOIN least l ON r.symbol = l.symbol AND r.i = l.i GROUP BY ALL",
    "newton": """
  SELECT * FROM (WITH RECURSIVE t(symbol, k, a, b) AS (
    SELECT symbol, 0, 0.0::DOUBLE, ln(sum(pos)::DOUBLE / (sum(n) - sum(pos))) FROM cell GROUP BY symbol HAVING sum(pos) > 0 AND sum(pos) < sum(n)
    UNION ALL
    SELECT symbol, k + 1, a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM (
      SELECT symbol, k, any_value(a) AS a, any_value(b) AS b, sum((n * s - pos) * x) + any_value(a) AS ga, sum(n * s - pos) AS gb, sum(n * s * (1 - s) * x * x) + 1 AS haa,
        sum(n * s * (1 - s) * x) AS hab, sum(n * s * (1 - s)) AS hbb FROM (SELECT t.symbol, k, a, b, n, pos, x, 1 / (1 + exp(-(a * x + b))) AS s FROM t JOIN cell c ON c.symbol = t.symbol WHERE k < 20) GROUP BY symbol, k))
  SELECT symbol, a, b FROM t WHERE k = 20)"""}


def calibration_rows(v: Views):
    """Judged rows with their scores to six digits, of the older four fifths to fit and the rest to calibrate."""
    j = v.judged.selectExpr("prediction_id", "symbol", "signal_time", "round(probability, 6) AS probability", "label_value")
    j = splits.chronological_cut(tables.materialize(j, "judged"), 0.8)
    return j.where("part = 'fit'").drop("part", "signal_time"), j.where("part = 'calibrate'").drop("part", "signal_time")


@query("ml_calibrate_isotonic", """
  SELECT prediction_id, c.symbol, c.x AS probability, c.y AS label_value, CASE WHEN lo.x IS NULL THEN hi.y WHEN hi.x IS NULL OR hi.x = lo.x THEN lo.y ELSE lo.y + (c.x - lo.x) / (hi.x - lo.x) * (hi.y - lo.y) END AS calibrated
  FROM (SELECT * FROM cal WHERE NOT fit) c ASOF LEFT JOIN (SELECT symbol, x, y FROM steps) lo ON c.symbol = lo.symbol AND c.x >= lo.x
  ASOF LEFT JOIN (SELECT symbol, x, y FROM steps) hi ON c.symbol = hi.symbol AND c.x <= hi.x""", views=CALIBRATE, floats="probability calibrated", ints="label_value")
def _isotonic(v: Views):
    """Isotonic curves of all symbols at once, applied to the newest fifth."""
    fit, rest = calibration_rows(v)
    return calibrate.apply_isotonic_groups(rest, calibrate.fit_isotonic_groups(fit, ["symbol"]), ["symbol"])


@query("ml_calibrate_platt", """
  SELECT prediction_id, c.symbol, x AS probability, y AS label_value, 1 / (1 + exp(-(a * x + b))) AS calibrated FROM cal c LEFT JOIN newton n ON n.symbol = c.symbol WHERE NOT fit""",
       views=CALIBRATE, floats="probability calibrated", ints="label_value", digits=8)
def _platt(v: Views):
    """Logistic curves of all symbols at once, applied to the newest fifth."""
    fit, rest = calibration_rows(v)
    return calibrate.apply_platt_groups(rest, calibrate.fit_platt_groups(fit, ["symbol"]), ["symbol"])


def fold_parts(plan: list[tuple], share: float = 0.8, horizon_hours: int = 24) -> list[tuple]:
    """Each training window cut in time: the older part to fit, ending a horizon before the newer part that picks the threshold."""
    out = []
    for fold, split, start, end in plan:
        if split != "train":
            out.append((fold, split, start, end))
            continue
        cut = start + (end - start) * share
        out += [(fold, "fit", start, cut - timedelta(hours=horizon_hours)), (fold, "validate", cut, end)]
    return out


PART_PLAN = fold_parts(RUN_PLAN)
PARTS = {"fplan": "SELECT * FROM (VALUES " + ", ".join(f"({f}, '{s}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for f, s, a, b in PART_PLAN) + ") t(fold_idx, split, a, b)",
         "frows": "SELECT p.fold_idx, p.split, l.signal_time, l.label_value FROM fplan p JOIN labels_24 l ON l.label_value IS NOT NULL AND l.signal_time >= p.a AND l.signal_time < p.b",
         "fcounts": """
  SELECT p.fold_idx, count(*) FILTER (r.split = 'fit') AS n_fit, count(*) FILTER (r.split = 'validate') AS n_validate, count(*) FILTER (r.split = 'test') AS n_test,
    coalesce(sum(r.label_value) FILTER (r.split = 'fit'), 0) AS fit_positive, coalesce(sum(r.label_value) FILTER (r.split = 'test'), 0) AS test_positive FROM (SELECT DISTINCT fold_idx FROM fplan) p LEFT JOIN frows r USING (fold_idx) GROUP BY 1"""}
FOLD_STATUS = "CASE WHEN n_test = 0 THEN 'no_test_rows' WHEN n_validate = 0 THEN 'no_validation_rows' WHEN fit_positive = 0 OR fit_positive = n_fit THEN 'single_class' ELSE 'fitted' END"


def walk_forward(v: Views):
    """Counts and status of every fold of the plan, and the scored test rows of those that could be fitted with the fold's own threshold."""
    f = labelled_features(v, GROUPS).select("symbol", "signal_time", "label_value", *COLS)
    rows = tables.materialize(splits.assign_splits(f, PART_PLAN), "folds")
    one = lambda s, x: F.count_if((F.col("split") == s) & x)
    yes, any_ = F.col("label_value") == 1, F.lit(True)
    n = rows.groupBy("fold_idx").agg(one("fit", any_).alias("n_fit"), one("validate", any_).alias("n_validate"), one("test", any_).alias("n_test"), one("fit", yes).alias("fit_positive"), one("test", yes).alias("test_positive"))
    plan = v.spark.createDataFrame([(k,) for k in sorted({r[0] for r in PART_PLAN})], "fold_idx int")
    counts = tables.materialize(plan.join(n, "fold_idx", "left").na.fill(0).withColumn("status", F.expr(FOLD_STATUS)), "fold-counts")
    # the plan has a handful of folds
    fitted = [r["fold_idx"] for r in counts.where("status = 'fitted'").select("fold_idx").collect()]
    fit = rows.where(F.col("split") == "fit")
    usable = ml.usable_by(fit, "fold_idx", COLS)
    models = ml.fit_concurrently({k: fit.where(F.col("fold_idx") == k) for k in fitted}, usable)
    out = None
    for k, model in models.items():
        s = ml.score(model, rows.where((F.col("fold_idx") == k) & (F.col("split") != "fit"))).select("fold_idx", "split", "symbol", "signal_time", "label_value", "probability")
        out = s if out is None else out.unionByName(s)
    if out is None:
        out = rows.where("false").select("fold_idx", "split", "symbol", "signal_time", "label_value", F.lit(0.0).alias("probability"))
    scored = tables.materialize(out, "fold-scores")
    sweep = metrics.threshold_sweep(scored.where("split = 'validate'"), ["fold_idx"], [(5 + i) / 100.0 for i in range(90)])
    chosen = metrics.best_precision_threshold(sweep, ["fold_idx"])
    test = scored.where("split = 'test'").join(chosen, "fold_idx").withColumn("pred_value", (F.col("probability") >= F.col("threshold")).cast("int"))
    return counts, tables.materialize(test, "fold-tests"), fitted


def fold_report(v: Views):
    """One row per fold: counts, status, figures at its threshold, the day-block interval of its precision, and the precision of flagging every row."""
    counts, test, fitted = walk_forward(v)
    hit = F.sum(F.col("label_value") * F.col("pred_value"))
    m = test.groupBy("fold_idx").agg(F.first("threshold").alias("threshold"), F.try_divide(hit, F.sum("pred_value")).alias("precision"), F.try_divide(hit, F.sum("label_value")).alias("recall"),
                                     F.avg(F.pow(F.col("probability") - F.col("label_value"), 2)).alias("brier_score"), F.avg("label_value").alias("baseline_precision"))
    ends = None
    for k in fitted:
        i = resample.counted_interval(day_blocks(test.where(F.col("fold_idx") == k)), ["day"], ["tp", "p"], resample.ratio_of("tp", "p")).select(F.lit(k).alias("fold_idx"), "ci_lower", "ci_upper")
        ends = i if ends is None else ends.unionByName(i)
    out = counts.join(m, "fold_idx", "left")
    return out.join(ends, "fold_idx", "left") if ends is not None else out.withColumns({"ci_lower": F.lit(None).cast("double"), "ci_upper": F.lit(None).cast("double")})


@query("ml_walk_forward_eval")
def _walk_eval(v: Views):
    """All folds fitted as concurrent jobs and judged at their own thresholds, with mean and deviation over the folds."""
    over = tables.materialize(fold_report(v), "fold-report")
    names = ("precision", "recall", "brier_score")
    return ordered.with_scalar(over, over.agg(*[f(c).alias(f"{c}_{n}") for c in names for n, f in (("mean", F.avg), ("std", F.stddev_samp))]), *[f"{c}_{n}" for c in names for n in ("mean", "std")])


@query("ml_walk_forward_folds", f"""
  SELECT fold_idx, n_fit, n_validate, n_test, fit_positive, test_positive, {FOLD_STATUS} AS status, CASE WHEN {FOLD_STATUS} = 'fitted' THEN test_positive / n_test::DOUBLE END AS baseline_precision, TRUE AS sound FROM fcounts""",
       views=PARTS, floats="baseline_precision", ints="fold_idx n_fit n_validate n_test fit_positive test_positive")
def _walk_folds(v: Views):
    """What doesn't hang on coefficients: every fold's counts, status and baseline; figures lie in [0, 1], intervals around their precision, thresholds on the grid."""
    unit = lambda c: f"coalesce({c} BETWEEN 0 AND 1, true)"
    sound = (f"{unit('precision')} AND {unit('recall')} AND {unit('brier_score')} AND coalesce(ci_lower <= precision + 1e-9 AND precision <= ci_upper + 1e-9, true) "
             "AND (status <> 'fitted' OR threshold BETWEEN 0.05D AND 0.94D + 1e-9)")
    return fold_report(v).selectExpr("fold_idx", "n_fit", "n_validate", "n_test", "fit_positive", "test_positive", "status", "baseline_precision", f"{sound} AS sound")


@query("ml_score_frozen")
def _freeze(v: Views):
    """Save a fitted pipeline, load it again and score only complete rows after the cutoff."""
    train, test = _train_test(v)
    path = tables.shared_folder(v.spark, "model")
    usable = ml.usable_columns(train, COLS)
    ml.fit_classifier(train, usable).write().save(path)
    model = ml.PipelineModel.load(path)
    return ml.score(model, test.na.drop(subset=usable)).select("symbol", "signal_time", "probability")


@query("ml_freeze")
def _freeze_meta(v: Views):
    """Pick the best-F1 threshold on the newest fifth of the training rows, refit on all of them, save and describe the model."""
    train, _ = _train_test(v)
    cut = splits.chronological_cut(train, 0.8)
    fit, window = cut.where("part = 'fit'").drop("part"), cut.where("part = 'calibrate'").drop("part")
    usable = ml.usable_columns(fit, COLS)
    threshold = ml.pick_f1_threshold(ml.score(ml.fit_classifier(fit, usable), window))
    ml.fit_classifier(train, usable).write().save(tables.shared_folder(v.spark, "model"))
    return train.agg(F.count(F.lit(1)).alias("n_train"), F.sum("label_value").alias("n_positive"), F.min("signal_time").alias("train_start"),
                     F.max("signal_time").alias("train_end")).withColumns({"inputs": F.lit(",".join(usable)), "threshold": F.lit(threshold)})


@query("ml_predict_latest")
def _predict_latest(v: Views):
    """Train on the rows whose horizon had ended two days before the newest feature, then score the newest row per symbol with its level."""
    f = tables.materialize(features.build_features(v.timeline, GROUPS).withColumnRenamed("feature_time", "signal_time").select("symbol", "signal_time", *COLS), "features")
    lab = v.labels.where("label_value IS NOT NULL").select("symbol", "signal_time", "label_value")
    newest = f.agg(F.max("signal_time")).scalar()
    train = tables.materialize(f.join(lab, ["symbol", "signal_time"]).where(F.col("signal_time") < newest - F.expr("INTERVAL 48 HOURS")), "train")
    latest = ordered.latest_per_key(f, ["symbol"], ["signal_time"])
    from tidemark.operators.scoring import threshold_level
    s = ml.score(ml.fit_classifier(train, ml.usable_columns(train, COLS)), latest)
    return s.select("symbol", "signal_time", "probability", threshold_level(F.col("probability"), F.lit(0.2)).alias("level"),
                    F.expr("signal_time + INTERVAL 24 HOURS AS invalidation_time"))


#: The champion has seen three fifths of the time; a row's path must have ended by then.
CHALLENGE = {
    "crows": "SELECT symbol, signal_time, label_value, event_id, epoch_us(signal_time) AS t FROM label_events WHERE label_value IN (0, 1)",
    "cspan": "SELECT min(t) + (max(t) - min(t)) * 6 // 10 AS until, max(t) AS newest FROM crows",
    "ccut": "SELECT max(t) AS cutoff FROM crows, cspan WHERE t + 86400000000 <= until",
    "clater": "SELECT t, row_number() OVER (ORDER BY t, symbol) - 1 AS pos, count(*) OVER () AS n FROM crows, ccut WHERE t > cutoff",
    "chold": "SELECT t AS hold FROM clater WHERE pos = greatest(1, n // 2)",
    "cparts": """
  SELECT symbol, t, label_value, 'holdout' AS part FROM crows, chold WHERE t >= hold
  UNION ALL SELECT symbol, t, label_value, CASE WHEN pos < greatest(1, n * 4 // 5) THEN 'train' ELSE 'validate' END
  FROM (SELECT symbol, t, label_value, row_number() OVER (ORDER BY t, symbol) - 1 AS pos, count(*) OVER () AS n FROM crows, chold WHERE t < hold)""",
    "csizes": """SELECT count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'validate') AS n_validate, count(*) FILTER (part = 'holdout') AS n_holdout,
    count(DISTINCT (part, label_value)) AS kinds FROM cparts""",
    "cready": """SELECT count(*) AS n_rows, coalesce(nullif(count(DISTINCT event_id) FILTER (label_value = 1), 0), count(*) FILTER (label_value = 1)) AS n_positive_events,
    count(*) FILTER (t >= newest - 14 * 86400000000) AS n_recent FROM crows, cspan"""}


def challenger_runs(v: Views):
    """Two runs over the same rows with one ledger, in order."""
    f = features.build_features(v.timeline, GROUPS).withColumnRenamed("feature_time", "signal_time").select("symbol", "signal_time", *COLS)
    rows = tables.materialize(f.join(v.label_events.where("label_value IN (0, 1)").select("symbol", "signal_time", "label_value", "event_id"), ["symbol", "signal_time"]), "judged")
    t = F.unix_micros("signal_time")
    until = rows.agg((F.min(t) + F.expr("(max(unix_micros(signal_time)) - min(unix_micros(signal_time))) * 6 DIV 10")).alias("u")).scalar()
    seen = rows.where(t + champion.DAY_US <= until)
    frozen = champion.freeze("v1", seen, ml.usable_columns(seen, COLS))
    ledger = tables.shared_folder(v.spark, "challenger-ledger")
    first = champion.challenge(rows, frozen, ledger)
    again = champion.challenge(rows, frozen, ledger)
    return first.withColumn("run", F.lit(1)).unionByName(again.withColumn("run", F.lit(2)))


@query("ml_champion_challenger")
def _champion(v: Views):
    """A challenger against the frozen champion on held-out rows: state of the run, and its checks; a second run over the same rows does nothing."""
    return challenger_runs(v).selectExpr("run", "status", "reason", "n_rows", "n_new", "n_train", "n_validate", "n_holdout", "threshold", "inline_outer(checks)")


@query("ml_champion_readiness", """
  SELECT run, n_rows, n_positive_events, n_recent, CASE WHEN state = 'skipped' THEN 0 ELSE n_rows END AS n_new, CASE WHEN split THEN n_train END AS n_train,
    CASE WHEN split THEN n_validate END AS n_validate, CASE WHEN split THEN n_holdout END AS n_holdout, state, TRUE AS sound
  FROM (SELECT *, n_later >= 4 AND state IN ('blocked', 'compared') AS split FROM (SELECT *, CASE WHEN n_rows < 200 OR n_positive_events < 20 THEN 'not_ready'
    WHEN n_later < 4 OR kinds < 6 THEN 'blocked' WHEN run = 2 THEN 'skipped' ELSE 'compared' END AS state
    FROM cready, csizes, (SELECT count(*) AS n_later FROM clater), (VALUES (1), (2)) r(run)))""", views=CHALLENGE, ints="run n_rows n_positive_events n_recent n_new n_train n_validate n_holdout")
def _champion_readiness(v: Views):
    """What doesn't hang on coefficients: counts, sizes of the parts and states of both runs; a challenger is ready if and only if all three checks hold.

    Only a run that compared is remembered: after one that was not ready or blocked every row is still new. Rows are dealt to parts once a run is ready.
    """
    sound = ("CASE WHEN size(checks) = 0 THEN threshold IS NULL ELSE size(checks) = 3 AND threshold BETWEEN 0.05D AND 0.94D + 1e-9 "
             "AND forall(checks, c -> c.passed) = (status = 'challenger_ready') AND forall(checks, c -> c.actual BETWEEN -1 AND 1) END AS sound")
    state = f"CASE WHEN status IN {champion.TRAINED} THEN 'compared' ELSE status END AS state"
    return challenger_runs(v).selectExpr("run", "n_rows", "n_positive_events", "n_recent", "n_new", "n_train", "n_validate", "n_holdout", state, sound)


def meta_rows(v: Views):
    reg = indicators.market_regimes(v.path_bars).select("symbol", "feature_time", "regime", "atr_pct")
    t = moved(v).join(reg.withColumnRenamed("feature_time", "entry_time"), ["symbol", "entry_time"])
    # the primary model's probability at the entry bar
    t = t.join(v.rule_probs.select("symbol", F.col("signal_time").alias("entry_time"), F.col("probability").alias("primary_probability")), ["symbol", "entry_time"], "left")
    code = F.expr("CASE regime WHEN 'TRENDING_BULL' THEN 0D WHEN 'TRENDING_BEAR' THEN 1D WHEN 'HIGH_VOLATILITY_CHOP' THEN 2D ELSE 3D END")
    return tables.materialize(t.withColumns({"regime_code": code, "volatility": F.col("atr_pct"), "label_value": (F.col("label") == 1).cast("int")}), "meta")


META_RULE = ("CASE WHEN regime = 'TRENDING_BULL' AND side = -1 THEN 'counter_trend' WHEN probability >= 0.35D THEN 'approved' ELSE 'dropped' END")


def secondary_decisions(t):
    """A secondary model learned from the older two thirds of the time, and its decision on each signal of the newest third."""
    t = newest_third(t, "entry_time", "_later")
    model = ml.fit_secondary(t.where("NOT _later"), list(ml.META_INPUTS))
    return with_exprs(ml.score(model, t.where("_later")), decision=META_RULE)


@query("ml_meta_label")
def _meta(v: Views):
    """Secondary model on barrier outcomes; only inputs known at entry are used."""
    t = meta_rows(v)
    return secondary_decisions(t).selectExpr("signal_id", "probability", "regime", "decision", "CASE WHEN decision <> 'approved' THEN 0D WHEN regime = 'HIGH_VOLATILITY_CHOP' THEN 0.5D ELSE 1D END AS risk_scaling")


@query("ml_backtest_compare")
def _backtest(v: Views):
    """Performance of all later signals against those the secondary model approves, with what the approval gains."""
    s = secondary_decisions(meta_rows(v))
    arms = s.withColumn("arm", F.explode(F.when(F.col("decision") == "approved", F.array(F.lit("all"), F.lit("filtered"))).otherwise(F.array(F.lit("all")))))
    return metrics.gains(metrics.performance(arms, ["arm"], order=("entry_time", "signal_id")), "all", "filtered")


RELEASE_SQL = f"""
  WITH r AS (SELECT coalesce(count(*) FILTER (pred_value = 1 AND label_value = 1)::DOUBLE / nullif(count(*) FILTER (pred_value = 1), 0), 0) AS precision, count(DISTINCT threshold) AS nt,
    ({_ece_sql(' + '.join(f'(probability >= {e!r}::DOUBLE)::INT' for e in EDGES))}) AS ece, (SELECT ap FROM {AP.format(k="", g="1", gb="")}) AS pr_auc FROM judged),
  e AS (SELECT count(*) AS n, count(*) FILTER (a = 1 AND p = 1)::DOUBLE / count(*) FILTER (a = 1) AS recall FROM (SELECT coalesce(event_id, prediction_id) AS k, max(label_value) AS a, max(pred_value) AS p FROM judged GROUP BY 1)),
  l AS (SELECT median(lead_time_minutes) AS lead FROM judged WHERE pred_value = 1 AND label_value = 1),
  c AS (SELECT baseline, count(*)::DOUBLE AS n, count(*) FILTER (p AND label_value = 1)::DOUBLE AS tp, count(*) FILTER (p)::DOUBLE AS np, count(*) FILTER (label_value = 1)::DOUBLE AS pos FROM preds GROUP BY 1),
  b AS (SELECT max(coalesce(tp / nullif(np, 0), 0)) AS prec, max(coalesce(tp / nullif(pos, 0) * coalesce(tp / nullif(np, 0), 0) + (1 - tp / nullif(pos, 0)) * pos / n, 0)) AS ap FROM c)
  SELECT "check", actual, passed FROM (
    SELECT 'pr_auc_beats_all_baselines' AS "check", r.pr_auc AS actual, r.pr_auc > b.ap AS passed FROM r, b
    UNION ALL SELECT 'relative_precision_improvement', precision / nullif(b.prec, 0) - 1, coalesce(precision / nullif(b.prec, 0) - 1 >= 0.20, FALSE) FROM r, b
    UNION ALL SELECT 'precision_floor', precision, precision >= 0.35 FROM r UNION ALL SELECT 'precision_ci_lower_floor', ci_lower, coalesce(ci_lower >= 0.25, FALSE) FROM ({interval_sql("bday", "block", "sum(tp)::DOUBLE / nullif(sum(p), 0)", "tp::DOUBLE / nullif(p, 0)")})
    UNION ALL SELECT 'event_recall_floor', recall, recall >= 0.20 FROM e UNION ALL SELECT 'median_lead_time_floor', lead, coalesce(lead >= 240, FALSE) FROM l
    UNION ALL SELECT 'ece_ceiling', ece, ece <= 0.05 FROM r UNION ALL SELECT 'threshold_policy_locked', nt, nt = 1 FROM r UNION ALL SELECT 'materialized_events', n, n >= 50 FROM e)"""


def release_summary(v: Views):
    """One row of everything that the gates ask for; the baselines are judged on the same labelled rows."""
    j = tables.materialize(v.judged.select("prediction_id", "event_id", "label_value", "pred_value", "probability", "threshold", "signal_time", "lead_time_minutes", "target_time"), "judged")
    row = metrics.row_metrics(j, threshold=0.55).select("precision", "pr_auc")
    ev = metrics.event_metrics(j).select(F.struct("n_events", "event_recall", "lead_median")).scalar()
    # precision under draws of whole days, as alerts of a day are alike
    interval = resample.counted_interval(day_blocks(j), ["day"], ["tp", "p"], resample.ratio_of("tp", "p")).select(F.struct("ci_lower", "ci_upper")).scalar()
    g = baseline_counts(v)
    precision, recall = metrics.ratio(F.col("tp"), F.col("np")), metrics.ratio(F.col("tp"), F.col("pos"))
    best = g.agg(F.max(precision).alias("best_precision"), F.max(recall * precision + (1 - recall) * F.col("pos") / F.col("n")).alias("best_pr_auc"))
    return row.withColumns({"_e": ev, "_i": interval, "_b": best.select(F.struct("best_precision", "best_pr_auc")).scalar(),
                            "ece": metrics.calibration_error(j, edge="left").scalar(),
                            "n_thresholds": j.select("threshold").distinct().agg(F.count(F.lit(1))).scalar()}).select("*", "_e.*", "_i.*", "_b.*")


@query("ml_release_report", RELEASE_SQL, views={**BASE, **DRAWN}, floats="actual")
def _release(v: Views):
    """All release gates, the resampled one included."""
    return ml.release_gates(release_summary(v)).select("check", "actual", "passed")


# --- streaming -------------------------------------------------------------------------------------------------------

def tick_stream(v: Views):
    e = jobs.landed(v.spark, f"{v.folder}/events.parquet")
    return e.selectExpr("event_type AS symbol", "ts", "100D + 0.1D * value AS px", "CAST(value AS DECIMAL(20,8)) AS qty", "user_id % 2 = 1 AS is_buy", "user_id", "event_id AS seq")


@query("st_ingest_incremental", "SELECT symbol, ts, px, seq FROM ticks", floats="px")
def _ingest(v: Views):
    norm = lambda e: e.selectExpr("event_type AS symbol", "ts", "100D + 0.1D * value AS px", "event_id AS seq")
    return jobs.ingest(v.spark, f"{v.folder}/events.parquet", norm, "ingest")


@query("st_tumbling_bars", """
  SELECT symbol, open_time, make_timestamp((cell + 1) * 3600000000) AS end_time, open, high, low, close, volume_base AS volume, trade_count FROM bars_1h
  WHERE (cell + 1) * 3600000000 <= (SELECT max(epoch_us(ts)) FROM events) - 600000000""", floats="open high low close volume")
def _tumbling(v: Views):
    return jobs.run_to_table(jobs.tumbling_bars(tick_stream(v)), "bars")


@query("st_session_events", """
  WITH s AS (SELECT symbol, ts, sum(nw) OVER (PARTITION BY symbol ORDER BY ts) AS g FROM (SELECT symbol, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 THEN 1 ELSE 0 END AS nw
    FROM ticks WHERE px >= 112 WINDOW w AS (PARTITION BY symbol ORDER BY ts)))
  SELECT symbol, symbol || '_' || (epoch_us(min(ts)) // 1000000) AS event_id, min(ts) AS event_start, max(ts) AS event_end, count(*) AS member_rows FROM s GROUP BY symbol, g
  HAVING epoch_us(max(ts)) + 3600000000 <= (SELECT max(epoch_us(ts)) FROM ticks WHERE px >= 112) - 600000000""")
def _sessions(v: Views):
    return jobs.run_to_table(jobs.session_events(tick_stream(v).where("px >= 112")), "sessions")


@query("st_dedup_latest", "SELECT user_id, symbol, arg_max(seq, (ts, seq)) AS seq FROM ticks GROUP BY ALL")
def _dedup(v: Views):
    return jobs.run_merge(tick_stream(v).select("user_id", "symbol", "ts", "seq"), "dedup", ["user_id", "symbol"], ["ts", "seq"]).select("user_id", "symbol", "seq")


@query("st_fresh_latest", "SELECT symbol, seq, ts FROM (SELECT symbol, arg_max(seq, (ts, seq)) AS seq, max(ts) AS ts FROM ticks GROUP BY symbol) WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR")
def _fresh(v: Views):
    latest = jobs.run_merge(tick_stream(v).select("symbol", "ts", "seq"), "fresh", ["symbol"], ["ts", "seq"])
    return latest.where(f"ts >= {v.now} - INTERVAL 6 HOURS").select("symbol", "seq", "ts")


@query("st_lateness_gate", """
  WITH w AS (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) - INTERVAL 500 DAY AS t),
  j AS (SELECT o_orderkey AS bar_key, o_orderdate AS c, l_linenumber FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 500 DAY)
  SELECT bar_key, l_linenumber FROM j WHERE l_linenumber IS NOT NULL OR c + INTERVAL 500 DAY < (SELECT t FROM w)""")
def _gate(v: Views):
    """Every bar: with its timely records, or alone once the watermark has passed its limit."""
    o = jobs.landed(v.spark, f"{v.folder}/orders.parquet").selectExpr("o_orderkey AS bar_key", "o_orderdate AS close_time")
    li = jobs.landed(v.spark, f"{v.folder}/lineitem.parquet").selectExpr("l_orderkey AS bar_key", "l_shipdate AS available_time", "l_linenumber")
    return jobs.run_to_table(jobs.lateness_gate(o, li, "500 days", keep="500 days").selectExpr("b.bar_key", "s.l_linenumber"), "gate")


@query("st_outcome_due", """
  WITH w AS (SELECT max(epoch_us(ts)) // 1000 - 3600000 AS ms FROM ticks WHERE symbol IN ('click', 'purchase')),
  o AS (SELECT user_id AS who, seq AS open_id, epoch_us(ts) AS o, (SELECT ms FROM w) - epoch_us(ts) // 1000 AS age FROM ticks WHERE symbol = 'click'),
  f AS (SELECT o.*, least(greatest(age, 0) // 7200000, 12) AS done, r.ts AS resolved_at, r.seq AS resolve_id, (epoch_us(r.ts) - o + 7199999999) // 7200000000 AS needed
    FROM o LEFT JOIN LATERAL (SELECT p.ts, p.seq FROM ticks p WHERE p.symbol = 'purchase' AND p.user_id = o.who AND epoch_us(p.ts) > o ORDER BY p.ts, p.seq LIMIT 1) r ON TRUE)
  SELECT who, open_id, make_timestamp(o) AS opened_at, CASE WHEN needed <= done THEN needed ELSE done END AS checks, CASE WHEN needed <= done THEN resolved_at END AS resolved_at,
    CASE WHEN needed <= done THEN resolve_id END AS resolve_id, CASE WHEN needed <= done THEN 'resolved' WHEN done = 12 THEN 'unresolved' WHEN done = 0 THEN 'open' ELSE 'retry' END AS status FROM f""", ints="checks")
def _due(v: Views):
    """Each click and the first purchase of its user, looked for at the end of every two hours, twelve times at most."""
    side = lambda kind: tick_stream(v).where(f"symbol = '{kind}'").selectExpr("user_id AS who", "seq AS id", "ts")
    return jobs.outcomes_due(side("click"), side("purchase"), "due")


COOL = {"cand": "SELECT symbol, seq, epoch_us(ts) AS t FROM ticks WHERE px >= 110",
        "chain": """SELECT symbol, t FROM (WITH RECURSIVE c(symbol, t) AS (SELECT symbol, min(t) FROM cand GROUP BY symbol UNION ALL
    SELECT c.symbol, (SELECT min(d.t) FROM cand d WHERE d.symbol = c.symbol AND d.t - c.t > 3600000000) AS t FROM c WHERE EXISTS (SELECT 1 FROM cand d WHERE d.symbol = c.symbol AND d.t - c.t > 3600000000)) SELECT * FROM c)"""}


@query("st_cooldown", "SELECT a.symbol, a.seq, a.t, c.t IS NOT NULL AS sent FROM cand a LEFT JOIN chain c ON a.symbol = c.symbol AND a.t = c.t", views=COOL)
def _cooldown(v: Views):
    s = tick_stream(v).where("px >= 110").selectExpr("symbol", "seq", "unix_micros(ts) AS t")
    return jobs.cooldown_run(s, ["symbol"], "cooldown")


@query("st_daily_cap", """
  WITH sent AS (SELECT a.symbol, a.seq, a.t, a.t // 86400000000 AS day FROM cand a JOIN chain c ON a.symbol = c.symbol AND a.t = c.t),
  own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY t, seq) AS k FROM sent) WHERE k <= 2),
  top AS (SELECT symbol, seq FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY t, symbol, seq) AS d FROM own) WHERE d <= 15)
  SELECT s.symbol, s.seq, s.t, p.seq IS NOT NULL AS sent FROM sent s LEFT JOIN top p ON s.symbol = p.symbol AND s.seq = p.seq""", views=COOL)
def _cap(v: Views):
    """Cooldown first, then the caps per calendar day over what it lets through."""
    s = tick_stream(v).where("px >= 110").selectExpr("symbol", "seq", "unix_micros(ts) AS t")
    cooled = jobs.cooldown_run(s, ["symbol"], "cooldown").where("sent").drop("sent")
    return jobs.daily_cap(cooled)


@query("st_episode_state")
def _episode_stream(v: Views):
    from tidemark.operators.candidates import episode_input
    # scans land in four steps of time; after each a run takes what is new and goes on from the states of the run before
    path, root = tables.shared_folder(v.spark, "scans"), tables.shared_folder(v.spark, "episodes")
    scans = tables.materialize(episode_input(v.bars_1h, small_bars(v)), "all-scans")
    step = scans.agg(F.min("scan_t").alias("lo"), ((F.max("scan_t") - F.min("scan_t")) / 4 + 1).cast("long").alias("wide")).select(F.struct("lo", "wide")).scalar()
    stepped = tables.materialize(scans.withColumn("_s", step).selectExpr("* EXCEPT (_s)", "(scan_t - _s.lo) DIV _s.wide AS step"), "stepped")
    for i in range(4):
        stepped.where(F.col("step") == i).drop("step").write.mode("append").parquet(path)
        done = jobs.episode_run(jobs.landed(v.spark, path), "episodes", root)
    return done


BUDGET = {"named": "SELECT symbol || '-' || user_id % 8 AS name, seq, epoch_us(ts) AS t FROM ticks WHERE px >= 110",
          "sends": """SELECT * FROM (WITH RECURSIVE s(r, sent) AS (SELECT min(row(t, name, seq)), []::STRUCT(t BIGINT, name VARCHAR)[] FROM named
    UNION ALL SELECT (SELECT min(row(c.t, c.name, c.seq)) FROM named c WHERE row(c.t, c.name, c.seq) > s.r
        AND len(list_filter(n.sent, lambda x: c.t - x.t <= 86400000000)) < 15 AND len(list_filter(n.sent, lambda x: x.name = c.name AND c.t - x.t <= 86400000000)) < 2
        AND len(list_filter(n.sent, lambda x: x.name = c.name AND c.t - x.t <= 3600000000)) = 0),
      n.sent FROM s, LATERAL (SELECT list_append(list_filter(s.sent, lambda x: s.r[1] - x.t <= 86400000000), {'t': s.r[1], 'name': s.r[2]}) AS sent) n WHERE s.r IS NOT NULL) SELECT r[1] AS t, r[2] AS name, r[3] AS seq FROM s WHERE r IS NOT NULL)"""}


@query("st_daily_budget", "SELECT n.name, n.seq, n.t, s.seq IS NOT NULL AS sent FROM named n LEFT JOIN sends s ON n.name = s.name AND n.seq = s.seq AND n.t = s.t", views=BUDGET)
def _budget(v: Views):
    """Cooldown of an hour, two sends per name and fifteen over all in any 24 hours."""
    s = tick_stream(v).where("px >= 110").selectExpr("concat(symbol, '-', user_id % 8) AS name", "seq", "unix_micros(ts) AS t")
    return jobs.budget_run(s, "budget", who="name").drop("reason")

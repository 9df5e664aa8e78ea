"""The views of ``views.py`` in plain SQL, for the independent check.

``sql(body)`` puts in front of a query the named subqueries it uses.
"""
from __future__ import annotations

import re

from tidemark.operators.features import BUILDERS, FEATURES

AS_OF = "(SELECT max(ts) FROM events)"


def _bars(seconds: int) -> str:
    return f"""
  SELECT symbol, cell, make_timestamp(cell * {seconds}000000) AS open_time,
    make_timestamp((cell + 1) * {seconds}000000 - 1000) AS close_time,
    make_timestamp((cell + 1) * {seconds}000000) AS available_time,
    open, high, low, close, CAST(vb AS DOUBLE) AS volume_base, CAST(vq AS DOUBLE) AS volume_quote, trade_count,
    CAST(tb AS DOUBLE) AS taker_buy_base,
    CASE WHEN cell % 40 = 7 THEN 'invalid' WHEN cell % 15 = 4 THEN 'warning' ELSE 'valid' END AS quality_status
  FROM (SELECT symbol, epoch_us(ts) // {seconds}000000 AS cell, arg_min(px, (ts, seq)) AS open, max(px) AS high,
      min(px) AS low, arg_max(px, (ts, seq)) AS close, sum(qty) AS vb,
      sum(CAST(CAST(qty AS DECIMAL(12,2)) * CAST(px AS DECIMAL(14,8)) AS DECIMAL(28,8))) AS vq, count(*) AS trade_count,
      coalesce(sum(CASE WHEN is_buy THEN qty END), 0) AS tb
    FROM ticks GROUP BY ALL)"""


PERIOD = """make_timestamp(cell * 3600000000) AS period_end,
    make_timestamp(cell * 3600000000 + CASE WHEN cell % 20 = 3 THEN 4200000000 ELSE 1000000 END) AS available_time,
    CASE WHEN cell % 50 = 11 THEN 'quarantined' ELSE 'valid' END AS quality_status"""


def _side(alias: str, view: str) -> str:
    return (f"LEFT JOIN {view} {alias} ON k.symbol = {alias}.symbol AND k.cell = epoch_us({alias}.period_end) // 3600000000 "
            f"AND {alias}.available_time <= k.close_time + INTERVAL 5 SECONDS "
            f"AND {alias}.quality_status IN ('valid','warning')")


VIEWS = {
    "ticks": """
  SELECT event_type AS symbol, ts, 100.0::DOUBLE + 0.1::DOUBLE * value AS px, CAST(value AS DECIMAL(18,8)) AS qty,
    user_id % 2 = 1 AS is_buy, user_id, event_id AS seq FROM events""",
    "bars_1h": _bars(3600),
    "bars_5m": _bars(300),
    "path_bars": """
  SELECT symbol, close_time AS feature_time, open, high, low, close, volume_base, quality_status FROM bars_1h""",
    "hourly": """
  SELECT symbol, epoch_us(ts) // 3600000000 AS cell, coalesce(sum(CASE WHEN is_buy THEN qty END), 0) AS buy,
    coalesce(sum(CASE WHEN NOT is_buy THEN qty END), 0) AS sell, count(*) FILTER (is_buy) AS n_buy,
    count(*) FILTER (NOT is_buy) AS n_sell, count(DISTINCT user_id) FILTER (is_buy) AS u_buy,
    count(DISTINCT user_id) FILTER (NOT is_buy) AS u_sell FROM ticks GROUP BY ALL""",
    "oi": f"""
  SELECT symbol, {PERIOD}, c AS open_interest_contracts, c * 2 AS open_interest_value FROM (
    SELECT symbol, cell, 50000.0::DOUBLE + CAST(sum(buy - sell) OVER (PARTITION BY symbol ORDER BY cell) AS DOUBLE) AS c
    FROM hourly)""",
    "taker": f"""
  SELECT symbol, {PERIOD}, CAST(buy AS DOUBLE) AS buy_volume, CAST(sell AS DOUBLE) AS sell_volume,
    CAST(buy AS DOUBLE) / nullif(CAST(sell AS DOUBLE), 0) AS buy_sell_ratio FROM hourly""",
    "global_ratio": f"""
  SELECT symbol, {PERIOD}, u_buy::DOUBLE / (u_buy + u_sell) AS long_account, u_sell::DOUBLE / (u_buy + u_sell) AS short_account,
    u_buy::DOUBLE / nullif(u_sell, 0) AS long_short_ratio FROM hourly""",
    "top_ratio": f"""
  SELECT symbol, {PERIOD}, n_buy::DOUBLE / (n_buy + n_sell) AS long_account, n_sell::DOUBLE / (n_buy + n_sell) AS short_account,
    n_buy::DOUBLE / nullif(n_sell, 0) AS long_short_ratio FROM hourly""",
    "top_position": f"""
  SELECT symbol, {PERIOD}, buy::DOUBLE / (buy + sell)::DOUBLE AS long_position, sell::DOUBLE / (buy + sell)::DOUBLE AS short_position,
    buy::DOUBLE / nullif(sell::DOUBLE, 0) AS long_short_ratio FROM hourly""",
    "funding": """
  SELECT symbol, make_timestamp((cell + 1) * 28800000000) AS event_time,
    make_timestamp((cell + 1) * 28800000000 + 1000000) AS available_time, s::DOUBLE / n / 100.0::DOUBLE - 1.0::DOUBLE AS funding_rate,
    s::DOUBLE / n AS mark_price
  FROM (SELECT symbol, epoch_us(ts) // 28800000000 AS cell, sum(CAST(px AS DECIMAL(18,8))) AS s, count(*) AS n FROM ticks GROUP BY ALL)
  WHERE cell % 5 NOT IN (0, 1)""",
    "aligned": f"""
  SELECT k.symbol, k.close_time AS feature_time, k.close_time + INTERVAL 5 SECONDS AS decision_time,
    k.available_time AS feature_available_time, k.open, k.high, k.low, k.close, k.volume_base, k.volume_quote, k.trade_count,
    k.quality_status, oi.open_interest_contracts, oi.open_interest_value, tv.buy_volume, tv.sell_volume, tv.buy_sell_ratio,
    gr.long_account AS global_long_account, gr.short_account AS global_short_account,
    gr.long_short_ratio AS global_long_short_ratio, tr.long_account AS top_long_account, tr.short_account AS top_short_account,
    tr.long_short_ratio AS top_long_short_ratio, tp.long_short_ratio AS top_long_short_position_ratio
  FROM bars_1h k {_side('oi', 'oi')} {_side('tv', 'taker')} {_side('gr', 'global_ratio')} {_side('tr', 'top_ratio')}
    {_side('tp', 'top_position')}
  WHERE k.available_time <= k.close_time + INTERVAL 5 SECONDS AND k.close_time <= {AS_OF}
    AND k.quality_status IN ('valid','warning')""",
    "funded": """
  SELECT * EXCLUDE (funding_rate, fe, age), CASE WHEN age <= 720 THEN funding_rate END AS funding_rate_last_known,
    CASE WHEN age <= 720 THEN fe END AS funding_event_time, CASE WHEN age <= 720 THEN age END AS funding_age_minutes
  FROM (SELECT a.*, f.funding_rate, f.event_time AS fe, date_diff('minute', f.event_time, a.feature_time) AS age
    FROM aligned a ASOF LEFT JOIN funding f ON a.symbol = f.symbol AND a.decision_time >= f.available_time)""",
    "timeline": """
  SELECT * EXCLUDE (quality_status, src, miss, req, age, bad, fut),
    greatest(0.0, least(1.0, 1.0 - 0.15 * miss - CASE WHEN bad THEN 0.25 ELSE 0.0 END))::DOUBLE AS data_quality_score,
    age AS max_feature_age_minutes,
    CASE WHEN src IN ('invalid','quarantined') OR req OR bad THEN 'invalid' WHEN src = 'warning' OR miss > 0 THEN 'warning'
      ELSE 'valid' END AS quality_status,
    concat_ws('|', CASE WHEN src IN ('invalid','quarantined') THEN 'source_invalid' END, CASE WHEN req THEN 'required_missing' END,
      CASE WHEN miss > 0 THEN 'optional_missing' END, CASE WHEN fut THEN 'feature_future' END,
      CASE WHEN bad THEN 'stale_feature' END) AS quality_reason_codes
  FROM (SELECT *, age > 10.0 OR age < 0 AS bad, age < 0 AS fut FROM (SELECT *, lower(quality_status) AS src,
      (open_interest_contracts IS NULL)::INT + (buy_volume IS NULL)::INT + (sell_volume IS NULL)::INT
      + (global_long_short_ratio IS NULL)::INT + (top_long_short_ratio IS NULL)::INT
      + (top_long_short_position_ratio IS NULL)::INT + (funding_rate_last_known IS NULL)::INT AS miss,
      symbol IS NULL OR feature_time IS NULL OR close IS NULL AS req,
      date_diff('second', feature_available_time, decision_time)::DOUBLE / 60.0::DOUBLE AS age FROM funded))""",
    "features": """
  WITH b AS (
    SELECT *, close / nullif(lag(close, 1) OVER w, 0) - 1 AS price_ret_5m, close / nullif(lag(close, 12) OVER w, 0) - 1 AS price_ret_1h,
      close / nullif(lag(close, 48) OVER w, 0) - 1 AS price_ret_4h, close / nullif(lag(close, 288) OVER w, 0) - 1 AS price_ret_24h,
      max(high) OVER (PARTITION BY symbol ORDER BY feature_time ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS top12,
      funding_rate_last_known AS fr, open_interest_value AS oiv,
      open_interest_value / nullif(lag(open_interest_value, 12) OVER w, 0) - 1 AS oi_1h,
      open_interest_value / nullif(lag(open_interest_value, 48) OVER w, 0) - 1 AS oi_4h,
      open_interest_value / nullif(lag(open_interest_value, 288) OVER w, 0) - 1 AS oi_24h,
      buy_volume / nullif(buy_volume + sell_volume, 0) AS br,
      coalesce(global_long_short_ratio, 1.0) AS gl, coalesce(top_long_short_ratio, 1.0) AS tl
    FROM timeline WINDOW w AS (PARTITION BY symbol ORDER BY feature_time))
  SELECT feature_time, symbol, close, data_quality_score, quality_status,
    price_ret_5m, price_ret_1h, price_ret_4h, price_ret_24h, stddev_samp(price_ret_5m) OVER w288 AS price_volatility_24h,
    close / nullif(max(high) OVER w288, 0) - 1 AS distance_from_high_24h,
    volume_base / nullif(max(volume_base) OVER w288, 0) AS volume_percentile_24h,
    price_ret_1h - lag(price_ret_1h, 36) OVER w AS momentum_deceleration_4h,
    CASE WHEN high > top12 AND close < top12 THEN least(1.0::DOUBLE, (top12 - close) / nullif(top12, 0) / 0.02::DOUBLE) ELSE 0.0 END AS fake_breakout_1h,
    coalesce(fr, 0.0) AS funding_rate_raw,
    (fr - min(fr) OVER w2016) / nullif(max(fr) OVER w2016 - min(fr) OVER w2016, 0) AS funding_percentile_7d,
    (fr - min(fr) OVER w8640) / nullif(max(fr) OVER w8640 - min(fr) OVER w8640, 0) AS funding_percentile_30d,
    CASE WHEN min(fr) OVER w8640 < max(fr) OVER w8640 THEN (fr - avg(fr) OVER w8640) / nullif(stddev_samp(fr) OVER w8640, 0) END AS funding_zscore_30d,
    fr - lag(fr, 96) OVER w AS funding_change_8h, fr - lag(fr, 288) OVER w AS funding_change_24h,
    avg(fr) OVER w2016 AS funding_persistence_7d,
    coalesce(oi_1h, 0.0) AS oi_change_1h, coalesce(oi_4h, 0.0) AS oi_change_4h, coalesce(oi_24h, 0.0) AS oi_change_24h,
    CASE WHEN min(oiv) OVER w2016 < max(oiv) OVER w2016 THEN (oiv - avg(oiv) OVER w2016) / nullif(stddev_samp(oiv) OVER w2016, 0) END AS oi_zscore_7d,
    oi_1h - lag(oi_1h, 12) OVER w AS oi_acceleration_1h, price_ret_1h * oi_1h AS price_oi_divergence_1h,
    coalesce(br, 0.5) AS taker_buy_ratio, avg(br) OVER w12 AS taker_buy_ratio_trend_1h, avg(br) OVER w48 AS taker_buy_ratio_trend_4h,
    br - lag(br, 12) OVER w AS taker_buy_ratio_change_1h, price_ret_1h * (avg(br) OVER w12 - 0.5) AS price_flow_divergence_1h,
    gl AS global_ls_ratio, tl AS top_ls_ratio, gl - tl AS retail_top_spread, avg(gl - tl) OVER w12 AS spread_trend_1h,
    avg(gl - tl) OVER w48 AS spread_trend_4h
  FROM b WINDOW w AS (PARTITION BY symbol ORDER BY feature_time),
    w12 AS (PARTITION BY symbol ORDER BY feature_time ROWS BETWEEN 11 PRECEDING AND CURRENT ROW),
    w48 AS (PARTITION BY symbol ORDER BY feature_time ROWS BETWEEN 47 PRECEDING AND CURRENT ROW),
    w288 AS (PARTITION BY symbol ORDER BY feature_time ROWS BETWEEN 287 PRECEDING AND CURRENT ROW),
    w2016 AS (PARTITION BY symbol ORDER BY feature_time ROWS BETWEEN 2015 PRECEDING AND CURRENT ROW),
    w8640 AS (PARTITION BY symbol ORDER BY feature_time ROWS BETWEEN 8639 PRECEDING AND CURRENT ROW)""",
    "labels_all": """
  WITH s AS (SELECT symbol, feature_time AS signal_time, close AS p, quality_status AS q, h.horizon_hours
      FROM path_bars, (VALUES (6), (12), (24)) h(horizon_hours)),
  f AS (SELECT s.*, b.feature_time AS ft, b.high, b.low,
      epoch_us(b.feature_time) - epoch_us(coalesce(lag(b.feature_time) OVER (PARTITION BY s.symbol, s.signal_time, s.horizon_hours
        ORDER BY b.feature_time), s.signal_time)) AS gap
    FROM s LEFT JOIN path_bars b ON s.symbol = b.symbol AND b.feature_time > s.signal_time
      AND b.feature_time <= s.signal_time + s.horizon_hours * INTERVAL 1 HOUR),
  e AS (SELECT symbol, signal_time, p, q, horizon_hours, min(CASE WHEN low <= p * (1.0::DOUBLE - 0.08::DOUBLE) THEN ft END) AS lo,
      min(CASE WHEN high >= p * (1.0::DOUBLE + 0.04::DOUBLE) THEN ft END) AS up, max(gap) / 6e7 AS max_gap, max(ft) AS last_t,
      max(high) AS mh, min(low) AS ml FROM f GROUP BY ALL),
  r AS (SELECT *, CASE WHEN q IN ('invalid','quarantined') THEN 'invalid_quality' WHEN last_t IS NOT NULL AND max_gap > 180 THEN 'data_gap'
      WHEN last_t IS NULL OR last_t < signal_time + horizon_hours * INTERVAL 1 HOUR - INTERVAL 5 MINUTE THEN 'missing_future_data'
      WHEN lo = up THEN 'ambiguous_intrabar' END AS reason FROM e)
  SELECT symbol, signal_time, p AS signal_price, 'distribution_short_v1' AS label_version, horizon_hours,
    CASE WHEN reason IS NULL THEN CASE WHEN lo IS NOT NULL AND (up IS NULL OR lo < up) THEN 1 ELSE 0 END END AS label_value,
    CASE WHEN reason IS NULL THEN lo IS NOT NULL END AS target_reached, lo AS target_time,
    (epoch_us(lo) - epoch_us(signal_time)) / 6e7 AS lead_time_minutes, (mh - p) / p AS max_adverse_excursion,
    (ml - p) / p AS max_favorable_excursion, mh AS future_max_high, ml AS future_min_low, reason AS exclusion_reason,
    coalesce(lo = up, FALSE) AS ambiguous_intrabar, q AS quality_status FROM r""",
    "labels_24": "SELECT * FROM labels_all WHERE horizon_hours = 24",
    "label_events": """
  WITH pos AS (SELECT symbol, signal_time, sum(nw) OVER (PARTITION BY symbol ORDER BY signal_time) AS seq FROM (
      SELECT symbol, signal_time, CASE WHEN lag(signal_time) OVER w IS NULL
        OR epoch_us(signal_time) - epoch_us(lag(signal_time) OVER w) >= 10800000000 THEN 1 ELSE 0 END AS nw
      FROM labels_24 WHERE label_value = 1 WINDOW w AS (PARTITION BY symbol ORDER BY signal_time))),
  ids AS (SELECT symbol, signal_time, symbol || '_' || (epoch_us(min(signal_time) OVER (PARTITION BY symbol, seq)) // 1000000) AS event_id FROM pos)
  SELECT l.*, i.event_id FROM labels_24 l LEFT JOIN ids i USING (symbol, signal_time)""",
    "rule_probs": """
  SELECT symbol, feature_time AS signal_time, close, ret_1, dist_high,
    round(1.0 / (1.0 + exp(-(0.4::DOUBLE + 12.0::DOUBLE * ret_1 + 6.0::DOUBLE * dist_high))), 6) AS probability
  FROM (SELECT symbol, feature_time, close, coalesce(close / lag(close) OVER w - 1, 0.0) AS ret_1,
      close / max(high) OVER (PARTITION BY symbol ORDER BY feature_time ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) - 1 AS dist_high
    FROM path_bars WINDOW w AS (PARTITION BY symbol ORDER BY feature_time))""",
    "predictions": """
  SELECT p.*, l.label_value, l.event_id, l.target_time, l.lead_time_minutes, l.max_adverse_excursion, l.max_favorable_excursion,
    l.exclusion_reason, p.symbol || '-' || (epoch_us(p.signal_time) // 3600000000) AS prediction_id,
    epoch_us(p.signal_time) // 3600000000 AS cell, 0.55::DOUBLE AS threshold, 24 AS horizon_hours,
    CASE WHEN (epoch_us(p.signal_time) // 3600000000) % 2 = 0 THEN 'm_even' ELSE 'm_odd' END AS model_id,
    p.signal_time + INTERVAL 24 HOUR AS invalidation_time, (p.probability >= 0.55)::INT AS pred_value
  FROM rule_probs p JOIN label_events l USING (symbol, signal_time)""",
    "judged": "SELECT * FROM predictions WHERE label_value IS NOT NULL",
    "scans": """
  SELECT symbol, signal_time AS scan_time, cell, cell % 24 AS cycle,
    cell * 16777216 + ('0x' || substr(md5(symbol), 1, 6))::BIGINT AS seq,
    round(probability * 100, 4) AS score, close AS close_price, probability,
    CASE WHEN probability >= 0.6 THEN 'SHORT_CANDIDATE' WHEN probability >= 0.4 THEN 'WATCH' ELSE 'WAIT' END AS recommendation, ret_1 AS price_change
  FROM (SELECT *, epoch_us(signal_time) // 3600000000 AS cell FROM rule_probs)""",
    "alerts": """
  SELECT symbol, signal_time, cell, probability, close AS close_price, invalidation_time,
    CASE WHEN probability >= 0.7 THEN 'HIGH' WHEN probability >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, probability >= 0.55 AS sent,
    signal_time + INTERVAL 10 SECONDS AS sent_at, cell % 4 = 0 AS shadow, cell % 11 = 0 AS dismissed, label_value = 1 AS hit,
    CASE WHEN label_value = 1 THEN target_time END AS hit_time FROM predictions WHERE probability >= 0.5""",
    "daily_prices": """
  SELECT CAST(l_suppkey AS VARCHAR) AS symbol, epoch_us(l_shipdate) // 86400000000 AS cell,
    arg_min(px, (l_orderkey, l_linenumber)) AS open, max(px) AS high, min(px) AS low, arg_max(px, (l_orderkey, l_linenumber)) AS close,
    CAST(sum(CAST(l_extendedprice AS DECIMAL(18,8))) AS DOUBLE) AS quote_volume, count(*) AS n,
    make_timestamp((epoch_us(l_shipdate) // 86400000000) * 86400000000) AS feature_time
  FROM (SELECT *, l_extendedprice / l_quantity AS px FROM lineitem) GROUP BY l_suppkey, epoch_us(l_shipdate) // 86400000000""",
    "tickers": """
  SELECT l_partkey AS part, CASE l_partkey WHEN 97 THEN 'USDC' WHEN 194 THEN 'BUSD' WHEN 291 THEN 'TUSD' ELSE 'C' || l_partkey END
      || 'USDT' AS symbol, last_px, quote_volume, 100.0::DOUBLE * (last_px / first_px - 1.0::DOUBLE) AS change_pct
  FROM (SELECT l_partkey, arg_min(px, (l_shipdate, l_orderkey, l_linenumber)) AS first_px,
      arg_max(px, (l_shipdate, l_orderkey, l_linenumber)) AS last_px,
      CAST(sum(CAST(l_extendedprice AS DECIMAL(18,8))) AS DOUBLE) AS quote_volume
    FROM (SELECT *, l_extendedprice / l_quantity * (1 - l_discount) AS px FROM lineitem) GROUP BY l_partkey)""",
}


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` the views a query names (and those they name), then the query."""
    views = {**VIEWS, **(extra or {})}
    used: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if name not in used and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                used.append(name)
                visit(views[name])

    visit(body)
    ordered = [n for n in views if n in used]
    # an extra view may only use views listed before it
    head = ",\n".join(f"{n} AS ({views[n]})" for n in ordered)
    if not head:
        return body
    rest = body.lstrip()
    if rest.upper().startswith("WITH "):
        return f"WITH {head},\n{rest[5:]}"
    return f"WITH {head}\n{body}"


def wrap(query: str, floats: str = "", ints: str = "", digits: int = 6) -> str:
    """Round and cast result columns exactly as ``to_output`` does."""
    reps = [f"round({c}::DOUBLE, {digits}) + 0.0 AS {c}" for c in floats.split()]
    reps += [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    if not reps:
        return query
    return f"SELECT * REPLACE ({', '.join(reps)}) FROM ({query}) AS result"

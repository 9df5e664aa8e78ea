"""Queries of the rule scorers, rankings, set operations and candidate filters."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.columns import normalize_symbol, sniff_epoch, with_exprs
from tidemark.operators import candidates, ordered, scoring, selection
from tidemark.plans.q_timeline import SCORED_VIEW, scored
from tidemark.plans.registry import query
from tidemark.plans.views import Views

COMPONENT = {"score_price_volume": ("price_volume_divergence", "c1"), "score_funding_spike": ("funding_spike", "c2"),
             "score_momentum": ("momentum_exhaustion", "c3"), "score_distance_high": ("distance_from_high", "c4"),
             "score_taker": ("taker_sell_pressure", "c5"), "score_oi_divergence": ("oi_divergence", "c6"),
             "score_fake_breakout": ("fake_breakout", "c8")}


def _component(name: str, component: str, column: str):
    @query(name, f"SELECT symbol, feature_time, {column} AS score FROM scored", views=SCORED_VIEW, floats="score", digits=5)
    def build(v: Views):
        c = scoring.component_scores(F.lit(0.0))[component]
        return v.features.select("symbol", "feature_time", c.alias("score"))


for _n, (_c, _s) in COMPONENT.items():
    _component(_n, _c, _s)


@query("score_btc_context", "SELECT symbol, feature_time, c7 AS score, btc_regime FROM scored", views=SCORED_VIEW, floats="score")
def _context(v: Views):
    f = ordered.with_scalar(v.bare_timeline.select("symbol", "feature_time"), v.benchmark_return(), "benchmark_ret")
    r = F.coalesce("benchmark_ret", F.lit(0.0))
    return f.select("symbol", "feature_time", scoring.benchmark_score(r).alias("score"), scoring.benchmark_regime(r).alias("btc_regime"))


@query("score_composite", """
  SELECT symbol, feature_time, total_score, CASE WHEN total_score >= 40 THEN 'SHORT_CANDIDATE' WHEN total_score >= 20 THEN 'WATCH' ELSE 'WAIT' END AS recommendation
  FROM scored""", views=SCORED_VIEW, floats="total_score", digits=5)
def _composite(v: Views):
    return scored(v).select("symbol", "feature_time", "total_score", "recommendation")


TOP = {**SCORED_VIEW, "comps": """
  SELECT symbol, feature_time, unnest([{'i': 0, 'n': 'price_volume_divergence', 's': c1, 'w': c1 * 0.20::DOUBLE}, {'i': 1, 'n': 'funding_spike', 's': c2, 'w': c2 * 0.15::DOUBLE},
    {'i': 2, 'n': 'momentum_exhaustion', 's': c3, 'w': c3 * 0.15::DOUBLE}, {'i': 3, 'n': 'distance_from_high', 's': c4, 'w': c4 * 0.10::DOUBLE},
    {'i': 4, 'n': 'taker_sell_pressure', 's': c5, 'w': c5 * 0.10::DOUBLE}, {'i': 5, 'n': 'oi_divergence', 's': c6, 'w': c6 * 0.10::DOUBLE},
    {'i': 6, 'n': 'btc_context', 's': c7, 'w': c7 * 0.15::DOUBLE}, {'i': 7, 'n': 'fake_breakout', 's': c8, 'w': c8 * 0.05::DOUBLE}]) AS c FROM scored"""}


@query("topk_score_components", """
  SELECT symbol, feature_time, string_agg(n, '|' ORDER BY rn) AS top FROM (SELECT symbol, feature_time, c.n AS n,
    row_number() OVER (PARTITION BY symbol, feature_time ORDER BY c.w DESC, c.i) AS rn FROM comps) WHERE rn <= 3 GROUP BY ALL""", views=TOP)
def _top(v: Views):
    return scored(v).select("symbol", "feature_time", F.array_join(scoring.top_components(3), "|").alias("top"))


@query("score_evidence_groups", """
  SELECT symbol, feature_time, evidence_groups, evidence_count, usable AND evidence_count >= 2 AS evidence_passed FROM (
    SELECT symbol, feature_time, quality_status <> 'invalid' AS usable, concat_ws('|', CASE WHEN greatest(c1, c3, c4) >= 50 THEN 'price_weakening' END,
      CASE WHEN greatest(c2, c6) >= 50 THEN 'derivs_abnormality' END, CASE WHEN greatest(c5, c8) >= 50 THEN 'sell_pressure' END) AS evidence_groups,
      (greatest(c1, c3, c4) >= 50)::INT + (greatest(c2, c6) >= 50)::INT + (greatest(c5, c8) >= 50)::INT AS evidence_count FROM scored)""", views=SCORED_VIEW)
def _evidence(v: Views):
    e = scoring.evidence(scored(v), usable=F.col("quality_status") != "invalid")
    return e.select("symbol", "feature_time", F.array_join("evidence_groups", "|").alias("evidence_groups"), "evidence_count", "evidence_passed")


@query("score_risk_tier", """
  SELECT symbol, feature_time, CASE WHEN p >= 0.5 AND n >= 2 THEN 'HIGH_CONFIDENCE' WHEN p >= 0.35 THEN 'WATCH' ELSE 'WAIT' END AS tier FROM (
    SELECT symbol, feature_time, total_score / 100 + 0.1::DOUBLE AS p, (greatest(c1, c3, c4) >= 50)::INT + (greatest(c2, c6) >= 50)::INT + (greatest(c5, c8) >= 50)::INT AS n FROM scored)""",
       views=SCORED_VIEW)
def _tier(v: Views):
    e = scoring.evidence(scored(v))
    p = F.col("total_score") / 100 + 0.1
    return e.select("symbol", "feature_time", scoring.risk_tier(p, F.col("evidence_passed"), F.lit(True), 0.5, 0.35).alias("tier"))


@query("score_risk_bucket", """
  SELECT symbol, signal_time, CASE WHEN probability * 120 >= 85 THEN 'CRITICAL' WHEN probability * 120 >= 70 THEN 'HIGH' WHEN probability * 120 >= 50 THEN 'MEDIUM' ELSE 'SAFE' END AS bucket,
    CASE WHEN probability >= 0.5 * 1.5 THEN 'VERY_HIGH' WHEN probability >= 0.5 THEN 'HIGH' WHEN probability >= 0.25 THEN 'LOW' ELSE 'VERY_LOW' END AS level FROM rule_probs""")
def _bucket(v: Views):
    p = F.col("probability")
    return v.rule_probs.select("symbol", "signal_time", scoring.risk_bucket(p * 120).alias("bucket"), scoring.threshold_level(p, F.lit(0.5)).alias("level"))


PUMP_SIZES = {"sizes": "SELECT symbol, part, abs(change_pct) / 100 AS x FROM tickers"}


@query("score_pump_htf", """
  SELECT symbol, part, greatest(0, least(100, CASE WHEN x <= 0.10 THEN 0 WHEN x <= 0.30 THEN 30 + (x - 0.10::DOUBLE) / 0.20::DOUBLE * 30 WHEN x <= 0.80 THEN 60 + (x - 0.30::DOUBLE) / 0.50::DOUBLE * 30
    ELSE 95 + least(5, (x - 0.80::DOUBLE) * 5) END)) AS score FROM sizes""", views=PUMP_SIZES, floats="score")
def _pump_size(v: Views):
    return v.tickers.select("symbol", "part", scoring.pump_magnitude(F.abs("change_pct") / 100).alias("score"))


from tidemark.plans.q_timeline import _expand  # noqa: E402

TIER_VIEW = {**SCORED_VIEW, "parts": """
  SELECT s.symbol, s.feature_time, s.c4, s.c8, s.c1, s.c5, s.c6, s.c2, s.c3, s.btc_regime, greatest(coalesce(f.price_ret_24h, 0), 0) AS x,
    CASE WHEN coalesce(f.volume_percentile_24h, 0) = 0 THEN CASE WHEN f.price_ret_24h > 0 THEN greatest(0, least(100, 90 * 0.5 * least(1, f.price_ret_24h / 0.5))) ELSE 0 END ELSE c1 END AS pv,
    CASE WHEN coalesce(f.taker_buy_ratio, 0) = 0 THEN CASE WHEN f.taker_buy_ratio_change_1h < 0 THEN 80.0 ELSE 70.0 END ELSE c5 END AS tk
  FROM scored s JOIN features f USING (symbol, feature_time)""",
             "tiers": """
  SELECT symbol, feature_time, btc_regime, greatest(0, least(100, greatest(0, least(100, CASE WHEN x <= 0.10 THEN 0 WHEN x <= 0.30 THEN 30 + (x - 0.10) / 0.20 * 30 WHEN x <= 0.80 THEN 60 + (x - 0.30) / 0.50 * 30
      ELSE 95 + least(5, (x - 0.80) * 5) END)) * 0.35 + c4 * 0.25 + pv * 0.25 + c8 * 0.15)) AS h, greatest(0, least(100, tk * 0.30 + c6 * 0.25 + c2 * 0.25 + c3 * 0.20)) AS l FROM parts""",
             "totals": """
  SELECT *, CASE WHEN h >= 50 AND l >= 48 THEN CASE WHEN btc_regime = 'FOMO' THEN greatest(0, m + b - 15) ELSE m + b END WHEN h >= 50 THEN
      CASE WHEN btc_regime = 'FOMO' THEN greatest(0, 0.65 * h + 0.35 * l - 10) ELSE 0.65 * h + 0.35 * l END ELSE m END AS tier_score
  FROM (SELECT *, 0.40 * h + 0.60 * l AS m, least(18, (h - 50) * 0.2 + (l - 48) * 0.2) AS b FROM tiers)"""}


@query("score_two_tier", """
  SELECT symbol, feature_time, h AS htf_score, l AS ltf_score, CASE WHEN h >= 50 THEN 'ARMED' ELSE 'NORMAL' END AS htf_state,
    CASE WHEN l >= 48 THEN 'FIRED' WHEN l >= 30 THEN 'WATCH' ELSE 'STANDBY' END AS ltf_state, tier_score,
    CASE WHEN h >= 50 AND l >= 48 THEN CASE WHEN tier_score >= 55 THEN 'SHORT_CANDIDATE' ELSE 'WATCH' END WHEN h >= 50 THEN 'WATCH' WHEN tier_score < 40 THEN 'WAIT' ELSE 'WATCH' END AS tier_recommendation,
    greatest(0.01, least(0.99, 1 / (1 + exp(-0.075 * (tier_score - 48))))) AS tier_probability FROM totals""", views=TIER_VIEW,
       floats="htf_score ltf_score tier_score tier_probability", digits=5)
def _two_tier(v: Views):
    f = ordered.with_scalar(v.features, v.benchmark_return(), "benchmark_ret")
    t = scoring.two_tier(f, F.coalesce("benchmark_ret", F.lit(0.0)))
    return t.select("symbol", "feature_time", "htf_score", "ltf_score", "htf_state", "ltf_state", "tier_score", "tier_recommendation", "tier_probability")


@query("prj_candidate_rules", """
  SELECT symbol, feature_time, total_score, NOT bad AND pump AND (near OR weak OR deriv OR sc) AS passed, concat_ws('|', CASE WHEN bad THEN 'quality_gate_failed' END,
    CASE WHEN pump THEN 'pump_or_price_return' END, CASE WHEN near THEN 'near_high' END, CASE WHEN weak THEN 'momentum_weakening' END, CASE WHEN deriv THEN 'derivatives_abnormal' END,
    CASE WHEN sc THEN 'heuristic_score' END, CASE WHEN NOT (NOT bad AND pump AND (near OR weak OR deriv OR sc)) THEN 'candidate_rejected' END) AS reasons
  FROM (SELECT s.symbol, s.feature_time, s.total_score, s.quality_status NOT IN ('valid','warning') OR s.data_quality_score < 0.8 AS bad, coalesce(f.price_ret_24h, 0) >= 0.0 AS pump,
      coalesce(f.distance_from_high_24h, 0) >= -0.08 AS near, coalesce(f.momentum_deceleration_4h, 0) <= -0.01 AS weak,
      coalesce(f.funding_zscore_30d, 0) >= 2 OR coalesce(f.oi_change_24h, 0) <= -0.05 AS deriv, s.total_score >= 35 AS sc,
      row_number() OVER (PARTITION BY s.symbol ORDER BY s.feature_time DESC) AS rn FROM scored s JOIN features f USING (symbol, feature_time)) WHERE rn = 1""",
       views=SCORED_VIEW, floats="total_score", digits=5)
def _rules(v: Views):
    c = candidates.candidate_rules(scored(v, v.latest_features), min_return=0.0)
    return c.select("symbol", "feature_time", "total_score", "passed", F.array_join("reason_codes", "|").alias("reasons"))


@query("agg_candidate_recall", """
  WITH c AS (SELECT DISTINCT symbol FROM rule_probs WHERE probability >= 0.62), e AS (SELECT symbol FROM label_events WHERE event_id IS NOT NULL)
  SELECT (SELECT count(*) FROM c) AS candidate_count, count(DISTINCT symbol) AS event_count, count(DISTINCT symbol) FILTER (symbol IN (SELECT symbol FROM c)) AS caught_event_count,
    count(DISTINCT symbol) FILTER (symbol IN (SELECT symbol FROM c)) / nullif(count(DISTINCT symbol), 0)::DOUBLE AS event_recall,
    greatest(0, 1 - (SELECT count(*) FROM c) / count(*)::DOUBLE) AS reduction_ratio FROM e""", floats="event_recall reduction_ratio")
def _recall(v: Views):
    return candidates.candidate_recall(v.rule_probs.where("probability >= 0.62"), v.label_events.where("event_id IS NOT NULL"))


@query("score_position_pnl", """
  SELECT o_orderkey, round(change * 100, 2) AS position_change_pct, round(change * 100 * lev, 2) AS position_roi_pct,
    CASE WHEN notional > 0 THEN round(change * notional, 8) WHEN qty > 0 THEN round((price - entry) * qty * sgn, 8) END AS position_pnl
  FROM (SELECT *, CASE WHEN side = 'LONG' THEN 1.0 ELSE -1.0 END AS sgn, CASE WHEN side = 'LONG' THEN 1.0 ELSE -1.0 END * (price - entry) / entry AS change FROM (
    SELECT o_orderkey, 100.0::DOUBLE + o_orderkey % 50 AS price, 90.0::DOUBLE + o_orderkey % 37 AS entry, CASE WHEN o_orderstatus = 'F' THEN 'SHORT' ELSE 'LONG' END AS side,
      CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS notional, CASE WHEN o_orderkey % 3 = 1 THEN 5.0::DOUBLE END AS qty, 1.0::DOUBLE + o_orderkey % 4 AS lev FROM orders))""",
       floats="position_change_pct position_roi_pct position_pnl", digits=8)
def _pnl(v: Views):
    o = v.table("orders").selectExpr("o_orderkey", "100D + o_orderkey % 50 AS price", "90D + o_orderkey % 37 AS entry", "CASE WHEN o_orderstatus = 'F' THEN 'short' ELSE 'long' END AS side",
                                     "CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS notional", "CASE WHEN o_orderkey % 3 = 1 THEN 5D END AS qty", "1D + o_orderkey % 4 AS lev")
    c = F.col
    return o.select("o_orderkey", *[e.alias(n) for n, e in scoring.position_metrics(c("price"), c("entry"), c("side"), c("qty"), c("notional"), c("lev")).items()])


@query("score_alert_policy", """
  SELECT prediction_id, policy_reason, policy_reason = 'policy_pass' AS alert_allowed FROM (SELECT prediction_id, CASE WHEN cell % 9 = 0 THEN 'data_quality_invalid'
    WHEN probability < 0.6 THEN 'tier_not_high_confidence' WHEN probability < 0.62 THEN 'probability_below_threshold' WHEN cell % 5 = 0 THEN 'cooldown_active'
    WHEN cell % 17 >= 15 THEN 'global_daily_budget_exhausted' WHEN cell % 4 >= 2 THEN 'coin_daily_budget_exhausted' ELSE 'policy_pass' END AS policy_reason FROM predictions)""")
def _policy(v: Views):
    p = v.predictions.selectExpr("prediction_id", "probability", "CASE WHEN cell % 9 = 0 THEN 'invalid' ELSE 'VALID' END AS quality_status",
                                 "CASE WHEN probability >= 0.6D THEN 'HIGH_CONFIDENCE' ELSE 'WATCH' END AS tier", "0.62D AS threshold", "cell % 5 = 0 AS in_cooldown",
                                 "cell % 17 AS global_count", "cell % 4 AS coin_count")
    return scoring.alert_policy(p).select("prediction_id", "policy_reason", "alert_allowed")


@query("score_filter_trace", """
  SELECT symbol, feature_time, substr(sha256(symbol || '|' || strftime(feature_time, '%Y-%m-%dT%H:%M:%S.%g') || '|24|rule-1'), 1, 32) AS prediction_id,
    CASE WHEN probability >= 0.4 THEN 'candidate' ELSE 'observed' END AS state, feature_time + INTERVAL 24 HOUR AS invalidation_time, sha256('bundle-1') AS bundle_checksum
  FROM (SELECT symbol, signal_time AS feature_time, probability FROM rule_probs)""")
def _trace(v: Views):
    r = v.rule_probs.selectExpr("symbol", "signal_time AS feature_time", "CASE WHEN probability >= 0.4D THEN 'WATCH' ELSE 'WAIT' END AS recommendation")
    return scoring.audit_trace(r, "rule-1").drop("recommendation")


# --- rankings ---------------------------------------------------------------------------------------------------

ELIG = {"eligible": """
  SELECT * FROM tickers WHERE quote_volume >= 1000000 AND NOT (symbol LIKE '%USDT' AND substr(symbol, 1, length(symbol) - 4) IN
    ('USDT','USDC','DAI','TUSD','FDUSD','BUSD','USDP','EUR','GBP','TRY','BRL','ARS','RUB',''))"""}
for _m, _o in (("gainers", "change_pct DESC"), ("losers", "change_pct"), ("volume", "quote_volume DESC"), ("volatile", "abs(change_pct) DESC")):
    ELIG[f"top_{_m}"] = f"SELECT *, row_number() OVER (ORDER BY {_o}, symbol) AS mode_rank FROM eligible QUALIFY mode_rank <= 60"


@query("flt_tickers", "SELECT symbol, part, quote_volume, change_pct FROM eligible WHERE abs(change_pct) >= 20", views=ELIG, floats="quote_volume change_pct")
def _tickers(v: Views):
    return selection.filter_tickers(v.tickers, 1_000_000, 20.0).select("symbol", "part", "quote_volume", "change_pct")


def _topk(mode: str):
    @query(f"topk_{mode}", f"SELECT symbol, change_pct, quote_volume FROM top_{mode}", views=ELIG, floats="change_pct quote_volume")
    def build(v: Views):
        return selection.top_by_mode(selection.filter_tickers(v.tickers), mode, 60).select("symbol", "change_pct", "quote_volume")


for _m in ("gainers", "losers", "volume", "volatile"):
    _topk(_m)

UNION = {**ELIG, "modes": """
  SELECT symbol, mode, mode_order, mode_rank FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY mode_order, mode_rank) AS rn FROM (
    SELECT symbol, 'gainers' AS mode, 0 AS mode_order, mode_rank FROM top_gainers UNION ALL SELECT symbol, 'losers', 1, mode_rank FROM top_losers
    UNION ALL SELECT symbol, 'volume', 2, mode_rank FROM top_volume)) WHERE rn = 1"""}


@query("topk_modes_union", "SELECT * FROM modes", views=UNION, ints="mode_rank")
def _modes(v: Views):
    return selection.union_of_modes(selection.filter_tickers(v.tickers), "all", 60).select("symbol", "mode", "mode_order", "mode_rank")


def manual_symbols(v: Views):
    return v.tickers.where("part <= 400 AND part % 40 = 0").selectExpr("symbol", "part AS position")


@query("topk_scan_list", """
  WITH m AS (SELECT symbol, 0 AS a, 0 AS b, part AS c FROM tickers WHERE part <= 400 AND part % 40 = 0 UNION ALL SELECT symbol, 1, mode_order, mode_rank FROM modes),
  d AS (SELECT symbol, row_number() OVER (ORDER BY a, b, c, symbol) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY a, b, c) AS rn FROM m) WHERE rn = 1)
  SELECT symbol, slot FROM d WHERE slot <= 49 UNION ALL SELECT 'BTCUSDT', 50""", views=UNION, ints="slot")
def _scan_list(v: Views):
    auto = selection.union_of_modes(selection.filter_tickers(v.tickers), ["gainers", "losers", "volume"], 60)
    return selection.scan_list(manual_symbols(v), auto, 50)


UNIVERSE = {**ELIG, "pins": "SELECT symbol, part FROM eligible WHERE part <= 400 AND part % 40 = 0",
            "moves": """SELECT symbol, row_number() OVER (ORDER BY abs(change_pct) DESC, symbol) AS r FROM eligible WHERE symbol NOT IN (SELECT symbol FROM pins)""",
            "first_": """SELECT symbol, 'pinned' AS source, part AS source_rank FROM pins UNION ALL SELECT symbol, 'movement', r FROM moves WHERE r <= ceil((120 - (SELECT count(*) FROM pins)) * 0.7)""",
            "vols": "SELECT symbol, row_number() OVER (ORDER BY quote_volume DESC, symbol) AS r FROM eligible WHERE symbol NOT IN (SELECT symbol FROM first_)"}


@query("topk_universe_quota", """
  SELECT symbol, source, source_rank FROM first_ UNION ALL SELECT symbol, 'volume', r FROM vols WHERE r <= 120 - (SELECT count(*) FROM first_)""", views=UNIVERSE, ints="source_rank")
def _universe(v: Views):
    return selection.comparison_universe(selection.filter_tickers(v.tickers), manual_symbols(v), 120).select("symbol", "source", "source_rank")


@query("win_rank_candidates", """
  SELECT symbol, scan_time, rank, rank <= 3 AS selected FROM (SELECT symbol, scan_time, CASE WHEN ok THEN row_number() OVER (PARTITION BY scan_time, ok ORDER BY score DESC, symbol) END AS rank
    FROM (SELECT symbol, scan_time, score, score >= 30 AND cell % 6 <> 0 AS ok FROM scans))""".replace("rank <= 3 AS selected", "coalesce(rank <= 3, FALSE) AS selected"), ints="rank")
def _rank(v: Views):
    d = v.scans.selectExpr("symbol", "scan_time", "unix_micros(scan_time) AS scan_t", "score AS rank_score", "score >= 30 AS selected",
                           "CASE WHEN cell % 6 = 0 THEN 'DUMPED' ELSE 'PUMPING' END AS stage")
    return candidates.rank_decisions(d, 3).select("symbol", "scan_time", "rank", "selected")


# --- candidate filters ---------------------------------------------------------------------------------------------

PUMP = {"dpos": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY feature_time) - 1 AS pos FROM daily_prices",
        "wins": """
  SELECT a.symbol, a.pos, b.pos - a.pos AS pump_days, (SELECT max(c.high) FROM dpos c WHERE c.symbol = a.symbol AND c.pos BETWEEN a.pos AND b.pos) AS peak_price, a.open
  FROM dpos a JOIN dpos b ON a.symbol = b.symbol AND b.pos - a.pos BETWEEN 1 AND 5""",
        "best": """
  SELECT symbol, pump_days, peak_price, peak_price / open - 1 AS pump_pct FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY peak_price / open - 1 DESC, pos, pump_days) AS rn
    FROM wins WHERE peak_price / open - 1 > 0) WHERE rn = 1"""}


@query("win_pump_daily", """
  SELECT b.symbol, pump_days, peak_price, pump_pct, l.close, l.quote_volume, l.close / peak_price AS current_vs_peak FROM best b JOIN
    (SELECT symbol, arg_max(close, feature_time) AS close, arg_max(quote_volume, feature_time) AS quote_volume FROM daily_prices GROUP BY symbol) l USING (symbol)
  WHERE pump_pct BETWEEN 0.05 AND 500 AND l.close / peak_price >= 0.1 AND quote_volume >= 1000""", views=PUMP, floats="peak_price pump_pct close quote_volume current_vs_peak", ints="pump_days")
def _pump(v: Views):
    return candidates.pump_candidates(v.daily_prices, min_pump=0.05, max_pump=500.0, keep=0.1, min_volume=1_000)


RUN = {"rwin": """
  SELECT a.symbol, a.close_time AS scan_time, h.h, b.close_time AS bt, b.high, b.low, first_value(b.open) OVER w AS o,
    least(first_value(b.open) OVER w, min(b.low) OVER (PARTITION BY a.symbol, a.close_time, h.h ORDER BY b.close_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS ref
  FROM bars_1h a CROSS JOIN (VALUES (24), (72), (120)) h(h) JOIN bars_1h b ON a.symbol = b.symbol AND b.close_time > a.close_time - h.h * INTERVAL 1 HOUR AND b.close_time <= a.close_time
  WINDOW w AS (PARTITION BY a.symbol, a.close_time, h.h ORDER BY b.close_time)""",
       "runs": """
  SELECT symbol, scan_time, h, greatest(max(high / ref - 1), 0) AS ret FROM rwin GROUP BY ALL"""}


@query("win_best_runup", """
  SELECT symbol, scan_time, max(ret) FILTER (h = 24) AS ret_24, max(ret) FILTER (h = 72) AS ret_72, max(ret) FILTER (h = 120) AS ret_120 FROM runs GROUP BY ALL""",
       views=RUN, floats="ret_24 ret_72 ret_120")
def _runup(v: Views):
    return candidates.run_ups(v.bars_1h).select("symbol", "scan_time", "ret_24", "ret_72", "ret_120")


@query("win_pump_signal", """
  SELECT symbol, scan_time, greatest(max(ret / t), 0) AS pump_score, bool_or(ret + 1e-12 >= t) AS direct_pump FROM (
    SELECT *, CASE h WHEN 24 THEN 0.15 WHEN 72 THEN 0.30 ELSE 0.50 END::DOUBLE AS t FROM runs) GROUP BY ALL""", views=RUN, floats="pump_score")
def _signal(v: Views):
    return candidates.pump_signal(candidates.run_ups(v.bars_1h)).select("symbol", "scan_time", "pump_score", "direct_pump")


def small_bars(v: Views):
    return v.bars_5m.selectExpr("symbol", "open_time", "close_time", "open", "high", "low", "close", "volume_quote", "taker_buy_base * close AS taker_buy_quote")


FLOW = {"flow": """
  SELECT a.symbol, a.close_time, sum(b.volume_quote) AS volume_24h, sum(least(b.taker_buy_base * b.close, b.volume_quote)) / sum(b.volume_quote) AS buy_share,
    sum(CASE WHEN b.close < b.open THEN b.volume_quote ELSE 0 END) / sum(b.volume_quote) AS red_share, max(b.high) AS top_price
  FROM bars_5m a JOIN bars_5m b ON a.symbol = b.symbol AND b.close_time > a.close_time - INTERVAL 24 HOUR AND b.close_time <= a.close_time GROUP BY ALL"""}


@query("win_rolling_volume_24h", "SELECT symbol, close_time, volume_24h FROM flow", views=FLOW, floats="volume_24h")
def _volume(v: Views):
    return candidates.flow_evidence(small_bars(v)).select("symbol", "close_time", "volume_24h")


@query("score_stage", """
  WITH d AS (SELECT *, greatest(0, 1 - close / top_price) AS drawdown FROM (SELECT f.*, b.close FROM flow f JOIN bars_5m b USING (symbol, close_time))),
  s AS (SELECT *, CASE WHEN drawdown + 1e-12 >= 0.25 THEN 'DUMPED' WHEN drawdown + 1e-12 >= 0.05 THEN 'DISTRIBUTING' WHEN drawdown + 1e-12 >= 0.02 THEN 'EXHAUSTING' ELSE 'PUMPING' END AS stage,
    (drawdown + 1e-12 >= 0.02)::INT + (buy_share < 0.5)::INT + (red_share > 0.5)::INT AS n FROM d)
  SELECT symbol, close_time, stage, concat_ws('|', CASE WHEN drawdown + 1e-12 >= 0.02 THEN 'price_structure' END, CASE WHEN buy_share < 0.5 THEN 'order_flow' END,
    CASE WHEN red_share > 0.5 THEN 'volume_distribution' END) AS evidence, 0.7 * CASE stage WHEN 'DUMPED' THEN 1.0 WHEN 'DISTRIBUTING' THEN 0.75 WHEN 'EXHAUSTING' THEN 0.35 ELSE 0 END
      + 0.3 * least(1, n / 2.0) AS transition_score FROM s""", views=FLOW, floats="transition_score")
def _stage(v: Views):
    f = candidates.flow_evidence(small_bars(v)).join(v.bars_5m.select("symbol", "close_time", "close"), ["symbol", "close_time"])
    f = with_exprs(f, drawdown="greatest(0D, 1D - close / top_price)", pump_score="0D")
    return candidates.stage_scores(f).select("symbol", "close_time", "stage", F.array_join("evidence_groups", "|").alias("evidence"), "transition_score")


@query("st_episode_replay")
def _episodes(v: Views):
    """Batch replay of the episode state; checked against the plain state class in the tests."""
    return candidates.replay_episodes(candidates.episode_input(v.bars_1h, small_bars(v)))


def decisions(v: Views):
    """Two arms' decisions: by probability and by short return."""
    return v.rule_probs.selectExpr("symbol", "signal_time AS observed_at", "close AS reference_price", "explode(array("
                                   "struct('v1' AS filter_version, probability >= 0.5D AS selected), struct('v2' AS filter_version, ret_1 >= 0D AS selected))) AS d").select(
        "symbol", "observed_at", "reference_price", "d.*")


DEC = {"decisions": """
  SELECT symbol, signal_time AS observed_at, close AS reference_price, d.v AS filter_version, d.s AS selected FROM (
    SELECT *, unnest([{'v': 'v1', 's': probability >= 0.5}, {'v': 'v2', 's': ret_1 >= 0}]) AS d FROM rule_probs)""",
       "buckets": """
  SELECT * FROM (SELECT *, make_timestamp((epoch_us(observed_at) // 10800000000) * 10800000000) AS bucket,
    row_number() OVER (PARTITION BY filter_version, symbol, epoch_us(observed_at) // 10800000000 ORDER BY observed_at) AS rn FROM decisions) WHERE rn = 1"""}


@query("win_decision_bucket", "SELECT symbol, observed_at, filter_version, selected, bucket FROM buckets", views=DEC)
def _buckets(v: Views):
    return candidates.decision_buckets(decisions(v), 180).select("symbol", "observed_at", "filter_version", "selected", "bucket")


@query("win_episode_id", """
  SELECT symbol, filter_version, bucket, CASE WHEN selected THEN substr(sha256('episode|' || filter_version || '|' || symbol || '|' || strftime(max(b0) OVER w, '%Y-%m-%dT%H:%M:%S')), 1, 32) END AS episode_id
  FROM (SELECT *, CASE WHEN selected AND NOT coalesce(lag(selected) OVER w AND epoch_us(bucket) - epoch_us(lag(bucket) OVER w) <= 21600000000, FALSE) THEN bucket END AS b0 FROM buckets
    WINDOW w AS (PARTITION BY filter_version, symbol ORDER BY bucket)) WINDOW w AS (PARTITION BY filter_version, symbol ORDER BY bucket)""", views=DEC)
def _episode_id(v: Views):
    return candidates.episode_ids(candidates.decision_buckets(decisions(v), 180), 180).select("symbol", "filter_version", "bucket", "episode_id")


@query("win_truth_events", """
  SELECT symbol, signal_time, symbol || '_' || (epoch_us(min(target_time) OVER (PARTITION BY symbol, g)) // 1000000) AS truth_event FROM (
    SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY target_time, signal_time ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT symbol, signal_time, target_time,
      CASE WHEN lag(target_time) OVER w IS NULL OR epoch_us(target_time) - epoch_us(lag(target_time) OVER w) >= 14400000000 THEN 1 ELSE 0 END AS nw
      FROM labels_24 WHERE label_value = 1 WINDOW w AS (PARTITION BY symbol ORDER BY target_time, signal_time)))""")
def _truth(v: Views):
    return candidates.truth_events(v.labels.where("label_value = 1")).select("symbol", "signal_time", "truth_event")


AUDIT = {**ELIG, "uni": "SELECT symbol, part, quote_volume, change_pct, last_px FROM eligible",
         "audit": """
  SELECT u.symbol, part % 21 <> 0 AS available, CASE WHEN part % 21 <> 0 THEN last_px END AS close, part % 7 = 2 AS pump, part % 5 <> 1 AS prod, part % 4 <> 3 AS chal, part, change_pct FROM uni u"""}


@query("join_paired_audit", """
  SELECT symbol, available, close, 'champion' AS arm, CASE WHEN pump THEN 'PUMP_CANDIDATE' WHEN prod THEN 'FALLBACK' ELSE 'REJECTED' END AS stage,
    CASE WHEN pump THEN TRUE WHEN prod THEN part % 2 = 0 ELSE FALSE END AS selected, CASE WHEN pump THEN part WHEN prod AND part % 2 = 0 THEN part + 1 END AS rank,
    CASE WHEN pump THEN change_pct END AS rank_score, CASE WHEN pump AND available THEN greatest(0, 1 - close / 2000.0) END AS drawdown FROM audit
  UNION ALL SELECT symbol, available, close, 'challenger', CASE WHEN chal THEN CASE WHEN change_pct > 0 THEN 'PUMPING' ELSE 'DUMPED' END ELSE 'DATA_UNAVAILABLE' END,
    chal AND change_pct > 0, CASE WHEN chal THEN part + 2 END, CASE WHEN chal THEN change_pct END, NULL FROM audit""",
       views=AUDIT, floats="close rank_score drawdown", ints="rank", digits=8)
def _audit(v: Views):
    return audit_rows(v).select("symbol", "available", "close", "arm", "stage", "selected", "rank", "rank_score", "drawdown")


def audit_rows(v: Views):
    u = selection.filter_tickers(v.tickers)
    return candidates.paired_audit(
        u.select("symbol"), u.where("part % 21 <> 0").selectExpr("lower(symbol) AS symbol", f"{v.now} AS observed_at", "last_px AS close"),
        u.where("part % 7 = 2").selectExpr("symbol", "part AS rank", "change_pct AS pump_pct", "2000D AS peak_price"),
        u.where("part % 5 <> 1").selectExpr("symbol", "part + 1 AS rank", "part % 2 = 0 AS selected"),
        u.where("part % 4 <> 3").selectExpr("symbol", "change_pct > 0 AS selected", "CASE WHEN change_pct > 0 THEN 'PUMPING' ELSE 'DUMPED' END AS stage", "part + 2 AS rank",
                                            "change_pct AS rank_score"), fallback_all=True)


@query("set_overlap_selected", """
  WITH f AS (SELECT CASE WHEN pump THEN TRUE WHEN prod THEN part % 2 = 0 ELSE FALSE END AS a, chal AND change_pct > 0 AS b FROM audit WHERE available)
  SELECT count(*) FILTER (a AND b) AS overlap, count(*) FILTER (a AND NOT b) AS champion_only, count(*) FILTER (NOT a AND b) AS challenger_only,
    count(*) FILTER (NOT a AND NOT b) AS neither FROM f""", views=AUDIT)
def _overlap(v: Views):
    return selection.selection_overlap(audit_rows(v).where("available"))


# --- set operations -------------------------------------------------------------------------------------------------

LIST_SQL = {"listings": """
  SELECT 'spot' AS venue, n_name AS base, CASE WHEN n_nationkey % 2 = 0 THEN 'USDT' ELSE 'BTC' END AS quote, TRUE AS trading FROM nation UNION ALL
  SELECT 'usdm', n_name, 'USDT', s_acctbal > 0 FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL
  SELECT 'coinm', CASE WHEN c_mktsegment = 'BUILDING' THEN n_name ELSE c_mktsegment END, 'USD', c_acctbal > 0 FROM customer JOIN nation ON c_nationkey = n_nationkey"""}


@query("set_listing_stats", """
  WITH b AS (SELECT base, bool_or(venue = 'spot') AS s, bool_or(venue = 'usdm') AS u, bool_or(venue = 'coinm') AS c FROM listings WHERE trading GROUP BY base)
  SELECT count(*) FILTER (s) AS spot_coins, count(*) FILTER (u) AS usdm_coins, count(*) FILTER (c) AS coinm_coins, count(*) FILTER (u OR c) AS futures_coins, count(*) AS all_coins,
    count(*) FILTER (s AND NOT (u OR c)) AS spot_only, count(*) FILTER (NOT s AND (u OR c)) AS futures_only, count(*) FILTER (s AND (u OR c)) AS both,
    (SELECT count(*) FROM listings WHERE trading AND venue = 'spot') AS spot_symbols, (SELECT count(*) FROM listings WHERE trading AND venue = 'usdm') AS usdm_symbols,
    (SELECT count(*) FROM listings WHERE trading AND venue = 'spot' AND quote = 'USDT') AS spot_usdt_pairs FROM b""", views=LIST_SQL)
def _listing(v: Views):
    n = v.table("nation")
    names = n.select("n_nationkey", "n_name")
    spot = n.selectExpr("'spot' AS venue", "n_name AS base", "CASE WHEN n_nationkey % 2 = 0 THEN 'USDT' ELSE 'BTC' END AS quote", "true AS trading")
    usdm = v.table("supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "'usdm' AS venue", "n_name AS base", "'USDT' AS quote", "s_acctbal > 0 AS trading")
    coinm = v.table("customer").join(names, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "'coinm' AS venue", "CASE WHEN c_mktsegment = 'BUILDING' THEN n_name ELSE c_mktsegment END AS base", "'USD' AS quote", "c_acctbal > 0 AS trading")
    return selection.listing_stats(spot.unionByName(usdm).unionByName(coinm))


@query("set_listing_history", """
  WITH h AS (SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS n FROM orders GROUP BY 1), s AS (SELECT max(date) AS date, 0 AS n FROM h)
  SELECT * FROM (SELECT * FROM h WHERE date NOT IN (SELECT date FROM s) UNION ALL SELECT * FROM s) ORDER BY date DESC LIMIT 365""")
def _history(v: Views):
    h = v.table("orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return selection.upsert_history(h, h.agg(F.max("date").alias("date"), F.lit(0).cast("bigint").alias("n")))


@query("set_crossing_events", """
  SELECT event_id FROM label_events WHERE event_id IS NOT NULL AND cell_ % 2 = 0 INTERSECT SELECT event_id FROM label_events WHERE event_id IS NOT NULL AND cell_ % 2 = 1"""
       .replace("cell_", "(epoch_us(signal_time) // 3600000000)"))
def _crossing(v: Views):
    e = v.label_events.where("event_id IS NOT NULL").selectExpr("event_id", "unix_micros(signal_time) DIV 3600000000L AS cell")
    return e.where("cell % 2 = 0").select("event_id").intersect(e.where("cell % 2 = 1").select("event_id"))


@query("set_union_training", """
  SELECT prediction_id, label_value, 'live' AS training_source FROM judged WHERE model_id = 'm_even' UNION ALL
  SELECT prediction_id, label_value, 'historical' FROM judged WHERE model_id = 'm_odd'""", ints="label_value")
def _training(v: Views):
    j = v.judged.select("prediction_id", "label_value", "model_id")
    live = j.where("model_id = 'm_even'").drop("model_id")
    return selection.combine_training(j.drop("model_id"), live, key=["prediction_id"], max_historical=10_000_000).select(
        "prediction_id", "label_value", "training_source")


@query("set_union_activity", """
  SELECT * FROM (SELECT sent_at AS logged_at, symbol, 'Composite Scoring' AS step, CASE WHEN sent THEN 'ALERT FIRED' ELSE 'SCORED' END AS status, probability * 100 AS score FROM alerts
      WHERE signal_time >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR AND signal_time <= (SELECT max(ts) FROM events) UNION ALL
    SELECT scan_time, symbol, 'Scan + Score', recommendation, score FROM scans WHERE scan_time >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR AND scan_time <= (SELECT max(ts) FROM events))
  ORDER BY logged_at DESC, symbol, step LIMIT 30""", floats="score")
def _activity(v: Views):
    day = f"{{0}} BETWEEN {v.now} - INTERVAL 24 HOURS AND {v.now}"
    a = v.alerts.where(day.format("signal_time")).selectExpr("sent_at AS logged_at", "symbol", "'Composite Scoring' AS step", "CASE WHEN sent THEN 'ALERT FIRED' ELSE 'SCORED' END AS status", "probability * 100 AS score")
    s = v.scans.where(day.format("scan_time")).selectExpr("scan_time AS logged_at", "symbol", "'Scan + Score' AS step", "recommendation AS status", "score")
    return a.unionByName(s).orderBy(F.col("logged_at").desc(), "symbol", "step").limit(30)


@query("fn_symbol_and_epoch", """
  SELECT p_partkey, CASE WHEN upper(trim(p_brand)) LIKE '%USDT' THEN upper(trim(p_brand)) ELSE upper(trim(p_brand)) || 'USDT' END AS symbol,
    make_timestamp(CASE WHEN p_partkey % 3 = 0 THEN 1700000000 + p_partkey WHEN p_partkey % 3 = 1 THEN 1700000000 + p_partkey ELSE 1700000000 + p_partkey END * 1000000) AS t FROM part""")
def _scalars(v: Views):
    p = v.table("part").selectExpr("p_partkey", "concat(' ', lower(p_brand), CASE WHEN p_partkey % 2 = 0 THEN 'usdt' ELSE '' END) AS raw",
                                   "(1700000000L + p_partkey) * CASE p_partkey % 3 WHEN 0 THEN 1L WHEN 1 THEN 1000L ELSE 1000000L END AS n")
    return p.select("p_partkey", normalize_symbol("raw").alias("symbol"), sniff_epoch("n").alias("t"))

"""Queries of the timeline, quality rules and features."""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features, ordered, quality, scoring, timeline
from tidemark.operators.features import FEATURES
from tidemark.plans.registry import query
from tidemark.plans.views import HOUR, Views

SIDE = ("open_interest_contracts open_interest_value buy_volume sell_volume buy_sell_ratio global_long_account "
        "global_short_account global_long_short_ratio top_long_account top_short_account top_long_short_ratio "
        "top_long_short_position_ratio")


@query("join_align_5m", "SELECT * FROM aligned", floats="open high low close volume_base volume_quote " + SIDE, ints="trade_count")
def _align(v: Views):
    return v.aligned


@query("join_align_grid_5m", """
  SELECT k.symbol, k.close_time AS feature_time, k.close, t.buy AS buy_volume FROM bars_5m k
  LEFT JOIN (SELECT symbol, cell, CAST(sum(qty) FILTER (is_buy) AS DOUBLE) AS buy FROM
    (SELECT symbol, epoch_us(ts) // 300000000 AS cell, qty, is_buy FROM ticks) GROUP BY ALL) t
    ON k.symbol = t.symbol AND k.cell = t.cell AND t.cell % 7 <> 3
  WHERE k.close_time <= (SELECT max(ts) FROM events) AND k.quality_status IN ('valid','warning')""",
       floats="close buy_volume")
def _align_5m(v: Views):
    """The same join on the 5-minute grid; every 7th cell is published 6 s after the bar end."""
    from tidemark.functions.columns import from_micros, grid
    cells = v.ticks.groupBy("symbol", grid("ts", 300).alias("cell")).agg(
        F.sum(F.when(F.col("is_buy"), F.col("qty"))).cast("double").alias("buy_volume"))
    start, end = F.col("cell") * F.lit(300_000_000), (F.col("cell") + 1) * F.lit(300_000_000)
    side = cells.select("symbol", from_micros(start).alias("period_end"), F.lit("valid").alias("quality_status"),
                        from_micros(end + F.when(F.col("cell") % 7 == 3, 6_000_000).otherwise(1_000_000))
                        .alias("available_time"), "buy_volume", F.lit(None).cast("double").alias("sell_volume"),
                        F.lit(None).cast("double").alias("buy_sell_ratio"))
    out = timeline.align(v.bars_5m, {"taker_volume": side}, v.as_of)
    return out.select("symbol", "feature_time", "close", "buy_volume")


@query("join_asof_backward", """
  SELECT symbol, feature_time, funding_rate_last_known, funding_event_time, funding_age_minutes FROM funded""",
       floats="funding_rate_last_known", ints="funding_age_minutes", digits=8)
def _asof(v: Views):
    return timeline.add_funding(v.aligned, v.funding).select(
        "symbol", "feature_time", "funding_rate_last_known", "funding_event_time", "funding_age_minutes")


@query("join_asof_nearest", """
  WITH b AS (SELECT k.symbol, k.close_time, k.close, f.event_time, f.funding_rate,
      row_number() OVER (PARTITION BY k.symbol, k.close_time ORDER BY abs(epoch_us(f.event_time) - epoch_us(k.close_time)), f.event_time) AS rn
    FROM bars_1h k JOIN funding f ON k.symbol = f.symbol AND abs(epoch_us(f.event_time) - epoch_us(k.close_time)) <= 28800000000)
  SELECT k.symbol, k.close_time, k.close, b.event_time, b.funding_rate FROM bars_1h k
  LEFT JOIN b ON k.symbol = b.symbol AND k.close_time = b.close_time AND b.rn = 1""", floats="close funding_rate", digits=8)
def _nearest(v: Views):
    left = v.bars_1h.select("symbol", "close_time", "close")
    return ordered.asof_nearest(left, v.funding, ["symbol"], "close_time", "event_time",
                                ["event_time", "funding_rate"], tolerance=8 * HOUR)


@query("join_asof_ffill", """
  SELECT k.symbol, k.close_time, coalesce(f.regime, 'SIDEWAY') AS regime FROM bars_5m k ASOF LEFT JOIN
    (SELECT symbol, available_time, CASE WHEN funding_rate > 0.035 THEN 'HIGH' ELSE 'LOW' END AS regime FROM funding) f
    ON k.symbol = f.symbol AND k.close_time >= f.available_time""")
def _ffill(v: Views):
    regime = v.funding.withColumn("regime", F.when(F.col("funding_rate") > 0.035, "HIGH").otherwise("LOW"))
    out = ordered.asof_backward(v.bars_5m.select("symbol", "close_time"), regime, ["symbol"], "close_time",
                                "available_time", ["regime"])
    return out.withColumn("regime", F.coalesce("regime", F.lit("SIDEWAY")))


@query("flt_closed_bars", """
  SELECT symbol, close_time, close, make_timestamp((epoch_us((SELECT max(ts) FROM events)) // 300000000) * 300000000 - 1000) AS last_end
  FROM bars_5m WHERE close_time <= (SELECT max(ts) FROM events)""", floats="close")
def _closed(v: Views):
    return (timeline.closed_bars(v.bars_5m, v.as_of)
            .select("symbol", "close_time", "close", timeline.last_closed_end(v.as_of).alias("last_end")))


@query("win_dedup_latest", """
  SELECT user_id, cell, seq, ts FROM (SELECT user_id, epoch_us(ts) // 86400000000 AS cell, seq, ts,
    row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY ts DESC, seq DESC) AS rn FROM ticks) WHERE rn = 1""")
def _dedup(v: Views):
    from tidemark.functions.columns import grid
    t = v.ticks.select("user_id", grid("ts", 86400).alias("cell"), "seq", "ts")
    return ordered.latest_per_key(t, ["user_id", "cell"], ["ts", "seq"])


@query("win_dedup_versions", """
  SELECT symbol, close_time, available_time, close FROM (SELECT symbol, close_time, available_time, close,
      row_number() OVER (PARTITION BY symbol, close_time ORDER BY available_time DESC) AS rn
    FROM (SELECT symbol, close_time, available_time, close FROM bars_1h UNION ALL
      SELECT symbol, close_time, available_time + INTERVAL 90 SECONDS, close + 1.0 FROM bars_1h WHERE cell % 3 = 0)) WHERE rn = 1""",
       floats="close")
def _versions(v: Views):
    first = v.bars_1h.select("symbol", "close_time", "available_time", "close", "cell")
    again = first.where(F.col("cell") % 3 == 0).withColumns({
        "available_time": F.col("available_time") + F.expr("INTERVAL 90 SECONDS"), "close": F.col("close") + 1.0})
    return timeline.newest_version(first.unionByName(again).drop("cell"), "close_time")


@query("dq_kline_rules", """
  SELECT *, CASE WHEN flags <> '' THEN 'invalid' ELSE st END AS status FROM (
    SELECT l_orderkey, l_linenumber, 'valid' AS st, concat_ws('|', CASE WHEN vol < 0 THEN 'negative_volume' END,
      CASE WHEN hi < op OR hi < cl OR hi < lo THEN 'invalid_high_price' END,
      CASE WHEN lo > op OR lo > cl OR lo > hi THEN 'invalid_low_price' END, CASE WHEN n < 0 THEN 'negative_trade_count' END) AS flags
    FROM (SELECT l_orderkey, l_linenumber, l_extendedprice AS hi, l_extendedprice * (1 - l_discount) AS lo,
      l_extendedprice * (0.98::DOUBLE - l_tax) AS op, l_extendedprice * (1 - l_discount) AS cl, l_quantity - 3 AS vol, l_linenumber - 2 AS n FROM lineitem))""")
def _dq_bars(v: Views):
    li = v.table("lineitem")
    x = F.col("l_extendedprice")
    bars = li.select("l_orderkey", "l_linenumber", x.alias("high"), (x * (1 - F.col("l_discount"))).alias("low"),
                     (x * (0.98 - F.col("l_tax"))).alias("open"), (x * (1 - F.col("l_discount"))).alias("close"),
                     (F.col("l_quantity") - 3).alias("volume_base"), (F.col("l_quantity") - 3).alias("volume_quote"),
                     (F.col("l_linenumber") - 2).alias("trade_count"), F.lit("valid").alias("quality_status"),
                     F.array().cast("array<string>").alias("quality_flags"))
    out = quality.assess_bars(bars)
    return out.select("l_orderkey", "l_linenumber", F.lit("valid").alias("st"),
                      F.array_join("quality_flags", "|").alias("flags"), F.col("quality_status").alias("status"))


@query("dq_funding_rules", """
  SELECT symbol, event_time, flags, CASE WHEN flags LIKE '%invalid_mark_price%' THEN 'invalid' WHEN flags <> '' THEN 'warning' ELSE 'valid' END AS status
  FROM (SELECT symbol, event_time, concat_ws('|', CASE WHEN abs((funding_rate - 0.03) * 50) > 0.1 THEN 'extreme_funding_rate' END,
    CASE WHEN mark_price - 103 <= 0 THEN 'invalid_mark_price' END) AS flags FROM funding)""")
def _dq_funding(v: Views):
    f = v.funding.select("symbol", "event_time", ((F.col("funding_rate") - 0.03) * 50).alias("funding_rate"),
                         (F.col("mark_price") - 103).alias("mark_price"), F.lit("valid").alias("quality_status"),
                         F.array().cast("array<string>").alias("quality_flags"))
    return quality.assess_funding(f).select("symbol", "event_time", F.array_join("quality_flags", "|").alias("flags"),
                                            F.col("quality_status").alias("status"))


@query("dq_oi_rules", """
  SELECT symbol, period_end, flags, CASE WHEN flags <> '' THEN 'invalid' ELSE quality_status END AS status FROM (
    SELECT symbol, period_end, quality_status, concat_ws('|', CASE WHEN open_interest_contracts - 50000 < 0 THEN 'negative_open_interest' END,
      CASE WHEN open_interest_value - 99900 < 0 THEN 'negative_open_interest_value' END) AS flags FROM oi)""")
def _dq_oi(v: Views):
    o = v.oi.withColumns({"open_interest_contracts": F.col("open_interest_contracts") - 50000,
                          "open_interest_value": F.col("open_interest_value") - 99900,
                          "quality_flags": F.array().cast("array<string>")})
    return quality.assess_open_interest(o).select("symbol", "period_end", F.array_join("quality_flags", "|").alias("flags"),
                                                  F.col("quality_status").alias("status"))


@query("dq_taker_rules", """
  SELECT symbol, period_end, flags, CASE WHEN flags <> '' THEN 'invalid' ELSE quality_status END AS status FROM (
    SELECT symbol, period_end, quality_status, concat_ws('|', CASE WHEN buy_volume - 5 < 0 OR sell_volume - 5 < 0 THEN 'negative_taker_volume' END,
      CASE WHEN buy_sell_ratio - 0.5 <= 0 THEN 'invalid_buy_sell_ratio' END) AS flags FROM taker)""")
def _dq_taker(v: Views):
    t = v.taker.withColumns({"buy_volume": F.col("buy_volume") - 5, "sell_volume": F.col("sell_volume") - 5,
                             "buy_sell_ratio": F.col("buy_sell_ratio") - 0.5,
                             "quality_flags": F.array().cast("array<string>")})
    return quality.assess_taker(t).select("symbol", "period_end", F.array_join("quality_flags", "|").alias("flags"),
                                          F.col("quality_status").alias("status"))


RATIO_SQL = """
  SELECT '{kind}' AS kind, symbol, period_end, flags, CASE WHEN flags <> '' THEN 'invalid' ELSE quality_status END AS status FROM (
    SELECT symbol, period_end, quality_status, concat_ws('|', CASE WHEN long_{w} - 0.25 < 0 THEN 'negative_long_{w}' END,
      CASE WHEN short_{w} - 0.25 < 0 THEN 'negative_short_{w}' END, CASE WHEN long_short_ratio <= 0 THEN 'invalid_long_short_ratio' END) AS flags FROM {view})"""


@query("dq_ratio_rules", " UNION ALL ".join(RATIO_SQL.format(kind=k, view=k, w=w) for k, w in (
    ("global_ratio", "account"), ("top_ratio", "account"), ("top_position", "position"))))
def _dq_ratio(v: Views):
    out = None
    for kind, what in (("global_ratio", "account"), ("top_ratio", "account"), ("top_position", "position")):
        r = getattr(v, kind).withColumns({f"long_{what}": F.col(f"long_{what}") - 0.25,
                                          f"short_{what}": F.col(f"short_{what}") - 0.25,
                                          "quality_flags": F.array().cast("array<string>")})
        r = quality.assess_ratio(r, what).select(F.lit(kind).alias("kind"), "symbol", "period_end",
                                                 F.array_join("quality_flags", "|").alias("flags"),
                                                 F.col("quality_status").alias("status"))
        out = r if out is None else out.unionByName(r)
    return out


@query("dq_severity_merge", """
  WITH x AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'warning' WHEN 'P' THEN 'quarantined' ELSE 'valid' END AS s0,
      CASE WHEN o_totalprice > 250000 THEN 'invalid' WHEN o_totalprice < 50000 THEN 'quarantined' ELSE 'valid' END AS s1 FROM orders),
  r AS (SELECT o_orderkey, greatest(CASE s0 WHEN 'valid' THEN 0 WHEN 'quarantined' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END,
      CASE s1 WHEN 'valid' THEN 0 WHEN 'quarantined' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END) AS k FROM x)
  SELECT o_orderkey, CASE k WHEN 0 THEN 'valid' WHEN 1 THEN 'quarantined' WHEN 2 THEN 'warning' ELSE 'invalid' END AS status FROM r""")
def _severity(v: Views):
    o = v.table("orders").select(
        "o_orderkey", "o_totalprice", F.array().cast("array<string>").alias("quality_flags"),
        F.when(F.col("o_orderstatus") == "F", "warning").when(F.col("o_orderstatus") == "P", "quarantined")
        .otherwise("valid").alias("quality_status"))
    out = quality.apply_rules(o, [(F.col("o_totalprice") > 250000, "invalid", "large"),
                                  (F.col("o_totalprice") < 50000, "quarantined", "small")])
    return out.select("o_orderkey", F.col("quality_status").alias("status"))


@query("dq_timeline_score", """
  SELECT symbol, feature_time, data_quality_score, max_feature_age_minutes, quality_status, quality_reason_codes FROM timeline""",
       floats="data_quality_score max_feature_age_minutes")
def _dq_timeline(v: Views):
    return v.timeline.select("symbol", "feature_time", "data_quality_score", "max_feature_age_minutes", "quality_status",
                             "quality_reason_codes")


GATE = ("price_ret_24h", "funding_zscore_30d", "oi_change_24h")


@query("dq_snapshot_gate", """
  SELECT symbol, feature_time, score AS gate_score, age AS snapshot_age_minutes, reasons, reasons = '' AS usable FROM (
    SELECT symbol, feature_time, score, age, concat_ws('|',
      CASE WHEN price_ret_24h IS NULL OR funding_zscore_30d IS NULL OR oi_change_24h IS NULL THEN 'missing_required_features' END,
      CASE WHEN quality_status IN ('invalid','quarantined') THEN 'quality_status_' || quality_status END,
      CASE WHEN score < 0.8 THEN 'quality_score_below_threshold' END, CASE WHEN age < -1 THEN 'feature_time_in_future' END,
      CASE WHEN age > 20160 THEN 'feature_stale' END) AS reasons
    FROM (SELECT *, least(greatest(data_quality_score, 0.0), 1.0) AS score,
      (epoch_us((SELECT max(ts) FROM events)) - epoch_us(feature_time)) / 60e6 AS age FROM features))""",
       floats="gate_score snapshot_age_minutes")
def _gate(v: Views):
    out = quality.snapshot_gate(v.features, list(GATE), v.as_of, max_age_minutes=20160)
    return out.select("symbol", "feature_time", "gate_score", "snapshot_age_minutes",
                      F.array_join("gate_reasons", "|").alias("reasons"), "usable")


@query("prj_exclude_replace", """
  SELECT * EXCLUDE (trade_count, taker_buy_base, cell) REPLACE (upper(symbol) AS symbol) FROM bars_1h""",
       floats="open high low close volume_base volume_quote")
def _exclude(v: Views):
    return v.bars_1h.drop("trade_count", "taker_buy_base", "cell").withColumn("symbol", F.upper("symbol"))


def _features(name: str, group: str):
    names = list(FEATURES[group])
    @query(name, f"SELECT feature_time, symbol, {', '.join(names)} FROM features", floats=" ".join(names))
    def build(v: Views):
        return features.build_features(v.bare_timeline if group == "price" else v.timeline, (group,))
    return build


for _g in FEATURES:
    _features(f"feat_group_{_g}", _g)

SINGLE = {
    "feat_price_returns": "price_ret_5m price_ret_1h price_ret_4h price_ret_24h", "feat_volatility_24h": "price_volatility_24h",
    "feat_dist_high_24h": "distance_from_high_24h", "feat_volume_pct_24h": "volume_percentile_24h",
    "feat_momentum_decel_4h": "momentum_deceleration_4h", "feat_fake_breakout_1h": "fake_breakout_1h",
    "feat_funding_raw": "funding_rate_raw", "feat_funding_pct_7d": "funding_percentile_7d", "feat_funding_pct_30d": "funding_percentile_30d",
    "feat_funding_z_30d": "funding_zscore_30d", "feat_funding_change": "funding_change_8h funding_change_24h",
    "feat_funding_persist_7d": "funding_persistence_7d", "feat_oi_change": "oi_change_1h oi_change_4h oi_change_24h",
    "feat_oi_z_7d": "oi_zscore_7d", "feat_oi_accel_1h": "oi_acceleration_1h", "feat_price_oi_div_1h": "price_oi_divergence_1h",
    "feat_taker_ratio": "taker_buy_ratio", "feat_taker_trend": "taker_buy_ratio_trend_1h taker_buy_ratio_trend_4h",
    "feat_taker_change_1h": "taker_buy_ratio_change_1h", "feat_price_flow_div_1h": "price_flow_divergence_1h",
    "feat_ls_ratios": "global_ls_ratio top_ls_ratio retail_top_spread", "feat_spread_trend": "spread_trend_1h spread_trend_4h",
}


def _single(name: str, columns: str):
    names = columns.split()
    group = next(g for g, fs in FEATURES.items() if names[0] in fs)
    @query(name, f"SELECT feature_time, symbol, {', '.join(names)} FROM features", floats=columns)
    def build(v: Views):
        rows = v.bare_timeline if group == "price" else v.timeline
        return features.build_features(rows, (group,)).select("feature_time", "symbol", *names)


for _n, _c in SINGLE.items():
    _single(_n, _c)


@query("join_features_assemble", f"SELECT feature_time, symbol, {', '.join(features.FEATURE_NAMES)} FROM features",
       floats=" ".join(features.FEATURE_NAMES))
def _assemble(v: Views):
    return features.build_features(v.timeline)


@query("feat_registry_meta", "SELECT m.*, c.n_present FROM (VALUES " + ", ".join(
    f"('{f}', '{g}', {rows}, '{unit}')" for g, fs in FEATURES.items() for f, (rows, unit) in fs.items()) + """) m(feature_id, feature_group, lookback_rows, unit)
  JOIN (SELECT unnest(['""" + "','".join(features.FEATURE_NAMES) + """']) AS feature_id, unnest([""" + ", ".join(f"count({f})" for f in features.FEATURE_NAMES)
       + """]) AS n_present FROM features) c USING (feature_id)""")
def _registry(v: Views):
    """Metadata of every registered feature with its number of filled rows."""
    one = v.features.agg(*[F.count(f).alias(f) for f in features.FEATURE_NAMES])
    counts = one.selectExpr(f"stack({len(features.FEATURE_NAMES)}, {', '.join(f'{f!r}, {f}' for f in features.FEATURE_NAMES)}) AS (feature_id, n_present)")
    return features.feature_registry(v.spark).drop("version").join(counts, "feature_id")


@query("join_snapshot_price", """
  SELECT f.symbol, f.feature_time, f.total_ret, k.close AS price FROM (SELECT symbol, feature_time, price_ret_4h AS total_ret,
    row_number() OVER (PARTITION BY symbol ORDER BY feature_time DESC) AS rn FROM features) f
  LEFT JOIN bars_1h k ON k.symbol = f.symbol AND k.close_time = f.feature_time WHERE rn <= 12""", floats="total_ret price")
def _snapshot_price(v: Views):
    f = features.build_features(v.bare_timeline, ("price",)).select("symbol", "feature_time", F.col("price_ret_4h").alias("total_ret"))
    top = ordered.stacked_rank(f, ["symbol"], [F.col("feature_time").desc()], 12).drop("rank")
    k = v.bars_1h.select("symbol", F.col("close_time").alias("feature_time"), F.col("close").alias("price"))
    return top.join(k, ["symbol", "feature_time"], "left")


SCORED_SQL = """
  SELECT symbol, feature_time, close, data_quality_score, quality_status, c1, c2, c3, c4, c5, c6, c7, c8, btc_regime,
    greatest(0.0, least(100.0, c1 * 0.20::DOUBLE + c2 * 0.15::DOUBLE + c3 * 0.15::DOUBLE + c4 * 0.10::DOUBLE + c5 * 0.10::DOUBLE
      + c6 * 0.10::DOUBLE + c7 * 0.15::DOUBLE + c8 * 0.05::DOUBLE)) AS total_score FROM (
  SELECT *, CASE WHEN r24 <= 0 THEN 0.0 ELSE cl(90.0::DOUBLE * (1.0 - vp) * least(1.0, r24 / 0.5::DOUBLE)) END AS c1,
    CASE WHEN fz <= 0 THEN 0.0 ELSE cl(30.0::DOUBLE * fz) END AS c2,
    CASE WHEN r4 <= 0 THEN 0.0 WHEN md >= 0 THEN 10.0 ELSE cl(40.0 + 600.0::DOUBLE * abs(md)) END AS c3,
    CASE WHEN dh >= 0 THEN 100.0 ELSE cl(100.0 + 300.0::DOUBLE * dh) END AS c4,
    CASE WHEN tb >= 0.55 THEN 10.0 WHEN tc < 0 THEN cl(cl(50.0 + (0.55::DOUBLE - tb) * 400.0) + 10.0) ELSE cl(50.0 + (0.55::DOUBLE - tb) * 400.0) END AS c5,
    CASE WHEN r24 <= 0 THEN 0.0 WHEN oc >= 0 THEN 15.0 ELSE cl(50.0 + 250.0::DOUBLE * abs(oc)) END AS c6,
    CASE WHEN br >= 0.05 THEN greatest(0.0, 20.0 - (br - 0.05::DOUBLE) * 200.0) WHEN br <= -0.02 THEN least(100.0, 70.0 + (-0.02::DOUBLE - br) * 800.0)
      ELSE greatest(20.0, least(70.0, 50.0 - br * 6.0)) END AS c7,
    CASE WHEN br >= 0.05 THEN 'FOMO' WHEN br <= -0.02 THEN 'WEAK' ELSE 'NEUTRAL' END AS btc_regime,
    CASE WHEN fb <= 0 THEN 0.0 ELSE cl(100.0::DOUBLE * fb) END AS c8
  FROM (SELECT f.*, coalesce(price_ret_24h, 0.0) AS r24, coalesce(volume_percentile_24h, 0.5) AS vp, coalesce(funding_zscore_30d, 0.0) AS fz,
      coalesce(momentum_deceleration_4h, 0.0) AS md, coalesce(price_ret_4h, 0.0) AS r4, coalesce(distance_from_high_24h, 0.0) AS dh,
      coalesce(taker_buy_ratio, 0.5) AS tb, coalesce(taker_buy_ratio_change_1h, 0.0) AS tc, coalesce(oi_change_24h, 0.0) AS oc,
      coalesce(fake_breakout_1h, 0.0) AS fb,
      coalesce((SELECT arg_max(price_ret_24h, feature_time) FROM features WHERE symbol = 'view'), 0.0) AS br FROM features f))"""


def _expand(text: str) -> str:
    """Write the clamp shorthand ``cl(x)`` out as plain SQL."""
    while "cl(" in text:
        i = text.rindex("cl(")
        depth, j = 1, i + 3
        while depth:
            depth += {"(": 1, ")": -1}.get(text[j], 0)
            j += 1
        text = f"{text[:i]}greatest(0.0, least(100.0, {text[i + 3:j - 1]})){text[j:]}"
    return text


SCORED_VIEW = {"scored": _expand(SCORED_SQL)}


def scored(v: Views, rows=None):
    f = ordered.with_scalar(v.features if rows is None else rows, v.benchmark_return(), "benchmark_ret")
    ret = F.coalesce("benchmark_ret", F.lit(0.0))
    return scoring.composite(f, ret)


@query("flagship_latest_scored", """
  SELECT symbol, feature_time, close, data_quality_score, quality_status, total_score,
    CASE WHEN total_score >= 40 THEN 'SHORT_CANDIDATE' WHEN total_score >= 20 THEN 'WATCH' ELSE 'WAIT' END AS recommendation
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY feature_time DESC) AS rn FROM scored) WHERE rn = 1
  ORDER BY total_score DESC, symbol""", floats="close data_quality_score total_score", views=SCORED_VIEW)
def flagship(v: Views):
    """Latest closed bar per symbol with its features, quality and composite score, best first."""
    cols = ["symbol", "feature_time", "close", "data_quality_score", "quality_status", "total_score", "recommendation"]
    return scored(v, v.latest_features).select(*cols).orderBy(F.col("total_score").desc(), "symbol")

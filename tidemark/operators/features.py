"""The rolling features of a timeline, all in one partitioning.

Frames count rows.  The timeline gets a row position per symbol and is cut
into blocks with a halo as long as the longest frame, so every window runs
inside (symbol, block): one shuffle for all 32 features, no symbol in one task.
Frames of up to a day use stock windows; the 7- and 30-day frames use the
linear forms of ``sliding``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.functions.columns import with_exprs
from tidemark.operators.ordered import DAY, OWN, SLICE, row_blocks, with_position
from tidemark.operators.sliding import sliding_extremes, sliding_moments

HOUR, FOUR_HOURS, DAY_ROWS, WEEK, MONTH = 12, 48, 288, 2016, 8640
BLOCK_ROWS = 4 * MONTH

# Feature ids by group, with look-back in rows and unit.
FEATURES = {
    "price": {"price_ret_5m": (1, "ratio"), "price_ret_1h": (12, "ratio"), "price_ret_4h": (48, "ratio"),
              "price_ret_24h": (288, "ratio"), "price_volatility_24h": (288, "ratio"),
              "distance_from_high_24h": (288, "ratio"), "volume_percentile_24h": (288, "ratio"),
              "momentum_deceleration_4h": (48, "ratio"), "fake_breakout_1h": (12, "score")},
    "funding": {"funding_rate_raw": (1, "rate"), "funding_percentile_7d": (2016, "ratio"),
                "funding_percentile_30d": (8640, "ratio"), "funding_zscore_30d": (8640, "zscore"),
                "funding_change_8h": (96, "rate"), "funding_change_24h": (288, "rate"),
                "funding_persistence_7d": (2016, "rate")},
    "oi": {"oi_change_1h": (12, "ratio"), "oi_change_4h": (48, "ratio"), "oi_change_24h": (288, "ratio"),
           "oi_zscore_7d": (2016, "zscore"), "oi_acceleration_1h": (24, "ratio"),
           "price_oi_divergence_1h": (12, "product")},
    "taker": {"taker_buy_ratio": (1, "ratio"), "taker_buy_ratio_trend_1h": (12, "ratio"),
              "taker_buy_ratio_trend_4h": (48, "ratio"), "taker_buy_ratio_change_1h": (12, "ratio"),
              "price_flow_divergence_1h": (12, "product")},
    "ratios": {"global_ls_ratio": (1, "ratio"), "top_ls_ratio": (1, "ratio"), "retail_top_spread": (1, "ratio"),
               "spread_trend_1h": (12, "ratio"), "spread_trend_4h": (48, "ratio")},
}
FEATURE_NAMES = [f for group in FEATURES.values() for f in group]


def feature_blocks(timeline: DataFrame, halo: int = MONTH, block: int = BLOCK_ROWS,
                   span: int = 30 * DAY) -> DataFrame:
    """Position the rows of each symbol and spread them over halo blocks."""
    if "_pos" not in timeline.columns:
        timeline = with_position(timeline, ["symbol"], ["feature_time"], "feature_time", span)
    return row_blocks(timeline, "_pos", block, before=halo)


ORDER = f"PARTITION BY symbol, {SLICE} ORDER BY _pos"


def _over(rows: int | None = None, end: int = 0) -> str:
    """OVER clause of the last ``rows`` rows, ending ``end`` rows before this one."""
    if rows is None:
        return f"OVER ({ORDER})"
    last = "CURRENT ROW" if end == 0 else f"{end} PRECEDING"
    return f"OVER ({ORDER} ROWS BETWEEN {rows + end - 1} PRECEDING AND {last})"


def _change(x: str, rows: int) -> str:
    return f"try_divide({x}, lag({x}, {rows}) {_over()}) - 1"


def price_features(df: DataFrame) -> DataFrame:
    day = _over(DAY_ROWS)
    df = with_exprs(df, _hi="CAST(high AS DOUBLE)", _vol="CAST(volume_base AS DOUBLE)")
    df = with_exprs(
        df, price_ret_5m=_change("_px", 1), price_ret_1h=_change("_px", HOUR),
        price_ret_4h=_change("_px", FOUR_HOURS), price_ret_24h=_change("_px", DAY_ROWS),
        _ceiling=f"max(_hi) {_over(HOUR, 1)}",
        distance_from_high_24h=f"try_divide(_px, max(_hi) {day}) - 1",
        volume_percentile_24h=f"try_divide(_vol, max(_vol) {day})")
    return with_exprs(
        df, price_volatility_24h=f"stddev_samp(price_ret_5m) {day}",
        momentum_deceleration_4h=f"price_ret_1h - lag(price_ret_1h, 36) {_over()}",
        # A high above the previous hour's high that closes back below it, by depth of the return.
        fake_breakout_1h="CASE WHEN _hi > _ceiling AND _px < _ceiling "
                         "THEN least(1D, try_divide(_ceiling - _px, _ceiling) / 0.02D) ELSE 0D END")


def funding_features(df: DataFrame) -> DataFrame:
    return with_exprs(
        df, funding_rate_raw="coalesce(_fund, 0D)",
        funding_percentile_7d="try_divide(_fund - _f7_min, _f7_max - _f7_min)",
        funding_percentile_30d="try_divide(_fund - _f30_min, _f30_max - _f30_min)",
        funding_zscore_30d="CASE WHEN _f30_min < _f30_max THEN try_divide(_fund - _fm_8640_avg, _fm_8640_std) END",
        funding_change_8h=f"_fund - lag(_fund, 96) {_over()}",
        funding_change_24h=f"_fund - lag(_fund, {DAY_ROWS}) {_over()}",
        funding_persistence_7d="_fm_2016_avg")


def open_interest_features(df: DataFrame) -> DataFrame:
    df = with_exprs(df, _oi_1h=_change("_oi", HOUR))
    return with_exprs(
        df, oi_change_1h="coalesce(_oi_1h, 0D)", oi_change_4h=f"coalesce({_change('_oi', FOUR_HOURS)}, 0D)",
        oi_change_24h=f"coalesce({_change('_oi', DAY_ROWS)}, 0D)",
        oi_zscore_7d="CASE WHEN _o7_min < _o7_max THEN try_divide(_oi - _om_2016_avg, _om_2016_std) END",
        oi_acceleration_1h=f"_oi_1h - lag(_oi_1h, {HOUR}) {_over()}",
        price_oi_divergence_1h=f"({_change('_px', HOUR)}) * _oi_1h")


def taker_features(df: DataFrame) -> DataFrame:
    df = with_exprs(df, _buy="try_divide(CAST(buy_volume AS DOUBLE), CAST(buy_volume AS DOUBLE) + CAST(sell_volume AS DOUBLE))")
    trend = f"avg(_buy) {_over(HOUR)}"
    return with_exprs(
        df, taker_buy_ratio="coalesce(_buy, 0.5D)", taker_buy_ratio_trend_1h=trend,
        taker_buy_ratio_trend_4h=f"avg(_buy) {_over(FOUR_HOURS)}",
        taker_buy_ratio_change_1h=f"_buy - lag(_buy, {HOUR}) {_over()}",
        price_flow_divergence_1h=f"({_change('_px', HOUR)}) * ({trend} - 0.5D)")


def ratio_features(df: DataFrame) -> DataFrame:
    df = with_exprs(df, global_ls_ratio="coalesce(CAST(global_long_short_ratio AS DOUBLE), 1D)",
                    top_ls_ratio="coalesce(CAST(top_long_short_ratio AS DOUBLE), 1D)")
    df = with_exprs(df, retail_top_spread="global_ls_ratio - top_ls_ratio")
    return with_exprs(df, spread_trend_1h=f"avg(retail_top_spread) {_over(HOUR)}",
                      spread_trend_4h=f"avg(retail_top_spread) {_over(FOUR_HOURS)}")


def long_frames(df: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """The 7- and 30-day frames of all groups together, so equal frames share their sorts."""
    raw = {"_px": "close"}
    if "funding" in groups:
        raw["_fund"] = "funding_rate_last_known"
    if "oi" in groups:
        raw["_oi"] = "open_interest_value"
    df = with_exprs(df, **{n: f"CAST({c} AS DOUBLE)" for n, c in raw.items()})
    week = {**({"_f7": "_fund"} if "funding" in groups else {}), **({"_o7": "_oi"} if "oi" in groups else {})}
    if week:
        df = sliding_extremes(df, ["symbol"], "_pos", week, WEEK)
    if "funding" in groups:
        df = sliding_extremes(df, ["symbol"], "_pos", {"_f30": "_fund"}, MONTH)
        df = sliding_moments(df, ["symbol"], "_pos", "_fund", [WEEK, MONTH], "_fm")
    if "oi" in groups:
        df = sliding_moments(df, ["symbol"], "_pos", "_oi", [WEEK], "_om")
    return df


BUILDERS = {"price": price_features, "funding": funding_features, "oi": open_interest_features,
            "taker": taker_features, "ratios": ratio_features}


def build_features(timeline: DataFrame, groups: tuple[str, ...] = tuple(BUILDERS), *,
                   keep: tuple[str, ...] = (), block: int = BLOCK_ROWS, tasks: int | None = None) -> DataFrame:
    """Feature rows of the timeline for the wanted groups.

    ``tasks`` spreads the blocks over a number of tasks that goes with the rows, so that a task's memory doesn't.

    The halo is only as long as the longest look-back asked for, so short
    features do not pay for a month of copied rows.
    """
    longest = max(rows for g in groups for rows, _ in FEATURES[g].values())
    halo = max(longest, DAY_ROWS) + HOUR
    df = feature_blocks(timeline, halo, max(block, halo))
    if tasks:
        df = df.repartition(tasks, "symbol", SLICE)
    df = long_frames(df, groups)
    for g in groups:
        df = BUILDERS[g](df)
    names = [f for g in groups for f in FEATURES[g]]
    return df.where(OWN).select("feature_time", "symbol", *keep, *names)


def feature_registry(spark) -> DataFrame:
    """Metadata of the features, for reports and set checks."""
    rows = [(f, g, rows, unit, "1.0.0") for g, fs in FEATURES.items() for f, (rows, unit) in fs.items()]
    return spark.createDataFrame(rows, "feature_id string, feature_group string, lookback_rows int, "
                                       "unit string, version string")


def check_feature_set(names: list[str]) -> list[str]:
    """Names that are not registered."""
    return sorted(set(names) - set(FEATURE_NAMES))

"""Technical indicators and market regimes as windows over row blocks."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import with_exprs
from tidemark.operators.ordered import OWN, SLICE, row_blocks, with_position
from tidemark.operators.quantiles import exact_percentiles

BLOCK = 4096
ORDER = f"PARTITION BY symbol, {SLICE} ORDER BY _pos"
# Weights smaller than this (e^-40) cannot change a double any more.
NEGLIGIBLE = 40.0
# Weights up to e^600 leave room for sums in a double.
LARGEST = 600.0


def indicator_blocks(bars: DataFrame, before: int, t: str = "feature_time", block: int = BLOCK) -> DataFrame:
    """Row blocks with a halo of ``before`` rows; price columns as doubles."""
    if "_pos" not in bars.columns:
        bars = with_position(bars, ["symbol"], [t], t)
    bars = with_exprs(bars, **{c: f"CAST({c} AS DOUBLE)" for c in ("high", "low", "close") if c in bars.columns})
    return row_blocks(bars, "_pos", block, before=before)


def ewm_block(alpha: float, before: int, power: int = 2) -> int:
    """Rows per block so that the weights of a block and its halo, raised to ``power``, stay below e^600.

    Where the halo alone goes beyond, blocks are short and the halo is what the weights allow.
    """
    return max(16, min(BLOCK, int(LARGEST / (power * -math.log1p(-alpha))) - before))


def _last(rows: int) -> str:
    return f"OVER ({ORDER} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"


def ewm_halo(alpha: float) -> int:
    """Rows after which an exponential weight has vanished."""
    return math.ceil(NEGLIGIBLE / -math.log1p(-alpha))


def _weighted(df: DataFrame, value: str, alpha: float, prefix: str) -> DataFrame:
    """Weighted sums over all earlier rows of the block: ``w``, ``w2``, ``wx`` and ``wxx``.

    Weights are taken relative to the first row of the block, which turns the
    recursion into plain running sums.
    """
    run = f"OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    grow = -math.log1p(-alpha)
    df = with_exprs(df, _k=f"_pos - min(_pos) {run}")
    df = with_exprs(df, _g=f"CASE WHEN {value} IS NOT NULL THEN exp({grow}D * _k) END")
    return with_exprs(df, **{
        f"{prefix}_w": f"sum(_g) {run} * exp(-{grow}D * _k)",
        f"{prefix}_w2": f"sum(_g * _g) {run} * exp(-{2 * grow}D * _k)",
        f"{prefix}_wx": f"sum(_g * {value}) {run} * exp(-{grow}D * _k)",
        f"{prefix}_wxx": f"sum(_g * {value} * {value}) {run} * exp(-{grow}D * _k)",
    }).drop("_k", "_g")


def true_range(df: DataFrame) -> DataFrame:
    prev = f"lag(close) OVER ({ORDER})"
    return with_exprs(df, true_range=f"greatest(high - low, abs(high - {prev}), abs(low - {prev}))")


def relative_atr(bars: DataFrame, period: int = 14) -> DataFrame:
    """Bars with ``volatility``: mean true range over close, at least 1e-4."""
    df = true_range(indicator_blocks(bars, period + 1))
    df = with_exprs(df, volatility=f"greatest(avg(true_range) {_last(period)} / close, 1e-4D)")
    return df.where(OWN).drop(SLICE, OWN, "_pos")


def ewm_volatility(bars: DataFrame, span: int = 100, min_periods: int = 10, fallback: float = 0.01) -> DataFrame:
    """Exponentially weighted deviation of returns; young rows get the symbol's median."""
    alpha = 2.0 / (span + 1)
    halo = ewm_halo(alpha) + 1
    df = with_exprs(indicator_blocks(bars, halo, block=ewm_block(alpha, halo)), ret=f"close / lag(close) OVER ({ORDER}) - 1")
    df = _weighted(df, "ret", alpha, "e").where(OWN)
    df = with_exprs(df, ewm_vol=f"CASE WHEN _pos >= {min_periods} THEN sqrt(greatest(e_wxx / e_w - pow(e_wx / e_w, 2), 0D)"
                                " * e_w * e_w / (e_w * e_w - e_w2)) END")
    df = df.select("symbol", "feature_time", "close", "ewm_vol")
    middle = exact_percentiles(df, ["symbol"], F.col("ewm_vol"), {"_mid": 0.5}).select("symbol", "_mid")
    return (df.join(middle, "symbol", "left")
            .withColumn("ewm_vol", F.coalesce("ewm_vol", "_mid", F.lit(fallback))).drop("_mid"))


def trend_slope(df: DataFrame, fast: int = 50, slow: int = 200) -> DataFrame:
    """Relative distance of two exponential means of the close."""
    df = _weighted(df, "close", 2.0 / (fast + 1), "f")
    df = _weighted(df, "close", 2.0 / (slow + 1), "s")
    df = with_exprs(df, _fast="f_wx / f_w", _slow="s_wx / s_w")
    return with_exprs(df, trend_slope="(_fast - _slow) / (_slow + 1e-8D)").drop(
        *[f"{p}_{x}" for p in "fs" for x in ("w", "w2", "wx", "wxx")], "_fast", "_slow")


def directional_index(df: DataFrame, period: int = 14) -> DataFrame:
    df = with_exprs(true_range(df), _up=f"high - lag(high) OVER ({ORDER})", _down=f"lag(low) OVER ({ORDER}) - low")
    w = _last(period)
    df = with_exprs(df, _pdm="CASE WHEN _up > _down AND _up > 0 THEN _up ELSE 0D END",
                    _mdm="CASE WHEN _down > _up AND _down > 0 THEN _down ELSE 0D END")
    df = with_exprs(df, plus_di=f"100D * (avg(_pdm) {w} / (avg(true_range) {w} + 1e-8D))",
                    minus_di=f"100D * (avg(_mdm) {w} / (avg(true_range) {w} + 1e-8D))")
    df = with_exprs(df, _dx="100D * (abs(plus_di - minus_di) / (plus_di + minus_di + 1e-8D))")
    return with_exprs(df, adx=f"avg(_dx) {w}").drop("_up", "_down", "_pdm", "_mdm", "_dx")


def bollinger_width(df: DataFrame, period: int = 20, deviations: float = 2.0) -> DataFrame:
    w = _last(period)
    return with_exprs(df, bb_width=f"2D * {deviations}D * coalesce(stddev_samp(close) {w}, 0D) / (avg(close) {w} + 1e-8D)")


def market_regimes(bars: DataFrame, adx_trend: float = 25.0, width_quantile: float = 0.75, window: int = 100,
                   min_rows: int = 20) -> DataFrame:
    """Regime of every bar with its permissions and risk factor."""
    halo = ewm_halo(2.0 / 201) + 64
    df = indicator_blocks(bars, halo, block=ewm_block(2.0 / 51, halo))
    df = bollinger_width(trend_slope(directional_index(df)))
    df = with_exprs(df, bb_threshold=f"CASE WHEN _pos >= {min_rows - 1} THEN percentile(bb_width, {width_quantile}D) {_last(window)} END",
                    atr_pct=f"greatest(avg(true_range) {_last(14)} / close, 1e-4D)")
    df = df.where(OWN).drop(SLICE, OWN, "_pos")
    middle = exact_percentiles(df, ["symbol"], F.col("bb_width"), {"_mid": 0.5}).select("symbol", "_mid")
    df = df.join(middle, "symbol", "left")
    df = with_exprs(df, bb_threshold="coalesce(bb_threshold, _mid)")
    regime = (f"CASE WHEN adx >= {adx_trend}D THEN CASE WHEN trend_slope > 0 AND plus_di > minus_di THEN 'TRENDING_BULL' "
              "ELSE 'TRENDING_BEAR' END WHEN bb_width >= bb_threshold THEN 'HIGH_VOLATILITY_CHOP' "
              "ELSE 'SIDEWAY_DISTRIBUTION' END")
    df = with_exprs(df, regime=regime)
    return with_exprs(df, allow_short="regime <> 'TRENDING_BULL'", allow_long="regime <> 'TRENDING_BEAR'",
                      risk_multiplier="CASE WHEN regime = 'HIGH_VOLATILITY_CHOP' THEN 0.5D ELSE 1D END").drop("_mid")


def rsi_simple(bars: DataFrame, period: int = 14) -> DataFrame:
    """RSI from the plain mean of the last ``period`` gains and losses."""
    df = with_exprs(indicator_blocks(bars, period + 1), _d=f"close - lag(close) OVER ({ORDER})")
    df = with_exprs(df, _gain=f"avg(greatest(_d, 0D)) {_last(period)}", _loss=f"avg(greatest(-_d, 0D)) {_last(period)}")
    return with_exprs(df.where(OWN), rsi=f"CASE WHEN _pos >= {period} THEN CASE WHEN _loss = 0 THEN 100D "
                                         "ELSE 100D - 100D / (1D + _gain / _loss) END END").select(
        "symbol", "feature_time", "rsi")


def rsi_smoothed(bars: DataFrame, period: int = 14) -> DataFrame:
    """RSI with recursive smoothing started from the mean of the first ``period`` moves.

    The recursion forgets exponentially: later blocks start inside their halo,
    the first block starts from the true initial mean.
    """
    alpha = 1.0 / period
    grow = -math.log1p(-alpha)
    halo = ewm_halo(alpha) + 1
    df = with_exprs(indicator_blocks(bars, halo, block=ewm_block(alpha, halo, 1)), _d=f"close - lag(close) OVER ({ORDER})")
    run = f"OVER ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    df = with_exprs(df, _k=f"_pos - min(_pos) {run}", _first=f"min(_pos) {run} = 0")
    for side, move in (("gain", "greatest(_d, 0D)"), ("loss", "greatest(-_d, 0D)")):
        step = f"CASE WHEN _first AND _pos <= {period} THEN 0D ELSE {alpha}D * {move} END"
        seed = f"CASE WHEN _first THEN coalesce(sum(CASE WHEN _pos BETWEEN 1 AND {period} THEN {move} END) {run}, 0D) / {period} ELSE 0D END"
        df = with_exprs(df, **{f"_{side}": f"sum(coalesce({step}, 0D) * exp({grow}D * _k)) {run} * exp(-{grow}D * _k)"
                                           f" + ({seed}) * exp(-{grow}D * (_pos - {period}))"})
    return with_exprs(df.where(OWN), rsi=f"CASE WHEN _pos >= {period} THEN CASE WHEN _loss = 0 THEN 100D "
                                         "ELSE 100D - 100D / (1D + _gain / _loss) END END").select(
        "symbol", "feature_time", "rsi")

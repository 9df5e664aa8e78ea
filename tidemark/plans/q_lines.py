"""Long frames over a feed that grows with the tables: order lines per return flag, one row every five minutes.

Each of the three keys has a third of all lines, so frames of 2,016 and 8,640 rows are full, keys span
several blocks, and slices hold many rows. Prices and rates carry a small odd factor, so that no figure lies half-way
between two rounded ones.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features, indicators, metrics, ordered
from tidemark.plans.oracle import VIEWS
from tidemark.plans.q_labels import ATR
from tidemark.plans.registry import query
from tidemark.plans.views import Views

ORDER = ("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LINE_ROWS = """
  SELECT symbol, make_timestamp(1700000000000000 + (row_number() OVER (PARTITION BY symbol ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) * 300000000) AS feature_time,
    px AS close, px * (1.0 + l_tax) AS high, px * (1.0 - l_discount) AS low, l_quantity AS volume_base, CASE WHEN l_linenumber % 5 <> 0 THEN l_discount - 0.05 + l_extendedprice * 1.234567e-7::DOUBLE END AS funding_rate_last_known,
    l_extendedprice AS open_interest_value, l_quantity AS buy_volume, 50.0 - l_quantity AS sell_volume, 1.0 + l_tax AS global_long_short_ratio, 1.0 + l_discount AS top_long_short_ratio,
    1.0::DOUBLE AS data_quality_score, 'valid' AS quality_status FROM (SELECT *, l_returnflag AS symbol, l_extendedprice / l_quantity * 1.0000001234567::DOUBLE AS px FROM lineitem)"""
LINES = {"line_rows": LINE_ROWS, "line_features": VIEWS["features"].replace("FROM timeline", "FROM line_rows"),
         "line_tr": ATR["tr"].replace("FROM path_bars", "FROM line_rows"), "line_atr": ATR["atr"].replace("FROM tr", "FROM line_tr")}


def line_feed(v: Views, last: int | None = None):
    """Positioned lines, or about the newest ``last`` per key; numbered in slices of a day, as a month of a key is a hundredth of all lines."""
    li = v.table("lineitem").selectExpr("l_returnflag AS symbol", "l_shipdate AS ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice / l_quantity * 1.0000001234567D AS close",
                                        "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = ordered.with_position(li, ["symbol"], ORDER, "ts", span=ordered.DAY, last=last)
    return rows.selectExpr(
        "symbol", "timestamp_micros(1700000000000000L + _pos * 300000000L) AS feature_time", "_pos", "close", "close * (1D + l_tax) AS high", "close * (1D - l_discount) AS low",
        "l_quantity AS volume_base", "CASE WHEN l_linenumber % 5 <> 0 THEN l_discount - 0.05D + l_extendedprice * 1.234567e-7D END AS funding_rate_last_known", "l_extendedprice AS open_interest_value",
        "l_quantity AS buy_volume", "50D - l_quantity AS sell_volume", "1D + l_tax AS global_long_short_ratio", "1D + l_discount AS top_long_short_ratio")


def block_tasks(v: Views) -> int:
    """Two blocks a task; the rows are counted in the files' footers."""
    return max(int(v.spark.conf.get("spark.sql.shuffle.partitions")), v.table("lineitem").count() // (2 * features.BLOCK_ROWS) + 1)


LONG = ("funding_percentile_7d", "funding_percentile_30d", "funding_zscore_30d", "funding_persistence_7d", "oi_zscore_7d")


@query("feat_line_long", f"SELECT symbol, feature_time, {', '.join(LONG)} FROM line_features", views=LINES, floats=" ".join(LONG))
def _long(v: Views):
    return features.build_features(line_feed(v), ("funding", "oi"), tasks=block_tasks(v)).select("symbol", "feature_time", *LONG)


DAILY = ("price_ret_1h", "price_ret_24h", "price_volatility_24h", "distance_from_high_24h", "volume_percentile_24h", "fake_breakout_1h")


@query("feat_line_daily", f"SELECT symbol, feature_time, {', '.join(DAILY)} FROM line_features", views=LINES, floats=" ".join(DAILY))
def _daily(v: Views):
    return features.build_features(line_feed(v), ("price",), tasks=block_tasks(v)).select("symbol", "feature_time", *DAILY)


@query("feat_line_latest", f"SELECT symbol, max(feature_time) AS feature_time, {', '.join(f'arg_max({c}, feature_time) AS {c}' for c in LONG)} FROM line_features GROUP BY symbol", views=LINES, floats=" ".join(LONG))
def _latest(v: Views):
    """The newest feature row per key from the newest rows alone: those that its longest frame can reach, chosen by counts per day before any row is sorted."""
    feed = line_feed(v, last=features.MONTH + features.DAY_ROWS)
    f = features.build_features(feed, ("funding", "oi")).select("symbol", "feature_time", *LONG)
    return ordered.latest_per_key(f, ["symbol"], ["feature_time"])


@query("ind_line_atr", "SELECT symbol, feature_time, true_range, volatility FROM line_atr", views=LINES, floats="true_range volatility")
def _atr(v: Views):
    return indicators.relative_atr(line_feed(v)).select("symbol", "feature_time", "true_range", "volatility")


@query("met_line_row", """
  SELECT l_returnflag AS model_id, count(*) AS n_rows, count(*) FILTER (l_tax > 0.04) AS n_positive, count(*) FILTER (l_discount * 10 >= 0.55) AS n_predicted_positive,
    count(*) FILTER (l_discount * 10 >= 0.55 AND l_tax > 0.04) AS tp, avg((l_discount * 10 - (l_tax > 0.04)::INT) ** 2) AS brier_score FROM lineitem GROUP BY 1""", floats="brier_score")
def _row(v: Views):
    """Row metrics over all order lines; the scores are packed into few values."""
    li = v.table("lineitem").selectExpr("l_returnflag AS model_id", "l_discount * 10D AS probability", "CAST(l_tax > 0.04D AS INT) AS label_value")
    return metrics.row_metrics(li, ["model_id"], threshold=0.55).select("model_id", "n_rows", "n_positive", "n_predicted_positive", "tp", "brier_score")

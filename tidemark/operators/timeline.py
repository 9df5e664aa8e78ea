"""Point-in-time alignment of bars with their side series."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import grid, sql_grid
from tidemark.operators.ordered import asof_backward, latest_per_key, with_position

# Which columns each side series gives to the timeline.
SIDE_COLUMNS = {
    "open_interest": {"open_interest_contracts": "open_interest_contracts",
                      "open_interest_value": "open_interest_value"},
    "taker_volume": {"buy_volume": "buy_volume", "sell_volume": "sell_volume",
                     "buy_sell_ratio": "buy_sell_ratio"},
    "global_ratio": {"long_account": "global_long_account", "short_account": "global_short_account",
                     "long_short_ratio": "global_long_short_ratio"},
    "top_ratio": {"long_account": "top_long_account", "short_account": "top_short_account",
                  "long_short_ratio": "top_long_short_ratio"},
    "top_position": {"long_short_ratio": "top_long_short_position_ratio"},
}


def closed_bars(bars: DataFrame, as_of: Column) -> DataFrame:
    """Bars that had ended at ``as_of``."""
    return bars.where(F.col("close_time") <= as_of)


def last_closed_end(as_of: Column, seconds: int = 300) -> Column:
    """End of the last complete grid cell: its boundary minus one millisecond."""
    return F.timestamp_micros(grid(as_of, seconds) * F.lit(seconds * 1_000_000) - F.lit(1000))


def newest_version(df: DataFrame, time_col: str) -> DataFrame:
    """Keep the newest available version per (symbol, time)."""
    return latest_per_key(df, ["symbol", time_col], ["available_time", "collected_at"]
                          if "collected_at" in df.columns else ["available_time"])


def align(bars: DataFrame, sides: dict[str, DataFrame], as_of: Column, *,
          max_lag_seconds: int = 5, cell_seconds: int = 300, position: bool = False,
          last: int | None = None) -> DataFrame:
    """Bars with the side records of the same grid cell that were known in time.

    All joins share the key (symbol, cell): bars are shuffled once, and a busy
    symbol is spread over its cells.  A missing side gives typed NULL columns.
    ``position`` adds the row number per symbol (``_pos``) while the rows are
    still narrow; the left joins keep it valid because a side has one row per
    cell.  ``last`` drops all but about the newest rows of each symbol before
    the joins, for work that only needs the latest features.
    """
    limit, usable = f"close_time + INTERVAL {max_lag_seconds} SECONDS", "quality_status IN ('valid', 'warning')"
    out = (closed_bars(bars, as_of).where(f"available_time <= {limit} AND {usable}")
           .selectExpr("symbol", f"{sql_grid('close_time', cell_seconds)} AS _cell", "close_time AS feature_time",
                       f"{limit} AS decision_time", "available_time AS feature_available_time", "open", "high", "low",
                       "close", "volume_base", "volume_quote", "trade_count", "quality_status"))
    if position:
        out = with_position(out, ["symbol"], ["feature_time"], "feature_time", last=last)
    for name, columns in SIDE_COLUMNS.items():
        side = sides.get(name)
        if side is None:
            out = out.selectExpr("*", *[f"CAST(NULL AS DECIMAL(20,8)) AS {c}" for c in columns.values()])
            continue
        right = side.where(usable).selectExpr(
            "symbol", f"{sql_grid('period_end', cell_seconds)} AS _cell", "available_time AS _known",
            *[f"{src} AS {dst}" for src, dst in columns.items()])
        on = F.expr("a.symbol = b.symbol AND a._cell = b._cell AND b._known <= a.decision_time")
        out = (out.alias("a").join(right.alias("b"), on, "left")
               .selectExpr("a.*", *[f"b.{c}" for c in columns.values()]))
    return out.drop("_cell")


def add_funding(timeline: DataFrame, funding: DataFrame, *, max_age_hours: int = 12) -> DataFrame:
    """Last funding record known at decision time, dropped when too old."""
    # A record is known no earlier than its event, so one known longer ago than
    # the age limit (plus the decision lag) could only give NULL.
    known = F.greatest("available_time", "event_time")
    source = funding.withColumn("available_time", known).withColumnRenamed("event_time", "funding_event_time")
    joined = asof_backward(timeline, source, ["symbol"], "decision_time", "available_time",
                           ["funding_rate", "funding_event_time"], max_age=max_age_hours * 3600 + 600)
    age = f"({sql_grid('feature_time', 60)} - {sql_grid('funding_event_time', 60)})"
    fresh = f"CASE WHEN {age} <= {max_age_hours * 60} THEN"
    return joined.selectExpr("* EXCEPT (funding_rate, funding_event_time)",
                             f"{fresh} funding_rate END AS funding_rate_last_known",
                             f"{fresh} {age} END AS funding_age_minutes",
                             f"{fresh} funding_event_time END AS funding_event_time")

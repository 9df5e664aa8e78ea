"""Market-shaped views of the given tables.

``events`` plays the trade feed: event type = symbol, value = quantity, an odd
user is a buyer.  All other series derive from it by Spark aggregation, so the
work of every query grows with the tables.
"""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import sql_grid
from tidemark.operators import features, labels, quality, timeline
from tidemark.operators.ordered import DAY, OWN, SLICE, latest_per_key, row_blocks, running_sum, with_position
from tidemark.session import configure

HOUR = 3600
GAP_MINUTES = 180
EVENT_GAP = 180
LINES_A_TASK, SHARES = 1_250_000, 16
BENCHMARK = "view"  # the symbol whose return sets the market context


class Views:
    """Lazy DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = configure(spark), folder

    def table(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        zone_free = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in zone_free})

    @cached_property
    def now(self) -> str:
        """The time of the newest event, as a SQL literal: one row from the footers of the files."""
        newest = self.table("events").agg(F.max("ts").cast("string")).first()[0] or "1970-01-01 00:00:00"
        return f"TIMESTAMP '{newest}'"

    @property
    def as_of(self):
        return F.expr(self.now)

    @cached_property
    def ticks(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_type AS symbol", "ts", "100D + 0.1D * value AS px", "CAST(value AS DECIMAL(20,8)) AS qty",
            "user_id % 2 = 1 AS is_buy", "user_id", "event_id AS seq")

    def bars(self, seconds: int) -> DataFrame:
        width = f"{seconds * 1_000_000}L"
        agg = ("min_by(px, struct(ts, seq)) AS open", "max(px) AS high", "min(px) AS low",
               "max_by(px, struct(ts, seq)) AS close", "sum(qty) AS vb",
               "sum(CAST(qty * CAST(px AS DECIMAL(20,8)) AS DECIMAL(28,8))) AS vq", "count(1) AS trade_count",
               "coalesce(sum(qty) FILTER (WHERE is_buy), 0) AS tb")
        cells = self.ticks.selectExpr("*", f"{sql_grid('ts', seconds)} AS cell")
        return cells.groupBy("symbol", "cell").agg(*[F.expr(a) for a in agg]).selectExpr(
            "symbol", "cell", f"timestamp_micros(cell * {width}) AS open_time",
            f"timestamp_micros((cell + 1) * {width} - 1000) AS close_time",
            f"timestamp_micros((cell + 1) * {width}) AS available_time", "open", "high", "low", "close",
            "CAST(vb AS DOUBLE) AS volume_base", "CAST(vq AS DOUBLE) AS volume_quote", "trade_count",
            "CAST(tb AS DOUBLE) AS taker_buy_base",
            "CASE WHEN cell % 40 = 7 THEN 'invalid' WHEN cell % 15 = 4 THEN 'warning' ELSE 'valid' END AS quality_status")

    @cached_property
    def bars_1h(self) -> DataFrame:
        return self.bars(HOUR)

    @cached_property
    def bars_5m(self) -> DataFrame:
        return self.bars(300)

    @cached_property
    def path_bars(self) -> DataFrame:
        return self.bars_1h.select("symbol", F.col("close_time").alias("feature_time"), "open", "high", "low",
                                   "close", "volume_base", "quality_status")

    # Clocks of an hourly side series; every 20th cell arrives too late.
    PERIOD = ("symbol", "timestamp_micros(cell * 3600000000L) AS period_end",
              "timestamp_micros(cell * 3600000000L + CASE WHEN cell % 20 = 3 THEN 4200000000L ELSE 1000000L END) AS available_time",
              "CASE WHEN cell % 50 = 11 THEN 'quarantined' ELSE 'valid' END AS quality_status")

    @cached_property
    def _hourly(self) -> DataFrame:
        agg = ("coalesce(sum(qty) FILTER (WHERE is_buy), 0) AS buy", "coalesce(sum(qty) FILTER (WHERE NOT is_buy), 0) AS sell",
               "count(1) FILTER (WHERE is_buy) AS n_buy", "count(1) FILTER (WHERE NOT is_buy) AS n_sell")
        return (self.ticks.selectExpr("*", f"{sql_grid('ts', HOUR)} AS cell").groupBy("symbol", "cell")
                .agg(*[F.expr(a) for a in agg]))

    @cached_property
    def oi(self) -> DataFrame:
        h = self._hourly.selectExpr("symbol", "cell", "buy - sell AS flow", "timestamp_micros(cell * 3600000000L) AS t")
        run = running_sum(h, ["symbol"], "t", ["cell"], {"net": F.col("flow")}, span=7 * DAY)
        c = "50000D + CAST(net AS DOUBLE)"
        return run.selectExpr(*self.PERIOD, f"{c} AS open_interest_contracts", f"({c}) * 2 AS open_interest_value")

    @cached_property
    def taker(self) -> DataFrame:
        return self._hourly.selectExpr(
            *self.PERIOD, "CAST(buy AS DOUBLE) AS buy_volume", "CAST(sell AS DOUBLE) AS sell_volume",
            "try_divide(CAST(buy AS DOUBLE), CAST(sell AS DOUBLE)) AS buy_sell_ratio")

    @cached_property
    def global_ratio(self) -> DataFrame:
        """Distinct buyers against distinct sellers, deduplicated before counting."""
        users = self.ticks.selectExpr("symbol", f"{sql_grid('ts', HOUR)} AS cell", "user_id", "is_buy").distinct()
        n = users.groupBy("symbol", "cell").agg(F.expr("count_if(is_buy) AS nb"), F.expr("count_if(NOT is_buy) AS ns"))
        return n.selectExpr(*self.PERIOD, "nb / (nb + ns) AS long_account", "ns / (nb + ns) AS short_account",
                            "try_divide(CAST(nb AS DOUBLE), CAST(ns AS DOUBLE)) AS long_short_ratio")

    @cached_property
    def top_ratio(self) -> DataFrame:
        return self._hourly.selectExpr(
            *self.PERIOD, "n_buy / (n_buy + n_sell) AS long_account", "n_sell / (n_buy + n_sell) AS short_account",
            "try_divide(CAST(n_buy AS DOUBLE), CAST(n_sell AS DOUBLE)) AS long_short_ratio")

    @cached_property
    def top_position(self) -> DataFrame:
        total = "CAST(buy + sell AS DOUBLE)"
        return self._hourly.selectExpr(
            *self.PERIOD, f"CAST(buy AS DOUBLE) / {total} AS long_position", f"CAST(sell AS DOUBLE) / {total} AS short_position",
            "try_divide(CAST(buy AS DOUBLE), CAST(sell AS DOUBLE)) AS long_short_ratio")

    @cached_property
    def funding(self) -> DataFrame:
        """Eight-hour rate, stamped at the end of its period; some periods are missing."""
        f = (self.ticks.selectExpr("symbol", f"{sql_grid('ts', 8 * HOUR)} AS cell", "CAST(px AS DECIMAL(20,8)) AS px")
             .groupBy("symbol", "cell").agg(F.expr("sum(px) AS s"), F.expr("count(1) AS n")))
        return f.where("cell % 5 NOT IN (0, 1)").selectExpr(
            "symbol", "timestamp_micros((cell + 1) * 28800000000L) AS event_time",
            "timestamp_micros((cell + 1) * 28800000000L + 1000000L) AS available_time",
            "CAST(s AS DOUBLE) / n / 100D - 1D AS funding_rate", "CAST(s AS DOUBLE) / n AS mark_price")

    @property
    def sides(self) -> dict[str, DataFrame]:
        return {"open_interest": self.oi, "taker_volume": self.taker, "global_ratio": self.global_ratio,
                "top_ratio": self.top_ratio, "top_position": self.top_position}

    @cached_property
    def aligned(self) -> DataFrame:
        return timeline.align(self.bars_1h, self.sides, self.as_of, cell_seconds=HOUR)

    @cached_property
    def timeline(self) -> DataFrame:
        """Aligned, funded and scored rows with their position per symbol."""
        rows = timeline.align(self.bars_1h, self.sides, self.as_of, cell_seconds=HOUR, position=True)
        return quality.timeline_quality(timeline.add_funding(rows, self.funding))

    @cached_property
    def latest_features(self) -> DataFrame:
        """Newest feature row per symbol, from no more rows than its longest frame needs."""
        rows = timeline.align(self.bars_1h, self.sides, self.as_of, cell_seconds=HOUR, position=True, last=features.MONTH + features.DAY_ROWS)
        rows = quality.timeline_quality(timeline.add_funding(rows, self.funding))
        return latest_per_key(features.build_features(rows, keep=("close", "data_quality_score", "quality_status")), ["symbol"], ["feature_time"])

    @cached_property
    def bare_timeline(self) -> DataFrame:
        """The same rows from bars alone, for what needs no side series."""
        return timeline.align(self.bars_1h, {}, self.as_of, cell_seconds=HOUR, position=True)

    def benchmark_return(self) -> DataFrame:
        """24-hour return of the newest benchmark bar (always one row)."""
        rows = timeline.align(self.bars_1h.where(F.col("symbol") == BENCHMARK), {}, self.as_of, cell_seconds=HOUR,
                              position=True, last=2 * features.DAY_ROWS)
        return features.build_features(rows, ("price",)).agg(
            F.max_by("price_ret_24h", "feature_time").alias("benchmark_ret"))

    @cached_property
    def features(self) -> DataFrame:
        return features.build_features(self.timeline, keep=("close", "data_quality_score", "quality_status"))

    @cached_property
    def labels(self) -> DataFrame:
        """24-hour labels of the hourly bars."""
        return labels.label_paths(self.path_bars, (24,), gap_minutes=GAP_MINUTES)

    @cached_property
    def label_events(self) -> DataFrame:
        return labels.group_events(self.labels, gap_minutes=EVENT_GAP)

    @cached_property
    def rule_probs(self) -> DataFrame:
        """A probability per bar from a logistic curve on two short returns."""
        w = f"OVER (PARTITION BY symbol, {SLICE} ORDER BY _pos"
        b = row_blocks(with_position(self.path_bars, ["symbol"], ["feature_time"], "feature_time"), "_pos", 4096, before=16)
        b = b.selectExpr("symbol", "feature_time AS signal_time", "close", OWN,
                         f"coalesce(close / lag(close, 1) {w}) - 1, 0D) AS ret_1",
                         f"close / max(high) {w} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) - 1 AS dist_high").where(OWN)
        return b.selectExpr("symbol", "signal_time", "close", "ret_1", "dist_high",
                            "round(1 / (1 + exp(-(0.4D + 12D * ret_1 + 6D * dist_high))), 6) AS probability")

    @cached_property
    def predictions(self) -> DataFrame:
        """Judged predictions: probability, threshold, label, event, lead time."""
        lab = self.label_events.select("symbol", "signal_time", "label_value", "event_id", "target_time",
                                       "lead_time_minutes", "max_adverse_excursion", "max_favorable_excursion",
                                       "exclusion_reason")
        p = self.rule_probs.join(lab, ["symbol", "signal_time"]).selectExpr("*", f"{sql_grid('signal_time', HOUR)} AS cell")
        return p.selectExpr("*", "concat_ws('-', symbol, CAST(cell AS STRING)) AS prediction_id", "0.55D AS threshold",
                            "24 AS horizon_hours", "CASE WHEN cell % 2 = 0 THEN 'm_even' ELSE 'm_odd' END AS model_id",
                            "signal_time + INTERVAL 24 HOURS AS invalidation_time",
                            "CAST(probability >= 0.55D AS INT) AS pred_value")

    @cached_property
    def judged(self) -> DataFrame:
        return self.predictions.where(F.col("label_value").isNotNull())

    def line_tasks(self) -> int:
        """Tasks that deal the order lines out evenly, however many there are; counted in the files' footers."""
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.table("lineitem").count() // LINES_A_TASK + 1)

    @cached_property
    def daily_prices(self) -> DataFrame:
        """Daily bars per supplier from the order lines, all days of a supplier in one partition.

        Lines are summed up per day in ``SHARES`` shares by order first, so that a supplier with most of the lines
        hands on a few rows per day.
        """
        li = self.table("lineitem").selectExpr(
            "CAST(l_suppkey AS STRING) AS symbol", f"timestamp_micros({sql_grid('l_shipdate', DAY)} * {DAY}000000L) AS feature_time", f"pmod(l_orderkey, {SHARES}) AS share",
            "struct(l_orderkey, l_linenumber, l_extendedprice / l_quantity AS px) AS trade", "CAST(l_extendedprice AS DECIMAL(20,8)) AS volume")
        keys, tasks = ("symbol", "feature_time", "share"), self.line_tasks()
        shares = li.repartition(tasks, *keys).groupBy(*keys).agg(*[F.expr(a) for a in (
            "min(trade) AS first", "max(trade) AS last", "max(trade.px) AS high", "min(trade.px) AS low", "sum(volume) AS volume", "count(1) AS n")])
        agg = ("min(first).px AS open", "max(high) AS high", "min(low) AS low", "max(last).px AS close",
               "CAST(sum(volume) AS DOUBLE) AS quote_volume", "sum(n) AS n")
        return (shares.repartition(tasks, "symbol").groupBy("symbol", "feature_time").agg(*[F.expr(a) for a in agg])
                .selectExpr("*", f"{sql_grid('feature_time', DAY)} AS cell"))

    @cached_property
    def tickers(self) -> DataFrame:
        """24-hour ticker per part: price change and traded value."""
        li = self.table("lineitem").selectExpr(
            "l_partkey AS part", "l_extendedprice / l_quantity * (1 - l_discount) AS px", "l_extendedprice",
            "struct(l_shipdate, l_orderkey, l_linenumber) AS stamp")
        agg = ("min_by(px, stamp) AS first_px", "max_by(px, stamp) AS last_px",
               "CAST(sum(CAST(l_extendedprice AS DECIMAL(20,8))) AS DOUBLE) AS quote_volume")
        return li.groupBy("part").agg(*[F.expr(a) for a in agg]).selectExpr(
            "part", "concat(CASE part WHEN 97 THEN 'USDC' WHEN 194 THEN 'BUSD' WHEN 291 THEN 'TUSD' "
                    "ELSE concat('C', part) END, 'USDT') AS symbol",
            "last_px", "quote_volume", "100D * (last_px / first_px - 1D) AS change_pct")

    @cached_property
    def scans(self) -> DataFrame:
        """Scan log: one row per symbol and hour; the cycle number restarts every day."""
        return self.rule_probs.selectExpr("*", f"{sql_grid('signal_time', HOUR)} AS cell").selectExpr(
            "symbol", "signal_time AS scan_time", "cell", "cell % 24 AS cycle",
            "cell * 16777216L + CAST(conv(substr(md5(symbol), 1, 6), 16, 10) AS BIGINT) AS seq",
            "round(probability * 100, 4) AS score", "close AS close_price", "probability",
            "CASE WHEN probability >= 0.6D THEN 'SHORT_CANDIDATE' WHEN probability >= 0.4D THEN 'WATCH' ELSE 'WAIT' END AS recommendation",
            "ret_1 AS price_change")

    @cached_property
    def alerts(self) -> DataFrame:
        """Alert history: strong predictions with delivery marks and outcomes."""
        return self.predictions.where("probability >= 0.5D").selectExpr(
            "symbol", "signal_time", "cell", "probability", "close AS close_price", "invalidation_time",
            "CASE WHEN probability >= 0.7D THEN 'HIGH' WHEN probability >= 0.6D THEN 'MEDIUM' ELSE 'LOW' END AS risk_level",
            "probability >= 0.55D AS sent", "signal_time + INTERVAL 10 SECONDS AS sent_at", "cell % 4 = 0 AS shadow",
            "cell % 11 = 0 AS dismissed", "label_value = 1 AS hit", "CASE WHEN label_value = 1 THEN target_time END AS hit_time")

"""Landed API pages: reading, flattening and typing them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENVELOPE = ("collection_run_id string, request_id string, provider string, product string, endpoint string, request_params_json string, "
            "requested_at string, received_at string, http_status int, response_hash_sha256 string, source_version string, "
            "collector_version string, payload_json string")
MARKET = "USD-M Futures"
DEFAULT_SYMBOL, DEFAULT_PERIOD = "BTCUSDT", "5m"
MONEY = "decimal(20,8)"


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with a fixed schema; blank lines are skipped by the reader."""
    return spark.read.schema(ENVELOPE).json(path).where("payload_json IS NOT NULL")


def _base(df: DataFrame, data_type: str, version: str) -> DataFrame:
    params = lambda k, d: F.coalesce(F.get_json_object("request_params_json", f"$.{k}"), F.lit(d))
    return df.withColumns({
        "market": F.lit(MARKET), "data_type": F.lit(data_type), "_symbol": params("symbol", DEFAULT_SYMBOL),
        "interval": F.lit(None).cast("string") if data_type == "funding" else params("period", DEFAULT_PERIOD),
        "collected_at": F.to_timestamp("received_at"), "dataset_version": F.lit(version), "quality_status": F.lit("valid"),
        "quality_flags": F.array().cast("array<string>")})


COMMON = ["symbol", "market", "data_type", "interval", "event_time", "available_time", "collected_at", "source_version",
          "dataset_version", "quality_status", "quality_flags"]


def normalize_bars(pages: DataFrame, version: str = "1.0.0") -> DataFrame:
    """Arrays of arrays to typed bars; a bar is known one second after its close."""
    rows = _base(pages, "klines", version).withColumn("r", F.explode(F.from_json("payload_json", "array<array<string>>")))
    ms = lambda i: f"timestamp_millis(CAST(r[{i}] AS BIGINT))"
    num = lambda i, n: f"CAST(r[{i}] AS {MONEY}) AS {n}"
    return rows.selectExpr(
        "_symbol AS symbol", "market", "data_type", "interval", f"{ms(6)} AS event_time", f"{ms(6)} + INTERVAL 1 SECOND AS available_time",
        *COMMON[6:], f"{ms(0)} AS open_time", f"{ms(6)} AS close_time", num(1, "open"), num(2, "high"), num(3, "low"), num(4, "close"),
        num(5, "volume_base"), num(7, "volume_quote"), "CAST(r[8] AS BIGINT) AS trade_count", num(9, "taker_buy_base"), num(10, "taker_buy_quote"))


def _objects(pages: DataFrame, data_type: str, fields: str, version: str) -> DataFrame:
    return _base(pages, data_type, version).withColumn("r", F.explode(F.from_json("payload_json", f"array<struct<{fields}>>")))


def _period(rows: DataFrame, *extra: str, symbol: str = "_symbol") -> DataFrame:
    """Five-minute records: known one second after their period ends."""
    start = "timestamp_millis(CAST(r.timestamp AS BIGINT))"
    end = f"{start} + INTERVAL 5 MINUTES"
    return rows.selectExpr(f"{symbol} AS symbol", "market", "data_type", "interval", f"{start} AS event_time", f"{end} + INTERVAL 1 SECOND AS available_time",
                           *COMMON[6:], f"{start} AS period_start", f"{end} AS period_end", *extra)


def normalize_funding(pages: DataFrame, version: str = "1.0.0") -> DataFrame:
    rows = _objects(pages, "funding", "symbol:string,fundingTime:string,fundingRate:string,markPrice:string", version)
    t = "timestamp_millis(CAST(r.fundingTime AS BIGINT))"
    return rows.selectExpr("r.symbol AS symbol", "market", "data_type", "interval", f"{t} AS event_time", f"{t} + INTERVAL 1 SECOND AS available_time",
                           *COMMON[6:], f"{t} AS funding_time", f"CAST(r.fundingRate AS {MONEY}) AS funding_rate", f"CAST(r.markPrice AS {MONEY}) AS mark_price")


def normalize_open_interest(pages: DataFrame, version: str = "1.0.0") -> DataFrame:
    rows = _objects(pages, "open_interest", "symbol:string,sumOpenInterest:string,sumOpenInterestValue:string,timestamp:string", version)
    return _period(rows, f"CAST(r.sumOpenInterest AS {MONEY}) AS open_interest_contracts", f"CAST(r.sumOpenInterestValue AS {MONEY}) AS open_interest_value",
                   symbol="r.symbol")


def normalize_taker(pages: DataFrame, version: str = "1.0.0") -> DataFrame:
    rows = _objects(pages, "taker_volume", "buySellRatio:string,buyVol:string,sellVol:string,timestamp:string", version)
    return _period(rows, f"CAST(r.buyVol AS {MONEY}) AS buy_volume", f"CAST(r.sellVol AS {MONEY}) AS sell_volume", f"CAST(r.buySellRatio AS {MONEY}) AS buy_sell_ratio")


def normalize_account_ratio(pages: DataFrame, top: bool = False, version: str = "1.0.0") -> DataFrame:
    """Account ratios of all or of the top traders (which carry their population)."""
    rows = _objects(pages, "top_ratio" if top else "global_ratio", "symbol:string,longShortRatio:string,longAccount:string,shortAccount:string,timestamp:string", version)
    extra = [f"CAST(r.longAccount AS {MONEY}) AS long_account", f"CAST(r.shortAccount AS {MONEY}) AS short_account", f"CAST(r.longShortRatio AS {MONEY}) AS long_short_ratio"]
    return _period(rows, *extra, *(["'top_trader_accounts' AS population"] if top else []), symbol="r.symbol")


def normalize_top_position(pages: DataFrame, version: str = "1.0.0") -> tuple[DataFrame, DataFrame]:
    """Position ratios and the rejected records whose ratio cannot be derived."""
    rows = _objects(pages, "top_position_ratio", "symbol:string,longShortRatio:string,longPosition:string,shortPosition:string,timestamp:string", version)
    num = lambda f: f"CAST(r.{f} AS {MONEY})"
    # A missing position is NULL; the ratio falls back to long over short.
    ratio = f"coalesce({num('longShortRatio')}, CAST(try_divide({num('longPosition')}, {num('shortPosition')}) AS {MONEY}))"
    out = _period(rows, f"{num('longPosition')} AS long_position", f"{num('shortPosition')} AS short_position", f"{ratio} AS long_short_ratio",
                  "'top_trader_positions' AS population", symbol="coalesce(r.symbol, _symbol)")
    return out.where("long_short_ratio IS NOT NULL"), out.where("long_short_ratio IS NULL")


def inventory(pages: DataFrame) -> DataFrame:
    """Rows, files and first/last receive time by symbol and endpoint."""
    p = pages.select(F.coalesce(F.get_json_object("request_params_json", "$.symbol"), F.lit(DEFAULT_SYMBOL)).alias("symbol"), "endpoint",
                     F.json_array_length("payload_json").alias("n"), F.to_timestamp("received_at").alias("t"), F.input_file_name().alias("file"))
    base = p.groupBy("symbol", "endpoint").agg(F.sum("n").alias("n_rows"), F.min("t").alias("first_received"), F.max("t").alias("last_received"))
    files = p.select("symbol", "endpoint", "file").distinct().groupBy("symbol", "endpoint").agg(F.count("file").alias("n_files"))
    return base.join(files, ["symbol", "endpoint"])


def high_watermark(df: DataFrame, keys: list[str], t: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max(t).alias("high_watermark"))


def after_watermark(df: DataFrame, marks: DataFrame, keys: list[str], t: str) -> DataFrame:
    """Rows newer than the stored mark of their key; an unknown key passes whole."""
    return df.join(marks, keys, "left").where(F.col("high_watermark").isNull() | (F.col(t) > F.col("high_watermark"))).drop("high_watermark")


def unprocessed(pages: DataFrame, done: DataFrame) -> DataFrame:
    """Pages of files that no earlier run has handled."""
    return pages.withColumn("file", F.input_file_name()).join(done.select("file"), "file", "left_anti")

"""Future-path labels, events and outcomes."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import elapsed_minutes, epoch_key, first_true, micros, safe_div
from tidemark.operators.ordered import OWN, SLICE, asof_backward, row_blocks, sessionize, with_position
from tidemark.operators.path import forward_path

# Fixed values of the label contract.
TARGET_DRAWDOWN, MAX_ADVERSE, GAP_TOLERANCE = 0.08, 0.04, 15
LABEL_VERSION = "distribution_short_v1"
HORIZONS = (6, 12, 24)


def hours_after(t: str, hours: Column | int) -> Column:
    h = F.lit(hours) if isinstance(hours, int) else hours
    return F.timestamp_micros(micros(t) + h.cast("bigint") * F.lit(3_600_000_000))


def label_paths(bars: DataFrame, horizons: Sequence[int] = HORIZONS, *, gap_minutes: int = GAP_TOLERANCE,
                target: float = TARGET_DRAWDOWN, adverse: float = MAX_ADVERSE) -> DataFrame:
    """Labels of every bar for each horizon, long by horizon.

    One pass over the bars serves all horizons.  Rows that cannot be judged
    get a NULL label and the reason, never 0.
    """
    quality = (F.coalesce(F.lower(F.col("quality_status").cast("string")), F.lit("invalid"))
               if "quality_status" in bars.columns else F.lit("valid"))
    price = F.col("close").cast("double")
    signals = (bars.select("symbol", F.col("feature_time").alias("signal_time"), price.alias("signal_price"),
                           quality.alias("quality_status"),
                           F.explode(F.array(*[F.lit(h) for h in dict.fromkeys(horizons)])).alias("horizon_hours")))
    p = F.col("signal_price")
    path = forward_path(signals, bars, ["symbol"], signal_t="signal_time",
                        id_cols=["signal_time", "signal_price", "quality_status", "horizon_hours"],
                        until=hours_after("signal_time", F.col("horizon_hours")),
                        lower=p * (1.0 - target), upper=p * (1.0 + adverse),
                        horizon_seconds=max(horizons) * 3600)
    low, up = F.col("lower_t"), F.col("upper_t")
    short = F.col("last_t").isNull() | (micros("last_t") < micros("signal_time")
                                        + (F.col("horizon_hours") * 60 - 5).cast("bigint") * 60_000_000)
    ambiguous = F.coalesce(low == up, F.lit(False))
    reason = first_true(
        (F.col("quality_status").isin("invalid", "quarantined"), "invalid_quality"),
        (F.col("max_gap") / 6e7 > gap_minutes, "data_gap"),
        (short, "missing_future_data"), (ambiguous, "ambiguous_intrabar"))
    judged = F.col("exclusion_reason").isNull()
    return path.withColumn("exclusion_reason", reason).select(
        "symbol", "signal_time", F.col("signal_price").cast("decimal(20,8)").alias("signal_price"),
        F.lit(LABEL_VERSION).alias("label_version"), "horizon_hours",
        F.when(judged, F.when(low.isNotNull() & (up.isNull() | (low < up)), 1).otherwise(0)).alias("label_value"),
        F.when(judged, low.isNotNull()).alias("target_reached"),
        low.alias("target_time"), elapsed_minutes("signal_time", "lower_t").alias("lead_time_minutes"),
        safe_div(F.col("max_high") - p, p).alias("max_adverse_excursion"),
        safe_div(F.col("min_low") - p, p).alias("max_favorable_excursion"),
        F.col("max_high").cast("decimal(20,8)").alias("future_max_high"),
        F.col("min_low").cast("decimal(20,8)").alias("future_min_low"),
        "exclusion_reason", ambiguous.alias("ambiguous_intrabar"), "quality_status")


def forward_rows(bars: DataFrame, rows: int = 290, gap_minutes: int = GAP_TOLERANCE) -> DataFrame:
    """Extremes of the next ``rows`` bars and whether they contain a hole."""
    df = row_blocks(with_position(bars, ["symbol"], ["feature_time"], "feature_time"), "_pos",
                    max(4 * rows, 4096), before=1, after=rows)
    order = Window.partitionBy("symbol", SLICE).orderBy("_pos")
    w = order.rowsBetween(1, rows)
    close, low, high = (F.col(c).cast("double") for c in ("close", "low", "high"))
    hole = elapsed_minutes(F.lag("feature_time").over(order), "feature_time") > gap_minutes
    df = df.withColumn("_hole", F.coalesce(hole, F.lit(False)).cast("int"))
    return df.withColumns({
        "future_max_high": F.max(high).over(w), "future_min_low": F.min(low).over(w),
        "max_fe": F.max(1 - safe_div(low, close)).over(w),
        "max_ae_any": F.max(safe_div(high, close) - 1).over(w),
        "last_future_time": F.max("feature_time").over(w), "future_count": F.count(F.lit(1)).over(w),
        "gap_exceeded": F.max("_hole").over(w),
    }).where(OWN).select(
        "symbol", F.col("feature_time").alias("signal_time"), close.alias("signal_close"),
        F.col("quality_status").alias("signal_quality"), "future_max_high", "future_min_low", "max_fe",
        "max_ae_any", "last_future_time", "future_count", "gap_exceeded")


def target_detection(bars: DataFrame, horizon_minutes: int = 1440, target: float = TARGET_DRAWDOWN,
                     adverse: float = MAX_ADVERSE) -> DataFrame:
    """First bar at or below the target level, with the adverse moves before and at it."""
    price = F.col("close").cast("double")
    signals = bars.select("symbol", F.col("feature_time").alias("signal_time"), price.alias("signal_close"))
    path = forward_path(signals, bars, ["symbol"], id_cols=["signal_time", "signal_close"], signal_t="signal_time",
                        until=F.timestamp_micros(micros("signal_time") + F.lit(horizon_minutes * 60_000_000)),
                        lower=F.col("signal_close") * (1 - target), upper=F.col("signal_close") * (1 + adverse),
                        horizon_seconds=horizon_minutes * 60)
    p = F.col("signal_close")
    return path.where(F.col("lower_t").isNotNull()).select(
        "symbol", "signal_time", F.col("lower_t").alias("target_time"),
        (safe_div("high_at_lower", p) - 1).alias("ae_at_target"),
        F.coalesce(safe_div("max_high_before_lower", p) - 1, F.lit(0.0)).alias("prior_max_ae"))


def label_first_generation(bars: DataFrame, *, horizon_minutes: int = 1440, rows: int | None = None,
                           gap_minutes: int = GAP_TOLERANCE, detail: bool = False) -> DataFrame:
    """24-hour label on row frames: target before the allowed adverse move.

    With ``detail`` the excursions and the exclusion reason are added and a
    non-positive price is excluded as well.
    """
    wide = forward_rows(bars, rows or horizon_minutes // 5 + 2, gap_minutes)
    hit = target_detection(bars, horizon_minutes)
    df = wide.join(hit, ["symbol", "signal_time"], "left")
    end = F.timestamp_micros(micros("signal_time") + F.lit(horizon_minutes * 60_000_000))
    prior, at = F.coalesce("prior_max_ae", F.lit(0.0)), F.coalesce("ae_at_target", F.lit(0.0))
    reached = F.col("target_time").isNotNull()
    short = F.col("last_future_time").isNull() | (micros("last_future_time")
                                                  < micros("signal_time") + (horizon_minutes - 5) * 60_000_000)
    rules = [(F.col("signal_quality").isin("invalid", "quarantined"), "invalid_signal_quality")]
    if detail:
        rules.append((F.col("signal_close").isNull() | (F.col("signal_close") <= 0), "invalid_signal_price"))
    rules += [(F.coalesce("future_count", F.lit(0)) == 0, "missing_future_data"),
              (F.coalesce("gap_exceeded", F.lit(0)) == 1, "gap_exceeds_threshold"),
              (short, "missing_future_data"),
              (reached & (prior <= MAX_ADVERSE) & (at > MAX_ADVERSE), "ambiguous_intrabar")]
    df = df.withColumn("exclusion_reason", first_true(*rules))
    judged = F.col("exclusion_reason").isNull()
    label = F.when(judged, F.when(reached & (prior <= MAX_ADVERSE), 1).otherwise(0))
    lead = F.floor(elapsed_minutes("signal_time", "target_time")).cast("int")
    base = ["symbol", "signal_time", label.alias("label_value")]
    if not detail:
        return df.select(*base, "target_time", lead.alias("lead_time_minutes"), end.alias("invalidation_time"))
    # Only an excluded row that is not merely ambiguous hides its path values.
    shown = judged | (F.col("exclusion_reason") == "ambiguous_intrabar")
    return df.select(
        *base, F.when(shown, reached).alias("target_reached"),
        F.when(shown, F.col("target_time")).alias("target_time"),
        F.when(shown, lead).alias("lead_time_minutes"),
        F.when(shown, F.when(reached, F.greatest(prior, at)).otherwise(F.coalesce("max_ae_any", F.lit(0.0))))
        .alias("max_adverse_excursion"),
        F.when(shown, F.coalesce("max_fe", F.lit(0.0))).alias("max_favorable_excursion"),
        F.when(shown, F.col("future_max_high")).alias("future_max_high"),
        F.when(shown, F.col("future_min_low")).alias("future_min_low"), "exclusion_reason")


def label_counts(labels: DataFrame) -> DataFrame:
    v = F.col("label_value")
    return labels.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(v == 1).alias("n_positive"),
                      F.count_if(v == 0).alias("n_negative"), F.count_if(v.isNull()).alias("n_excluded"))


def group_events(labels: DataFrame, *, keys: Sequence[str] = ("symbol",), gap_minutes: int = 60,
                 suffix: Column | None = None, name: str | None = None) -> DataFrame:
    """Give positive rows the id of their event; other rows keep NULL.

    A positive row at least ``gap_minutes`` after the previous one of its key
    starts a new event.
    """
    positive = labels.where(F.col("label_value") == 1)
    rest = labels.where(F.coalesce(F.col("label_value") != 1, F.lit(True)))
    marked = sessionize(positive, list(keys), "signal_time", gap_minutes * 60, "_start")
    parts = [F.col("symbol"), epoch_key("_start")] + ([suffix] if suffix is not None else [])
    out = marked.withColumn("event_id", F.concat_ws("_", *parts)).drop("_start")
    return out.unionByName(rest.withColumn("event_id", F.lit(None).cast("string")))


def event_summary(events: DataFrame) -> DataFrame:
    return (events.where(F.col("event_id").isNotNull()).groupBy("event_id", "symbol").agg(
        F.min("signal_time").alias("event_start_time"), F.max("signal_time").alias("event_end_time"),
        F.count(F.lit(1)).alias("member_rows"), F.min("target_time").alias("first_target_time"),
        F.min("max_favorable_excursion").alias("peak_favorable_excursion")))


def triple_barrier(bars: DataFrame, events: DataFrame, *, keys: Sequence[str] = ("symbol",), id_col: str = "signal_id",
                   take: float = 2.0, stop: float = 1.0, min_return: float = 0.005, hours: float = 12.0,
                   default_side: int = -1) -> DataFrame:
    """Which of take-profit, stop-loss or time comes first after each event.

    ``bars`` need ``volatility``; entry is the last bar at or before the event.
    A bar that touches both levels counts as a stop.
    """
    entry = asof_backward(events, bars.withColumn("entry_time", F.col("feature_time"))
                          .withColumn("entry_price", F.col("close").cast("double")),
                          list(keys), "signal_time", "feature_time", ["entry_time", "entry_price", "volatility"])
    side = F.when(F.col("side").isin(1, -1), F.col("side")).otherwise(F.lit(default_side))
    vol = F.greatest(F.col("volatility"), F.lit(min_return))
    entry = entry.where(F.col("entry_time").isNotNull()).withColumns({"side": side.cast("int"), "target_vol": vol})
    s = F.col("side")
    entry = entry.withColumns({
        "tp_price": F.col("entry_price") * (1.0 + s * F.col("target_vol") * take),
        "sl_price": F.col("entry_price") * (1.0 - s * F.col("target_vol") * stop)})
    short = s == -1
    path = forward_path(entry, bars, list(keys), id_cols=[id_col, "entry_time", "entry_price", "side", "target_vol",
                                                          "tp_price", "sl_price"],
                        signal_t="entry_time",
                        until=F.timestamp_micros(micros("entry_time") + F.lit(int(hours * 3_600_000_000))),
                        lower=F.when(short, F.col("tp_price")).otherwise(F.col("sl_price")),
                        upper=F.when(short, F.col("sl_price")).otherwise(F.col("tp_price")),
                        horizon_seconds=int(hours * 3600))
    tp_bar = F.when(short, F.col("lower_bar")).otherwise(F.col("upper_bar"))
    sl_bar = F.when(short, F.col("upper_bar")).otherwise(F.col("lower_bar"))
    touch = (F.when(sl_bar.isNotNull() & (tp_bar.isNull() | (sl_bar <= tp_bar)), "sl")
             .when(tp_bar.isNotNull(), "tp").otherwise("time"))
    df = path.where(F.col("n_future") > 0).withColumn("touch_type", touch)
    t = F.col("touch_type")
    tp_t = F.when(short, F.col("lower_t")).otherwise(F.col("upper_t"))
    sl_t = F.when(short, F.col("upper_t")).otherwise(F.col("lower_t"))
    df = df.withColumns({
        "exit_time": F.when(t == "tp", tp_t).when(t == "sl", sl_t).otherwise(F.col("last_t")),
        "exit_price": F.when(t == "tp", F.col("tp_price")).when(t == "sl", F.col("sl_price"))
                       .otherwise(F.col("last_close")),
        "label": F.when(t == "tp", 1).when(t == "sl", -1).otherwise(0),
        "holding_bars": F.when(t == "tp", tp_bar).when(t == "sl", sl_bar).otherwise(F.col("n_future"))})
    return df.select(*keys, id_col, "entry_time", "entry_price", "side", "target_vol", "tp_price", "sl_price",
                     "exit_time", "exit_price", "touch_type", "label",
                     (s * (F.col("exit_price") - F.col("entry_price")) / F.col("entry_price")).alias("raw_return"),
                     "holding_bars")


def excursions(trades: DataFrame, bars: DataFrame, *, keys: Sequence[str] = ("symbol",), id_col: str = "signal_id",
               max_hours: float = 12.0) -> DataFrame:
    """Best and worst move between entry and exit, both ends included."""
    start = F.timestamp_micros(micros("entry_time") - 1)
    path = forward_path(trades.withColumn("_from", start), bars, list(keys), id_cols=[id_col],
                        signal_t="_from", until="exit_time", lower=F.lit(float("-inf")), upper=F.lit(float("inf")),
                        horizon_seconds=int(max_hours * 3600) + 1)
    moved = trades.join(path.select(*keys, id_col, "n_future", "max_high", "min_low"), [*keys, id_col], "left")
    e, zero = F.col("entry_price"), F.lit(0.0)
    up, down = (F.col("max_high") - e) / e, (e - F.col("min_low")) / e
    enough = F.col("n_future") > 1
    best = F.when(enough, F.greatest(F.when(F.col("side") == 1, up).otherwise(down), zero)).otherwise(zero)
    worst = F.when(enough, F.greatest(F.when(F.col("side") == 1, down).otherwise(up), zero)).otherwise(zero)
    return (moved.withColumns({"mfe": best, "mae": worst})
            .withColumn("mfe_mae_ratio", F.col("mfe") / F.when(F.col("mae") == 0, 1e-4).otherwise(F.col("mae")))
            .drop("n_future", "max_high", "min_low"))


def tape_outcomes(opportunities: DataFrame, tape: DataFrame, as_of: Column, *, horizon_hours: int = 24,
                  gap_minutes: float = 15) -> DataFrame:
    """Judge due opportunities on the observation tape, holes at both ends included."""
    due = opportunities.where(F.col("due_at") <= as_of)
    p = F.col("reference_price").cast("double")
    path = forward_path(due, tape, ["symbol"], signal_t="observed_at", until="due_at",
                        id_cols=["opportunity_id", "observed_at", "due_at", "reference_price"],
                        lower=p * (1.0 - F.col("target_drawdown")), upper=p * (1.0 + F.col("max_adverse_excursion")),
                        horizon_seconds=horizon_hours * 3600, bar_t="observed_at")
    tail = micros("due_at") - micros("last_t")
    hole = F.greatest("max_gap", tail) / 6e7 > gap_minutes
    low, up = F.col("lower_t"), F.col("upper_t")
    df = path.withColumn("exclusion_reason", first_true(
        (F.col("n_future") == 0, "missing_future_data"), (hole, "data_gap"),
        (low == up, "ambiguous_intrabar")))
    judged = F.col("exclusion_reason").isNull()
    measured = F.coalesce(~F.col("exclusion_reason").isin("missing_future_data", "data_gap"), F.lit(True))
    hit = judged & low.isNotNull() & (up.isNull() | (low < up))
    price = F.col("reference_price").cast("double")
    return df.select(
        "opportunity_id", "symbol",
        F.when(judged, hit.cast("int")).alias("label_value"),
        F.when(hit, low).alias("target_time"),
        F.when(hit, elapsed_minutes("observed_at", "lower_t")).alias("lead_time_minutes"),
        F.when(measured, F.col("max_high") / price - 1.0).alias("mae"),
        F.when(measured, F.col("min_low") / price - 1.0).alias("mfe"),
        F.when(judged, "resolved").otherwise("excluded").alias("outcome_status"), "exclusion_reason")


TAKE_LEVELS = (0.03, 0.04, 0.06, 0.08, 0.12)


def stop_take_outcomes(signals: DataFrame, bars: DataFrame, *, id_cols: Sequence[str], stop: float = 0.04,
                       levels: Sequence[float] = TAKE_LEVELS, hours: int = 24, min_bars: int = 24) -> DataFrame:
    """Short-side result of each signal: take levels reached before the stop, and its profit.

    The deepest low before the stop bar decides all levels at once.
    """
    e = F.col("entry_price")
    path = forward_path(signals.where(e > 0), bars, ["symbol"], signal_t="signal_time",
                        id_cols=[*id_cols, "signal_time", "entry_price"],
                        until=hours_after("signal_time", hours), lower=F.lit(float("-inf")),
                        upper=e * (1 + stop), horizon_seconds=hours * 3600)
    drop = F.when(F.col("upper_bar").isNull(), (e - F.col("min_low")) / e).otherwise(
        (e - F.col("min_low_before_upper")) / e)
    zero = F.lit(0.0)
    df = path.where(F.col("n_future") >= min_bars).withColumns({
        "hit_sl": F.col("upper_bar").isNotNull(),
        "mae": F.greatest(zero, (F.col("max_high") - e) / e),
        "mfe": F.greatest(zero, (e - F.col("min_low")) / e),
        **{f"hit_tp_{round(x * 100)}pct": F.coalesce(drop >= x, F.lit(False)) for x in levels}})
    profit = (F.when(F.col("hit_sl"), F.lit(-stop)).when(F.col("hit_tp_8pct"), F.lit(0.08))
              .when(F.col("hit_tp_4pct"), F.lit(0.04)).otherwise((e - F.col("last_close")) / e))
    return df.withColumn("net_pnl", profit).select(
        "symbol", *[c for c in id_cols if c != "symbol"], "signal_time", "entry_price", "n_future", "mae", "mfe",
        "hit_sl", *[f"hit_tp_{round(x * 100)}pct" for x in levels], "net_pnl")


def resolve_predictions(pending: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcome rows for pending predictions; an unfinished horizon stays pending."""
    known = labels.where(F.coalesce(F.col("exclusion_reason") != "missing_future_data", F.lit(True))).select(
        "symbol", "signal_time", "horizon_hours", "label_value", "target_time", "lead_time_minutes",
        F.col("max_adverse_excursion").alias("mae"), F.col("max_favorable_excursion").alias("mfe"),
        "exclusion_reason", F.col("label_version").alias("outcome_engine_version"))
    return (pending.select("prediction_id", "model_id", "symbol", "signal_time", "horizon_hours")
            .join(known, ["symbol", "signal_time", "horizon_hours"])
            .withColumn("outcome_status", F.when(F.col("label_value").isNull(), "excluded").otherwise("materialized")))


def pending_rows(predictions: DataFrame, outcomes: DataFrame, as_of: Column, key: str = "prediction_id") -> DataFrame:
    """Rows whose horizon has ended and that have no outcome."""
    return predictions.where(F.col("invalidation_time") <= as_of).join(outcomes.select(key), key, "left_anti")

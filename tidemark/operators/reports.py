"""Operational reports: counts, histograms, freshness, readiness, feeds."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import content_hash, local_day
from tidemark.operators.metrics import ratio
from tidemark.operators.quantiles import exact_percentiles


def alert_stats(alerts: DataFrame) -> DataFrame:
    """Total, per-level counts in long form, and hit rate of delivered and judged alerts."""
    total = alerts.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("sent") & F.col("hit").isNotNull()).alias("n_judged"),
                       F.count_if(F.col("sent") & F.col("hit")).alias("n_hit")).withColumn("risk_level", F.lit("ALL"))
    level = alerts.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"n_judged": F.lit(None).cast("bigint"), "n_hit": F.lit(None).cast("bigint")})
    both = total.unionByName(level)
    return both.withColumn("hit_rate", F.try_divide(F.col("n_hit").cast("double"), F.col("n_judged")))


def precision_by_level(alerts: DataFrame) -> DataFrame:
    t = alerts.groupBy("risk_level").agg(F.count_if(F.col("hit").isNotNull()).alias("n_judged"), F.count_if("hit").alias("n_hit"))
    return t.withColumn("precision", F.try_divide(F.col("n_hit").cast("double"), F.col("n_judged")))


def lead_time(alerts: DataFrame) -> DataFrame:
    hours = (F.unix_micros("hit_time") - F.unix_micros("signal_time")) / 3.6e9
    h = alerts.where("hit AND hit_time IS NOT NULL").withColumn("h", hours)
    q = exact_percentiles(h, (), F.col("h"), {"p25": 0.25, "median": 0.5, "p75": 0.75})
    base = h.agg(F.count("h").alias("n_samples"), F.round(F.avg("h"), 1).alias("mean_hours"), F.round(F.min("h"), 1).alias("min_hours"),
                 F.round(F.max("h"), 1).alias("max_hours"))
    packed = q.select(F.struct("p25", "median", "p75")).scalar()
    return base.withColumn("_q", packed).select("*", F.round("_q.median", 1).alias("median_hours"),
                                                (F.col("_q.p25") * 60).alias("p25_minutes"), (F.col("_q.p75") * 60).alias("p75_minutes")).drop("_q")


def per_local_day(df: DataFrame, t: str, aggs: list[Column], days: int = 30) -> DataFrame:
    """Counts per display-clock day, newest days first."""
    return df.groupBy(local_day(t).alias("day")).agg(*aggs).orderBy(F.col("day").desc()).limit(days)


def distinct_per_day(df: DataFrame, t: str, names: dict[str, str], days: int = 30) -> DataFrame:
    """Rows and distinct values per day; values are deduplicated before they are counted."""
    day = local_day(t).alias("day")
    base = df.groupBy(day).agg(F.count(F.lit(1)).alias("n_rows"))
    for out, column in names.items():
        base = base.join(df.select(day, column).distinct().groupBy("day").agg(F.count(column).alias(out)), "day", "left")
    return base.orderBy(F.col("day").desc()).limit(days)


def table_freshness(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Row count and first/last time of each table."""
    out = None
    for name, (df, t) in tables.items():
        part = df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(t).alias("first_time"), F.max(t).alias("last_time")).select(
            F.lit(name).alias("table_name"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def histograms(df: DataFrame, columns: list[str]) -> DataFrame:
    """Value counts of several columns in one pass, long form."""
    pairs = ", ".join(f"struct('{c}' AS metric, coalesce(CAST({c} AS STRING), 'NULL') AS value)" for c in columns)
    return df.selectExpr(f"inline(array({pairs}))").groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))


def null_report(df: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """Null counts of the columns, most first, from one aggregate row."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    return one.selectExpr(f"stack({len(columns)}, {pairs}) AS (column_name, n_null)").orderBy(F.col("n_null").desc(), "column_name").limit(top)


def duplicate_rows(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows beyond the first of each key."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_duplicates"))


def regime_breakdown(df: DataFrame, ret: str = "price_ret_24h") -> DataFrame:
    r = F.col(ret)
    regime = F.when(r > 0.02, "bull").when(r < -0.02, "bear").when(r.isNotNull(), "side").otherwise("unknown")
    return df.groupBy(regime.alias("regime")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("label_value") == 1).alias("n_positive"),
        F.count_if(F.col("label_value") == 0).alias("n_negative"), F.coalesce(F.avg("label_value"), F.lit(0.0)).alias("prevalence"))


def dataset_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count and order-free content hash, so the same rows always give the same value."""
    t = df.agg(F.count(F.lit(1)).alias("n_rows"), content_hash(columns).alias("h"))
    return t.select("n_rows", F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), F.col("h").cast("string")), 256).alias("fingerprint"))


def cycle_tail(scans: DataFrame) -> DataFrame:
    """The last run of equal cycle numbers in ingest order; one row.

    Finds the newest row whose cycle differs from the last one and counts what
    follows, so no ordered scan of the log is needed.
    """
    last = scans.agg(F.max_by(F.struct("cycle", "scan_time"), "seq").alias("l")).select("l.*")
    tagged = scans.withColumn("_last", last.select("cycle").scalar())
    edge = tagged.where(F.col("cycle") != F.col("_last")).agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("e"))
    tail = tagged.where(F.col("seq") > edge.scalar())
    return tail.agg(F.max_by("scan_time", "seq").alias("last_scan_time"), F.max("cycle").alias("cycle"), F.count(F.lit(1)).alias("n_symbols"),
                    F.count_if(F.col("recommendation") == "SHORT_CANDIDATE").alias("n_alerts"))


def market_index(latest: DataFrame) -> DataFrame:
    t = latest.agg(F.avg("score").alias("avg_score"))
    a = F.col("avg_score")
    return t.withColumn("regime", F.when(a.isNull(), "no data").when(a >= 60, "high").when(a >= 40, "moderate").otherwise("low"))


def run_history(runs: DataFrame) -> DataFrame:
    """Per hour of runs: coins, valid ones, those with an edge, and the best."""
    edge = (F.col("leakage") == "passed") & (F.col("precision") > F.col("baseline")) & (F.col("precision") > 0)
    return runs.groupBy(F.date_trunc("hour", "created_at").alias("run_time")).agg(
        F.count(F.lit(1)).alias("n_coins"), F.count_if(F.col("n_folds") > 0).alias("n_valid"), F.count_if(edge).alias("n_edge"),
        F.max_by("symbol", F.struct("precision", "symbol")).alias("best_coin"), F.round(F.max("precision"), 4).alias("best_precision"))


def signal_feed(alerts: DataFrame, scans: DataFrame, predictions: DataFrame, as_of: Column) -> DataFrame:
    """One feed of alerts, newest scans and newest predictions per symbol, newest first.

    A scan is left out when an alert of its symbol is at or after it.
    """
    from tidemark.operators.ordered import latest_per_key
    a = alerts.where(~F.col("dismissed")).select("symbol", F.coalesce("sent_at", "signal_time").alias("event_time"), "probability", F.lit("alert").alias("kind"))
    newest = a.groupBy("symbol").agg(F.max("event_time").alias("_alert"))
    s = latest_per_key(scans, ["symbol"], ["seq"]).join(newest, "symbol", "left").where("_alert IS NULL OR _alert < scan_time").select(
        "symbol", F.col("scan_time").alias("event_time"), "probability", F.lit("scan").alias("kind"))
    p = latest_per_key(predictions, ["symbol"], ["signal_time", "prediction_id"]).select(
        "symbol", F.col("signal_time").alias("event_time"), "probability", F.lit("prediction").alias("kind"))
    return a.unionByName(s).unionByName(p).where(F.col("event_time") <= as_of).orderBy(F.col("event_time").desc(), "symbol", "kind")


def tracked_positions(entries: DataFrame, alerts: DataFrame, tickers: DataFrame, scans: DataFrame, as_of: Column) -> DataFrame:
    """Tracked signals with current price, state and progress to the target.

    An alert belongs to an entry when its time is within one second; the
    price comes from the ticker, else the newest scan, else the source.
    Alerts stand under their own second and both next to it, so the join has
    the second as a key and meets few rows per key however many a symbol has.
    """
    from tidemark.operators.ordered import latest_per_key
    e = entries.withColumn("_s", F.unix_seconds("source_time")).alias("e")
    a = alerts.withColumn("_s", F.explode(F.array(*[F.unix_seconds("signal_time") + d for d in (-1, 0, 1)]))).alias("a")
    near = F.expr("e.symbol = a.symbol AND e._s = a._s AND abs(unix_micros(e.source_time) - unix_micros(a.signal_time)) < 1000000")
    t = e.join(a, near, "left").select(*[f"e.{c}" for c in entries.columns], F.col("a.close_price").alias("a_price"), F.col("a.hit").alias("a_hit"), F.col("a.invalidation_time").alias("a_end"))
    t = t.join(tickers.select("symbol", F.col("last_px").alias("t_price")), "symbol", "left")
    t = t.join(latest_per_key(scans, ["symbol"], ["seq"]).select("symbol", F.col("close_price").alias("s_price")), "symbol", "left")
    t = t.withColumns({"source_price": F.coalesce("a_price", "source_price"), "end_time": F.coalesce("a_end", "end_time")})
    src = F.col("source_price")
    target = F.round(src * 0.92, 8)
    cur = F.coalesce("t_price", "s_price", "source_price")
    state = (F.when(F.col("a_hit"), "HIT").when(F.col("end_time") <= as_of, "EXPIRED").when(F.col("end_time").isNotNull(), "ACTIVE").otherwise("NO_SIGNAL"))
    progress = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (src - cur) / (src - target))) * 100, 1)
    return t.select("symbol", "source_time", src.alias("source_price"), cur.alias("current_price"), state.alias("signal_status"),
                    F.round((cur - src) / src * 100, 2).alias("signal_change_pct"), progress.alias("signal_progress_pct"))


def reconcile_prices(ours: DataFrame, ids: DataFrame, theirs: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Compare two price sources through an id map."""
    t = ours.join(ids, "symbol", "left").join(theirs, "asset_id", "left")
    known = F.coalesce(F.col("other_price") > 0, F.lit(False))
    diff = F.when(known, F.abs(F.col("price") - F.col("other_price")) / F.col("other_price"))
    t = t.withColumn("price_diff", diff)
    return t.withColumn("flag", F.when(~known, "NO_DATA").when(F.col("price_diff") > threshold, "PRICE_MISMATCH").otherwise("OK"))


def materialization(predictions: DataFrame, outcomes: DataFrame, pending: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    t = predictions.agg(n.alias("predictions")).withColumns({
        "outcomes": outcomes.agg(n).scalar(), "excluded": outcomes.agg(F.count_if(F.col("label_value").isNull())).scalar(), "pending": pending.agg(n).scalar()})
    return t.withColumn("status", F.when(F.col("pending") == 0, "ok").otherwise("backlog"))


def validate_predictions(df: DataFrame) -> DataFrame:
    """Counts of every violation in one pass; all zero means usable."""
    p, t, y = F.col("probability"), F.col("threshold"), F.col("label_value")
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(p.isNull() | t.isNull() | y.isNull()).alias("n_missing"),
                  F.count_if((p < 0) | (p > 1)).alias("n_bad_probability"), F.count_if((t < 0) | (t > 1)).alias("n_bad_threshold"),
                  F.count_if(~y.isin(0, 1)).alias("n_bad_label"), F.count("event_id").alias("n_with_event"))
    dup = df.groupBy("prediction_id").agg(F.count(F.lit(1)).alias("c")).agg(F.count_if(F.col("c") > 1)).scalar()
    return rows.withColumn("n_duplicate_ids", dup)


def attach_labels(predictions: DataFrame, labels: DataFrame, key: list[str]) -> DataFrame:
    """Left join of labels that keeps unresolved rows; a repeated label key fails the job."""
    counted = labels.groupBy(*key).agg(F.count(F.lit(1)).alias("_c"), F.first("label_value").alias("label_value"))
    guard = F.when(F.col("_c") > 1, F.raise_error(F.lit("labels contain duplicate keys"))).otherwise(F.col("label_value"))
    return predictions.join(counted.withColumn("label_value", guard.cast("int")).drop("_c"), key, "left")


def promotion_metrics(df: DataFrame) -> DataFrame:
    """Share and ratio helpers per arm of judged decisions (``arm, selected, label_value, rank``)."""
    sel = F.col("selected")
    t = df.groupBy("arm").agg(F.count(F.lit(1)).alias("resolved"), F.count_if(sel).alias("selected_resolved"), F.count_if(sel & (F.col("label_value") == 1)).alias("tp"),
                              F.count_if(F.col("label_value") == 1).alias("positive_anchors"))
    return t.withColumns({"anchor_precision": ratio(F.col("tp"), F.col("selected_resolved")), "anchor_recall": ratio(F.col("tp"), F.col("positive_anchors"))})


def filter_comparison(decisions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per arm of candidate filters: anchors, truth events, episodes, lead times and false candidates.

    ``decisions``: ``arm, symbol, signal_time, selected, rank, episode_id, label_value``.  ``truth``: ``symbol, signal_time, truth_event,
    event_target`` of the positive anchors, the same for all arms.  An event counts as caught from its earliest selected anchor, an
    episode by its first selected anchor; a missing ratio is NULL.
    """
    d = decisions.join(truth, ["symbol", "signal_time"], "left")
    day = F.greatest(F.lit(1.0), (F.max(F.unix_micros("signal_time")) - F.min(F.unix_micros("signal_time"))) / 86_400_000_000)
    base = d.groupBy("arm").agg(
        F.count(F.lit(1)).alias("anchors"), F.count("label_value").alias("resolved"), F.count_if(F.expr("selected AND label_value IS NOT NULL")).alias("selected_resolved"),
        F.count_if(F.expr("selected AND label_value = 1")).alias("tp"), F.count_if(F.col("label_value") == 1).alias("positive_anchors"),
        F.count_if(F.expr("selected AND rank <= 10 AND label_value IS NOT NULL")).alias("_n10"), F.count_if(F.expr("selected AND rank <= 10 AND label_value = 1")).alias("_tp10"),
        day.alias("_days"), F.count_distinct(F.to_date("signal_time")).alias("evaluation_days"))
    events = d.where("truth_event IS NOT NULL").groupBy("arm", "truth_event").agg(
        F.min("event_target").alias("_target"), F.min(F.when(F.expr("selected AND label_value = 1"), F.col("signal_time"))).alias("_first"))
    lead = events.where("_first IS NOT NULL").withColumn("_lead", F.greatest(F.lit(0.0), (F.unix_micros("_target") - F.unix_micros("_first")) / 6e7))
    leads = exact_percentiles(lead, ["arm"], F.col("_lead"), {"median_lead_time_minutes": 0.5}).drop("n_values")
    events = events.groupBy("arm").agg(F.count(F.lit(1)).alias("positive_events"), F.count("_first").alias("caught_events"))
    first = d.where("selected AND label_value IS NOT NULL AND episode_id IS NOT NULL").groupBy("arm", "episode_id").agg(
        F.min_by("label_value", F.struct("signal_time", "symbol")).alias("y"))
    episodes = first.groupBy("arm").agg(F.count(F.lit(1)).alias("episodes_resolved"), F.count_if(F.col("y") == 1).alias("_good"), F.count_if(F.col("y") == 0).alias("_bad"))
    t = base.join(events, "arm", "left").join(leads, "arm", "left").join(episodes, "arm", "left").na.fill(
        0, ["positive_events", "caught_events", "episodes_resolved", "_good", "_bad"])
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    return t.withColumns({
        "anchor_precision": share("tp", "selected_resolved"), "anchor_recall": share("tp", "positive_anchors"), "event_recall": share("caught_events", "positive_events"),
        "precision_at_10": share("_tp10", "_n10"), "episode_precision": share("_good", "episodes_resolved"),
        "false_candidates_per_day": F.col("_bad") / F.col("_days")}).drop("_n10", "_tp10", "_days", "_good", "_bad")


# Floors of the promotion of a filter.
PROMOTION = {"resolved": 200, "events": 50, "days": 14, "event_recall": 0.80, "gain": 0.10, "recall_loss": 0.05}


def promotion_gates(comparison: DataFrame, intervals: DataFrame | None = None) -> DataFrame:
    """Gates of the challenger against the champion, one row each with the reason that it gives when it fails.

    ``intervals`` has one row with the lower ends ``precision_low`` and ``recall_low`` of the paired differences; without it those two
    gates are NULL, and an end that could not be drawn fails its gate.  No gate is decided (NULL) before there is enough data.
    """
    p = PROMOTION
    row = comparison.groupBy().agg(*[F.max_by(F.struct("*"), F.when(F.col("arm") == arm, 1)).alias(name) for arm, name in (("champion", "a"), ("challenger", "b"))])
    low = intervals.select(F.struct("precision_low", "recall_low")).scalar() if intervals is not None else F.expr(
        "CAST(NULL AS STRUCT<precision_low: DOUBLE, recall_low: DOUBLE>)")
    row = row.withColumn("i", low)
    enough = (f"least(a.resolved, b.resolved) >= {p['resolved']} AND a.positive_events >= {p['events']} AND greatest(a.evaluation_days, b.evaluation_days) >= {p['days']}")
    sure = lambda e: e if intervals is None else f"coalesce({e}, false)"
    gates = (("insufficient_resolved_outcomes", f"least(a.resolved, b.resolved) >= {p['resolved']}", False), ("insufficient_positive_events", f"a.positive_events >= {p['events']}", False),
             ("evaluation_window_too_short", f"greatest(a.evaluation_days, b.evaluation_days) >= {p['days']}", False),
             ("precision_at_10_gate_failed", f"coalesce(b.precision_at_10 >= a.precision_at_10 * {1 + p['gain']}D, false)", True),
             ("precision_ci_gate_failed", sure("i.precision_low > 0"), True), ("recall_guardrail_failed", f"coalesce(b.event_recall >= a.event_recall - {p['recall_loss']}D, false)", True),
             ("recall_ci_guardrail_failed", sure(f"i.recall_low >= -{p['recall_loss']}D"), True),
             ("false_candidate_guardrail_failed", "b.false_candidates_per_day <= a.false_candidates_per_day", True),
             ("minimum_event_recall_failed", f"coalesce(b.event_recall >= {p['event_recall']}D, false)", True))
    arms = ", ".join(f"named_struct('reason', '{n}', 'passed', {f'CASE WHEN {enough} THEN {e} END' if late else e})" for n, e, late in gates)
    return row.selectExpr(f"inline(array({arms}))")

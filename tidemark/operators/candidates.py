"""Candidate filters: run-ups, rules, episode states, rankings and paired audits."""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import first_true, flag_list, from_micros, micros, sql_grid, sql_micros, with_exprs
from tidemark.operators.ordered import DAY, OWN, SLICE, row_blocks, time_slices, with_position
from tidemark.operators.speculative import speculative_scan

# Fixed values of the filter policy.
PUMP_HORIZONS = {24: 0.15, 72: 0.30, 120: 0.50}
MEMORY_HOURS, EXHAUSTION, DISTRIBUTION, DUMPED, MIN_GROUPS = 72, 0.02, 0.05, 0.25, 2
TINY = 1e-12
STAGES = ("PUMPING", "EXHAUSTING", "DISTRIBUTING", "DUMPED")
STAGE_SCORE = {"PUMPING": 0.0, "EXHAUSTING": 0.35, "DISTRIBUTING": 0.75, "DUMPED": 1.0, "DATA_UNAVAILABLE": 0.0}


def candidate_rules(df: DataFrame, *, min_return: float = 0.05, near_high: float = -0.08, weak: float = -0.01, zscore: float = 2.0,
                    unwind: float = -0.05, min_score: float = 35.0, min_quality: float = 0.8) -> DataFrame:
    """Fast candidate rule on scored rows: a rise, and one more sign, on usable data."""
    num = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in df.columns else F.lit(0.0)
    status = F.lower(F.coalesce(F.col("quality_status"), F.lit("valid")))
    quality = F.coalesce(F.col("data_quality_score"), F.when(status == "valid", 1.0).otherwise(0.75))
    bad = ~status.isin("valid", "warning") | (quality < min_quality)
    pump = num("price_ret_24h") >= min_return
    near, slow = num("distance_from_high_24h") >= near_high, num("momentum_deceleration_4h") <= weak
    deriv = (num("funding_zscore_30d") >= zscore) | (num("oi_change_24h") <= unwind) | (num("top_long_short_position_ratio") >= 1.5)
    score = F.col("total_score") >= min_score
    df = df.withColumn("passed", ~bad & pump & (near | slow | deriv | score))
    return df.withColumn("reason_codes", flag_list(
        (bad, "quality_gate_failed"), (pump, "pump_or_price_return"), (near, "near_high"), (slow, "momentum_weakening"),
        (deriv, "derivatives_abnormal"), (score, "heuristic_score"), (~F.col("passed"), "candidate_rejected")))


def candidate_recall(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Share of event symbols among the candidates, and how much the list shrinks the rows."""
    c = candidates.select("symbol").distinct().withColumn("c", F.lit(True))
    e = events.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    t = e.join(c, "symbol", "full").agg(
        F.count_if(F.col("c")).alias("candidate_count"), F.count_if(F.col("n").isNotNull()).alias("event_count"),
        F.count_if(F.col("c") & F.col("n").isNotNull()).alias("caught_event_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return t.select("candidate_count", "event_count", "caught_event_count", share("caught_event_count", "event_count").alias("event_recall"),
                    F.when(F.col("rows") > 0, F.greatest(F.lit(0.0), 1.0 - share("candidate_count", "rows"))).otherwise(0.0).alias("reduction_ratio"))


def pump_windows(daily: DataFrame, days: int = 5) -> DataFrame:
    """Strongest rise from a day's open to the highest high of the next 1..``days`` days, per symbol.

    The earliest start and then the shortest window wins a tie.  Days count by row.
    The newest close and volume come from the same pass.

    A symbol has one row per day, however many trades there are, so its days stay together: rows that come
    partitioned by symbol are sorted once, and neither copied nor shuffled again.
    """
    w, ks = "OVER (PARTITION BY symbol ORDER BY feature_time)", range(1, days + 1)
    d = daily.where("symbol IS NOT NULL AND feature_time IS NOT NULL")
    # without a day k rows ahead next_k is NULL, without a high on it -Infinity
    d = d.selectExpr("symbol", "feature_time", "open", "high", "close", "quote_volume", *[f"lead(coalesce(high, double('-Infinity')), {k}) {w} AS next_{k}" for k in ks])
    d = with_exprs(d, **{f"top_{k}": f"CASE WHEN next_{k} IS NOT NULL THEN greatest(high, {', '.join(f'next_{i}' for i in range(1, k + 1))}) END" for k in ks})
    d = with_exprs(d, **{f"pct_{k}": f"try_divide(top_{k}, open) - 1" for k in ks})
    d = d.withColumn("pump_pct", F.expr(f"array_max(array({', '.join(f'pct_{k}' for k in ks)}))"))
    days_, peak = (f"CASE pump_pct {' '.join(f'WHEN pct_{k} THEN {x.format(k)}' for k in ks)} END" for x in ("{}", "top_{}"))
    rise = F.expr(f"CASE WHEN open > 0 AND pump_pct > 0 THEN struct(pump_pct, -unix_micros(feature_time) AS less_t, -({days_}) AS less_days, {peak} AS peak_price) END")
    best = d.groupBy("symbol").agg(F.max(rise).alias("b"), F.max_by(F.struct("close", "quote_volume"), "feature_time").alias("l"))
    return best.where("b IS NOT NULL").selectExpr("symbol", "b.pump_pct", "-b.less_days AS pump_days", "b.peak_price", "l.close", "l.quote_volume")


def pump_candidates(daily: DataFrame, *, min_pump: float = 0.5, max_pump: float = 5.0, keep: float = 0.7, min_volume: float = 500_000,
                    days: int = 5) -> DataFrame:
    """Symbols that rose strongly, have not yet fallen back, and trade enough."""
    c = pump_windows(daily, days).withColumn("current_vs_peak", F.col("close") / F.col("peak_price"))
    return c.where(F.col("pump_pct").between(min_pump, max_pump) & (F.col("current_vs_peak") >= keep) & (F.col("quote_volume") >= min_volume))


RUN_FIELDS = ("ret", "ref", "ref_t", "peak", "peak_t")


def _run_up(t: np.ndarray, t_open: np.ndarray, o: np.ndarray, h: np.ndarray, l: np.ndarray, hours: int) -> dict[str, np.ndarray]:
    """For each bar: strongest rise over a low of an earlier bar within the last hours."""
    n = len(t)
    start = np.searchsorted(t, t - hours * 3_600_000_000, side="right")
    size = np.arange(n) - start + 1
    ref, ref_t = o[start].copy(), t_open[start].copy()
    best, bref, bref_t = np.full(n, -1.0), ref.copy(), ref_t.copy()
    peak, peak_t = h[start].copy(), t[start].copy()
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        j = start[live] + k
        rise = h[j] / ref[live] - 1.0
        up = live[rise > best[live] + TINY]
        best[up], bref[up], bref_t[up] = rise[rise > best[live] + TINY], ref[up], ref_t[up]
        peak[up], peak_t[up] = h[start[up] + k], t[start[up] + k]
        # a low only counts for later bars
        low = live[l[j] < ref[live]]
        ref[low], ref_t[low] = l[start[low] + k], t[start[low] + k]
    return dict(zip(RUN_FIELDS, (np.maximum(best, 0.0), bref, bref_t, peak, peak_t)))


def run_ups(bars: DataFrame, horizons: Sequence[int] = tuple(PUMP_HORIZONS), span: int = 30 * DAY) -> DataFrame:
    """Best run-up of the past 24/72/120 hours at every bar, as seen at its close.

    Bars of a symbol are cut into time slices with a halo as long as the
    longest horizon.
    """
    b = time_slices(bars.selectExpr("symbol", "open_time", "close_time", *[f"CAST({c} AS DOUBLE) AS {c}" for c in ("open", "high", "low", "close")]),
                    "close_time", span, before=max(horizons) * 3600)
    b = b.selectExpr("symbol", SLICE, OWN, f"{sql_micros('close_time')} AS t", f"{sql_micros('open_time')} AS t0", "open", "high", "low", "close")
    kinds = {"ret": "double", "ref": "double", "ref_t": "bigint", "peak": "double", "peak_t": "bigint"}
    names = [f"{f}_{h}" for h in horizons for f in RUN_FIELDS]
    schema = "symbol string, t bigint, close double, " + ", ".join(f"{f}_{h} {kinds[f]}" for h in horizons for f in RUN_FIELDS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", ignore_index=True)
        out = pdf[["symbol", "t", "close", OWN]].copy()
        cols = [pdf[c].to_numpy() for c in ("t", "t0", "open", "high", "low")]
        for h in horizons:
            for f, x in _run_up(*cols, h).items():
                out[f"{f}_{h}"] = x
        return out[out[OWN]].drop(columns=OWN)

    return b.groupBy("symbol", SLICE).applyInPandas(run, schema).select("symbol", from_micros("t").alias("scan_time"), "close", *names)


def pump_signal(runs: DataFrame, thresholds: dict[int, float] = PUMP_HORIZONS) -> DataFrame:
    """Normalised pump score of the best horizon and the thresholds passed."""
    arms = ", ".join(f"struct(ret_{h} / {th}D AS score, -{h} AS hh, -peak_t_{h} AS pt, ref_{h} AS reference_price, ref_t_{h} AS reference_t, "
                     f"peak_{h} AS peak_price, peak_t_{h} AS peak_t)" for h, th in thresholds.items())
    passed = ", ".join(f"CASE WHEN ret_{h} + {TINY}D >= {th}D THEN 'pump_threshold_{h}h' END" for h, th in thresholds.items())
    df = runs.selectExpr("symbol", "scan_time", "close", f"array_max(array({arms})) AS b", f"array_compact(array({passed})) AS pump_reasons")
    return df.selectExpr("symbol", "scan_time", "close", "size(pump_reasons) > 0 AS direct_pump", "greatest(0D, b.score) AS pump_score",
                         "b.reference_price", "b.reference_t", "b.peak_price", "b.peak_t", "pump_reasons")


def flow_evidence(small_bars: DataFrame, hours: int = 24) -> DataFrame:
    """Traded value, buyers' share, falling share and top of the last hours at every small bar."""
    b = time_slices(small_bars, "close_time", 7 * DAY, before=hours * 3600)
    b = b.selectExpr("*", f"{sql_micros('close_time')} AS _t")
    w = f"OVER (PARTITION BY symbol, {SLICE} ORDER BY _t RANGE BETWEEN {hours * 3_600_000_000 - 1}L PRECEDING AND CURRENT ROW)"
    return b.selectExpr(
        "symbol", "close_time", OWN, f"sum(volume_quote) {w} AS volume_24h",
        f"sum(CASE WHEN volume_quote > 0 THEN least(taker_buy_quote, volume_quote) END) {w} / sum(CASE WHEN volume_quote > 0 THEN volume_quote END) {w} AS buy_share",
        f"sum(CASE WHEN close < open THEN volume_quote ELSE 0D END) {w} / sum(CASE WHEN volume_quote > 0 THEN volume_quote END) {w} AS red_share",
        f"max(high) {w} AS top_price").where(OWN).drop(OWN)


def stage_of(drawdown: Column) -> Column:
    d = drawdown + TINY
    return F.when(d >= DUMPED, "DUMPED").when(d >= DISTRIBUTION, "DISTRIBUTING").when(d >= EXHAUSTION, "EXHAUSTING").otherwise("PUMPING")


def stage_scores(df: DataFrame) -> DataFrame:
    """Stage, evidence groups, transition and rank score from drawdown, shares and pump score."""
    df = df.withColumn("stage", stage_of(F.col("drawdown")))
    df = df.withColumn("evidence_groups", flag_list((F.col("drawdown") + TINY >= EXHAUSTION, "price_structure"),
                                                    (F.col("buy_share") < 0.5, "order_flow"), (F.col("red_share") > 0.5, "volume_distribution")))
    part = F.when(F.col("stage") == "DUMPED", 1.0).when(F.col("stage") == "DISTRIBUTING", 0.75).when(F.col("stage") == "EXHAUSTING", 0.35).otherwise(0.0)
    transition = 0.7 * part + 0.3 * F.least(F.lit(1.0), F.size("evidence_groups") / MIN_GROUPS)
    df = df.withColumn("transition_score", transition)
    return df.withColumn("rank_score", 0.7 * F.col("pump_score") + 0.3 * F.col("transition_score"))


class Episode:
    """State of one symbol between scans; plain numbers so it fits a state store."""

    FIELDS = ("episode", "stage", "ref", "ref_t", "peak", "peak_t", "last_pump", "score")

    def __init__(self, values: Sequence | None = None):
        self.__dict__.update(zip(self.FIELDS, values or (None, "", None, None, None, None, None, 0.0)))

    def values(self) -> tuple:
        return tuple(getattr(self, f) for f in self.FIELDS)

    def step(self, r) -> dict:
        """Advance by one scan row and return its decision."""
        now, before = r.scan_t, self.stage
        memory_end = None if self.last_pump is None else self.last_pump + MEMORY_HOURS * 3_600_000_000
        had = self.episode is not None
        remembered = had and memory_end is not None and now <= memory_end and before != "DUMPED"
        newer = r.direct_pump and (self.peak_t is None or r.peak_t > self.peak_t or r.peak_price > (self.peak or 0.0) + TINY)
        begin = bool(r.direct_pump and (not had or (before == "DUMPED" and newer)))
        previous = self.episode
        if begin:
            self.ref, self.ref_t, self.peak, self.peak_t = r.reference_price, r.reference_t, r.peak_price, r.peak_t
            self.last_pump, self.score = now, r.pump_score
            self.episode = f"{r.symbol}-{int(r.reference_t)}-{r.reference_price:.16g}"
        elif had and r.direct_pump and before != "DUMPED":
            if r.reference_price < self.ref:
                self.ref, self.ref_t = r.reference_price, r.reference_t
            if r.peak_price > self.peak:
                self.peak, self.peak_t = r.peak_price, r.peak_t
            self.last_pump, self.score = now, max(self.score, r.pump_score)
        elif not (remembered or (had and before == "DUMPED")):
            self.episode, self.last_pump = None, None
            self.ref, self.ref_t, self.peak, self.peak_t, self.score = r.reference_price, r.reference_t, r.peak_price, r.peak_t, r.pump_score
        for top, at in ((r.top_price, r.scan_t), (r.close, r.scan_t)):
            if top is not None and top == top and top > self.peak + TINY:
                self.peak, self.peak_t = top, at
        drawdown = max(0.0, 1.0 - r.close / self.peak)
        depth = drawdown + TINY
        stage = STAGES[sum(depth >= x for x in (EXHAUSTION, DISTRIBUTION, DUMPED))]
        if self.episode is not None and self.episode == previous and before in STAGES:
            stage = max(stage, before, key=STAGES.index)
        active = bool(r.direct_pump or remembered)
        if before == "DUMPED" and not begin:
            active, stage = False, "DUMPED"
        self.stage = stage
        groups = [g for g, on in (("price_structure", depth >= EXHAUSTION), ("order_flow", r.buy_share < 0.5),
                                  ("volume_distribution", r.red_share > 0.5)) if on]
        move = 0.7 * STAGE_SCORE[stage] + 0.3 * min(1.0, len(groups) / MIN_GROUPS)
        return {"stage": stage, "selected": active and stage != "DUMPED", "episode_id": self.episode, "pump_score": self.score,
                "transition_score": move, "rank_score": 0.7 * self.score + 0.3 * move, "peak_price": self.peak, "drawdown": drawdown,
                "evidence": "|".join(groups)}


EPISODE_OUT = ("symbol string, scan_t bigint, stage string, selected boolean, episode_id string, pump_score double, "
               "transition_score double, rank_score double, peak_price double, drawdown double, evidence string")
EPISODE_IN = ("symbol", "scan_t", "close", "direct_pump", "pump_score", "reference_price", "reference_t", "peak_price", "peak_t",
              "buy_share", "red_share", "top_price")


def episode_rows(batches: Iterator[pd.DataFrame], state: Episode) -> Iterator[pd.DataFrame]:
    """Run the episode state over time-ordered rows, one bounded batch at a time."""
    for pdf in batches:
        rows = [{"symbol": r.symbol, "scan_t": r.scan_t, **state.step(r)} for r in pdf.itertuples(index=False)]
        if rows:
            yield pd.DataFrame(rows)


EPISODE_STATE = "struct<episode: string, stage: string, ref: double, ref_t: long, peak: double, peak_t: long, last_pump: long, score: double>"
_EPISODE_NEW = ", ".join(f.replace(" ", ": ") for f in EPISODE_OUT.split(", ")[2:])


def episode_machine(state: dict | None, rows: list[dict]) -> tuple[list[dict], dict]:
    """Run the episode state over the ordered rows of a block; missing numbers are NaN for it."""
    nan = float("nan")
    e = Episode([state[f] for f in Episode.FIELDS] if state else None)
    out = [e.step(SimpleNamespace(**{k: nan if x is None and k not in ("symbol", "direct_pump") else x for k, x in r.items()})) for r in rows]
    return out, {f: None if x != x else int(x) if x is not None and f in ("ref_t", "peak_t", "last_pump") else x for f, x in zip(Episode.FIELDS, e.values())}


def episode_input(bars: DataFrame, small_bars: DataFrame) -> DataFrame:
    """One compact row per symbol and scan: all windows are done before the state machine."""
    flow = flow_evidence(small_bars).withColumn("_h", F.expr(sql_grid("close_time", 3600)))
    last = flow.groupBy("symbol", "_h").agg(F.max_by(F.struct("buy_share", "red_share", "top_price"), "close_time").alias("f")).select("symbol", "_h", "f.*")
    s = pump_signal(run_ups(bars)).withColumn("_h", F.expr(sql_grid("scan_time", 3600)))
    return s.join(last, ["symbol", "_h"], "left").withColumn("scan_t", micros("scan_time")).select(*EPISODE_IN)


def episode_scan(rows: DataFrame, carried: DataFrame | None = None, block_rows: int = 256) -> tuple[DataFrame, DataFrame, int]:
    """Episode decisions of scan rows, the states they leave, and the rounds it took.

    A symbol's rows run in blocks over many tasks. A block that starts in a quiet stretch ends the same whatever came before; one within an
    episode is run again from the state it is handed.
    """
    return speculative_scan(rows, ["symbol"], ["scan_t"], episode_machine, EPISODE_STATE, _EPISODE_NEW, carried, block_rows, keep=["symbol", "scan_t"])


def replay_episodes(rows: DataFrame, block_rows: int = 256) -> DataFrame:
    """Batch replay of the episode states of all symbols."""
    return episode_scan(rows, None, block_rows)[0]


def rank_decisions(decisions: DataFrame, cap: int) -> DataFrame:
    """Rank of selected rows per scan; rows beyond the cap lose their selection."""
    ok = F.col("selected") & ~F.col("stage").isin("DUMPED", "DATA_UNAVAILABLE")
    w = Window.partitionBy("scan_t", "_ok").orderBy(F.col("rank_score").desc(), F.upper("symbol"), "symbol")
    df = decisions.withColumn("_ok", ok).withColumn("rank", F.when(F.col("_ok"), F.row_number().over(w)))
    return df.withColumn("selected", F.coalesce(F.col("_ok") & (F.col("rank") <= cap), F.lit(False))).withColumn(
        "cap_exceeded", F.coalesce(F.col("rank") > cap, F.lit(False))).drop("_ok")


def decision_buckets(decisions: DataFrame, minutes: int = 60) -> DataFrame:
    """First decision per (version, symbol, bucket)."""
    from tidemark.operators.ordered import first_per_key
    b = decisions.withColumn("bucket", F.expr(f"timestamp_micros({sql_grid('observed_at', minutes * 60)} * {minutes * 60_000_000}L)"))
    return first_per_key(b, ["filter_version", "symbol", "bucket"], ["observed_at"])


def episode_ids(buckets: DataFrame, minutes: int = 60, span: int = 30 * DAY) -> DataFrame:
    """Episode of each selected bucket: continued from the previous bucket when that was selected and close.

    Links are found with one halo row per slice; the start of each run is
    carried between slices.
    """
    from tidemark.operators.ordered import running_last
    keys = ["filter_version", "symbol"]
    pos = row_blocks(with_position(buckets, keys, ["bucket"], "bucket", span), "_pos", 8192, before=1)
    w = f"OVER (PARTITION BY filter_version, symbol, {SLICE} ORDER BY _pos)"
    link = (f"coalesce(lag(selected) {w} AND {sql_micros('bucket')} - {sql_micros(f'lag(bucket) {w}')} <= {2 * minutes * 60_000_000}L, false)")
    flagged = pos.selectExpr("*", f"CASE WHEN selected AND NOT ({link}) THEN bucket END AS _begin").where(OWN).drop(SLICE, OWN, "_pos")
    out = running_last(flagged, keys, "bucket", ["bucket"], F.col("_begin"), "_start", span)
    text = F.concat_ws("|", F.lit("episode"), "filter_version", "symbol", F.date_format("_start", "yyyy-MM-dd'T'HH:mm:ss"))
    return out.withColumn("episode_id", F.when(F.col("selected"), F.substring(F.sha2(text, 256), 1, 32))).drop("_begin", "_start")


def truth_events(anchors: DataFrame, gap_minutes: int = 240) -> DataFrame:
    """Collapse positive anchors whose target times are close into one event each."""
    from tidemark.operators.ordered import sessionize
    times = anchors.select("symbol", "target_time").where("target_time IS NOT NULL").distinct()
    s = sessionize(times, ["symbol"], "target_time", gap_minutes * 60, "event_target")
    s = s.withColumn("truth_event", F.concat_ws("_", "symbol", F.expr(sql_grid("event_target", 1)).cast("string")))
    return anchors.join(s, ["symbol", "target_time"])


def paired_audit(universe: DataFrame, observations: DataFrame, pumps: DataFrame, production: DataFrame, second: DataFrame, *,
                 fallback_all: bool = False) -> DataFrame:
    """Two decisions per universe symbol on one observed price; symbols without a price are marked unavailable.

    ``pumps``: symbol, rank, pump_pct, peak_price; ``production``: symbol, rank,
    selected; ``second``: symbol, selected, stage, rank, rank_score.
    """
    up = lambda df: df.withColumn("symbol", F.upper(F.trim("symbol")))
    u = (up(universe).alias("u").join(up(observations).selectExpr("symbol", "observed_at", "close"), "symbol", "left")
         .join(up(pumps).selectExpr("symbol", "rank AS p_rank", "pump_pct", "peak_price"), "symbol", "left")
         .join(up(production).selectExpr("symbol", "rank AS m_rank", "selected AS m_selected"), "symbol", "left")
         .join(up(second).selectExpr("symbol", "selected AS c_selected", "stage AS c_stage", "rank AS c_rank", "rank_score AS c_score"), "symbol", "left"))
    fb = "true" if fallback_all else "false"
    u = with_exprs(u, available="coalesce(close > 0, false)", v1=f"CASE WHEN pump_pct IS NOT NULL THEN 'PUMP_CANDIDATE' WHEN {fb} AND m_rank IS NOT NULL "
                   "THEN 'FALLBACK' ELSE 'REJECTED' END")
    return u.selectExpr("symbol", "available", "observed_at", "close", """inline(array(
        named_struct('arm', 'champion', 'stage', v1, 'selected', CASE v1 WHEN 'PUMP_CANDIDATE' THEN true WHEN 'FALLBACK' THEN coalesce(m_selected, false) ELSE false END,
          'rank', CASE v1 WHEN 'PUMP_CANDIDATE' THEN p_rank WHEN 'FALLBACK' THEN CASE WHEN m_selected THEN m_rank END END, 'rank_score', pump_pct,
          'drawdown', CASE WHEN peak_price > 0 THEN greatest(0D, 1D - close / peak_price) END,
          'reason', CASE v1 WHEN 'PUMP_CANDIDATE' THEN 'daily_pump_threshold_met' WHEN 'FALLBACK' THEN 'fallback_all_no_champion_candidates'
            ELSE CASE WHEN m_rank IS NOT NULL THEN 'pump_filter_rejected' ELSE 'initial_universe_gate_rejected' END END),
        named_struct('arm', 'challenger', 'stage', coalesce(c_stage, 'DATA_UNAVAILABLE'), 'selected', coalesce(c_selected, false), 'rank', c_rank,
          'rank_score', c_score, 'drawdown', CAST(NULL AS DOUBLE), 'reason', CASE WHEN c_stage IS NULL THEN 'challenger_decision_missing' ELSE 'evaluated' END)))""")

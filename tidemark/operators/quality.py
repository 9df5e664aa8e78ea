"""Row rules, severity merge and timeline quality."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp, flag_list, micros, sql_grid, with_exprs

# Severity order of the quality states (warning ranks above quarantined).
SEVERITY = {"valid": 0, "quarantined": 1, "warning": 2, "invalid": 3}

# Optional inputs whose absence lowers the timeline score.
OPTIONAL_INPUTS = (
    "open_interest_contracts", "buy_volume", "sell_volume", "global_long_short_ratio",
    "top_long_short_ratio", "top_long_short_position_ratio", "funding_rate_last_known",
)


def severity(status: Column) -> Column:
    table = F.create_map(*[x for k, v in SEVERITY.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, status), F.lit(0))


def status_of(rank: Column) -> Column:
    names = sorted(SEVERITY, key=SEVERITY.get)
    return F.element_at(F.array(*[F.lit(n) for n in names]), rank.cast("int") + 1)


def apply_rules(df: DataFrame, rules: list[tuple[Column, str, str]]) -> DataFrame:
    """Raise ``quality_status`` to the worst matching rule and add its flags once."""
    ranks = [severity(F.col("quality_status"))]
    ranks += [F.when(cond, F.lit(SEVERITY[state])).otherwise(F.lit(0)) for cond, state, _ in rules]
    flags = flag_list(*[(cond, name) for cond, _, name in rules])
    return df.withColumns({
        "quality_flags": F.array_distinct(F.concat(F.coalesce("quality_flags", F.array().cast("array<string>")), flags)),
        "quality_status": status_of(F.greatest(*ranks)),
    })


def assess_bars(df: DataFrame) -> DataFrame:
    c = F.col
    return apply_rules(df, [
        ((c("volume_base") < 0) | (c("volume_quote") < 0), "invalid", "negative_volume"),
        ((c("high") < c("open")) | (c("high") < c("close")) | (c("high") < c("low")), "invalid", "invalid_high_price"),
        ((c("low") > c("open")) | (c("low") > c("close")) | (c("low") > c("high")), "invalid", "invalid_low_price"),
        (c("trade_count") < 0, "invalid", "negative_trade_count"),
    ])


def assess_funding(df: DataFrame) -> DataFrame:
    return apply_rules(df, [
        (F.abs("funding_rate") > 0.1, "warning", "extreme_funding_rate"),
        (F.col("mark_price") <= 0, "invalid", "invalid_mark_price"),
    ])


def assess_open_interest(df: DataFrame) -> DataFrame:
    return apply_rules(df, [
        (F.col("open_interest_contracts") < 0, "invalid", "negative_open_interest"),
        (F.col("open_interest_value") < 0, "invalid", "negative_open_interest_value"),
    ])


def assess_taker(df: DataFrame) -> DataFrame:
    return apply_rules(df, [
        ((F.col("buy_volume") < 0) | (F.col("sell_volume") < 0), "invalid", "negative_taker_volume"),
        (F.col("buy_sell_ratio") <= 0, "invalid", "invalid_buy_sell_ratio"),
    ])


def assess_ratio(df: DataFrame, what: str = "account") -> DataFrame:
    """Rules of the account ratios, or with ``what='position'`` of the position ratio."""
    return apply_rules(df, [
        (F.col(f"long_{what}") < 0, "invalid", f"negative_long_{what}"),
        (F.col(f"short_{what}") < 0, "invalid", f"negative_short_{what}"),
        (F.col("long_short_ratio") <= 0, "invalid", "invalid_long_short_ratio"),
    ])


def timeline_quality(df: DataFrame, max_age_minutes: float = 10.0) -> DataFrame:
    """Score each timeline row; columns that a source lacks are simply not judged."""
    has = set(df.columns)
    source = "lower(CAST(quality_status AS STRING))" if "quality_status" in has else "'valid'"
    missing = " + ".join(["0"] + [f"CAST({o} IS NULL AS INT)" for o in OPTIONAL_INPUTS if o in has])
    required = " OR ".join(["false"] + [f"{n} IS NULL" for n in ("symbol", "feature_time", "close") if n in has])
    age, known = "0D", "false"
    if "feature_available_time" in has:
        decision = "decision_time" if "decision_time" in has else "feature_time"
        age = f"({sql_grid(decision, 1)} - {sql_grid('feature_available_time', 1)}) / 60D"
        known = "feature_available_time IS NOT NULL"
    df = with_exprs(df, _src=source, _miss=missing, _req=required, _age=age)
    df = with_exprs(df, _bad=f"coalesce({known} AND (_age > {max_age_minutes} OR _age < 0), false)",
                    _fut=f"coalesce({known} AND _age < 0, false)")
    untrusted = "_src IN ('invalid', 'quarantined')"
    codes = ((untrusted, "source_invalid"), ("_req", "required_missing"), ("_miss > 0", "optional_missing"),
             ("_fut", "feature_future"), ("_bad", "stale_feature"))
    return with_exprs(
        df, data_quality_score="greatest(0D, least(1D, 1D - 0.15D * _miss - CASE WHEN _bad THEN 0.25D ELSE 0D END))",
        max_feature_age_minutes="CAST(_age AS DOUBLE)",
        quality_status=f"CASE WHEN {untrusted} OR _req OR _bad THEN 'invalid' "
                       "WHEN _src = 'warning' OR _miss > 0 THEN 'warning' ELSE 'valid' END",
        quality_reason_codes="concat_ws('|', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in codes) + ")",
    ).drop("_src", "_miss", "_req", "_age", "_bad", "_fut")


def snapshot_gate(df: DataFrame, required: list[str], as_of: Column, *, min_score: float = 0.8,
                  max_age_minutes: float | None = 15.0) -> DataFrame:
    """Decide for latest rows whether they may be scored, with the reasons."""
    status = F.coalesce(F.lower(F.col("quality_status").cast("string")), F.lit("unknown"))
    score = clamp(F.coalesce(F.col("data_quality_score").cast("double"),
                             F.when(status == "valid", 1.0).otherwise(0.75)), 0.0, 1.0)
    age = (micros(as_of) - micros("feature_time")) / F.lit(60e6)
    absent = F.lit(False)
    for name in required:
        absent = absent | F.col(name).isNull()
    rejected = status.isin("invalid", "quarantined", "failed", "fail")
    stale = F.lit(False) if max_age_minutes is None else age > max_age_minutes
    reasons = F.array_compact(F.array(
        F.when(absent, F.lit("missing_required_features")),
        F.when(rejected, F.concat(F.lit("quality_status_"), status)),
        F.when(~rejected & ~status.isin("valid", "warning"), F.lit("quality_status_unknown")),
        F.when(score < min_score, F.lit("quality_score_below_threshold")),
        F.when(F.col("feature_time").isNull(), F.lit("feature_time_missing")),
        F.when(age < -1, F.lit("feature_time_in_future")),
        F.when(~(age < -1) & stale, F.lit("feature_stale"))))
    return df.withColumns({"gate_score": score, "snapshot_age_minutes": age, "gate_reasons": reasons,
                           "usable": F.size(reasons) == 0})

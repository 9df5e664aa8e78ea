"""Rule scores as column expressions over a whole feature table."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp, flag_list, stable_id

# Component weights of the composite score and its limits.
WEIGHTS = {
    "price_volume_divergence": 0.20, "funding_spike": 0.15, "momentum_exhaustion": 0.15,
    "distance_from_high": 0.10, "taker_sell_pressure": 0.10, "oi_divergence": 0.10,
    "btc_context": 0.15, "fake_breakout": 0.05,
}
ALERT_THRESHOLD, FOMO_RETURN, WEAK_RETURN = 40.0, 0.05, -0.02

# Evidence groups and the components that support them.
EVIDENCE = {
    "price_weakening": ("price_volume_divergence", "momentum_exhaustion", "distance_from_high"),
    "derivs_abnormality": ("funding_spike", "oi_divergence", "global_long_short_ratio",
                           "top_long_short_account_ratio", "top_long_short_position_ratio"),
    "sell_pressure": ("taker_sell_pressure", "fake_breakout"),
}


def _score(x: Column) -> Column:
    return clamp(x, 0.0, 100.0)


def _or(name: str, default: float) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default))


def price_volume(ret: Column, volume_rank: Column) -> Column:
    size = F.least(F.lit(1.0), ret / 0.5)
    return F.when(ret <= 0, 0.0).otherwise(_score(90.0 * (1.0 - volume_rank) * size))


def funding_spike(z: Column) -> Column:
    return F.when(z <= 0, 0.0).otherwise(_score(30.0 * z))


def momentum(decel: Column, ret_4h: Column) -> Column:
    return (F.when(ret_4h <= 0, 0.0).when(decel >= 0, 10.0)
            .otherwise(_score(40.0 + 600.0 * F.abs(decel))))


def distance_high(d: Column) -> Column:
    return F.when(d >= 0, 100.0).otherwise(_score(100.0 + 300.0 * d))


def taker_pressure(ratio: Column, change: Column) -> Column:
    base = _score(50.0 + (0.55 - ratio) * 400.0)
    return F.when(ratio >= 0.55, 10.0).when(change < 0, _score(base + 10.0)).otherwise(base)


def oi_divergence(ret: Column, oi: Column) -> Column:
    return F.when(ret <= 0, 0.0).when(oi >= 0, 15.0).otherwise(_score(50.0 + 250.0 * F.abs(oi)))


def fake_breakout(x: Column) -> Column:
    return F.when(x <= 0, 0.0).otherwise(_score(100.0 * x))


def benchmark_regime(ret: Column) -> Column:
    return F.when(ret >= FOMO_RETURN, "FOMO").when(ret <= WEAK_RETURN, "WEAK").otherwise("NEUTRAL")


def benchmark_score(ret: Column) -> Column:
    fomo = F.greatest(F.lit(0.0), 20.0 - (ret - FOMO_RETURN) * 200.0)
    weak = F.least(F.lit(100.0), 70.0 + (F.lit(WEAK_RETURN) - ret) * 800.0)
    flat = clamp(50.0 - ret * 6.0, 20.0, 70.0)
    return F.when(ret >= FOMO_RETURN, fomo).when(ret <= WEAK_RETURN, weak).otherwise(flat)


def component_scores(benchmark_ret: Column) -> dict[str, Column]:
    """Raw value and score per component; rule scorers use neutral defaults for NULLs."""
    ret = _or("price_ret_24h", 0.0)
    return {
        "price_volume_divergence": price_volume(ret, _or("volume_percentile_24h", 0.5)),
        "funding_spike": funding_spike(_or("funding_zscore_30d", 0.0)),
        "momentum_exhaustion": momentum(_or("momentum_deceleration_4h", 0.0), _or("price_ret_4h", 0.0)),
        "distance_from_high": distance_high(_or("distance_from_high_24h", 0.0)),
        "taker_sell_pressure": taker_pressure(_or("taker_buy_ratio", 0.5), _or("taker_buy_ratio_change_1h", 0.0)),
        "oi_divergence": oi_divergence(ret, _or("oi_change_24h", 0.0)),
        "btc_context": benchmark_score(benchmark_ret),
        "fake_breakout": fake_breakout(_or("fake_breakout_1h", 0.0)),
    }


def composite(df: DataFrame, benchmark_ret: Column, threshold: float = ALERT_THRESHOLD,
              weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """Weighted score 0-100, its recommendation and the component array."""
    df = df.withColumns({f"_c_{n}": c for n, c in component_scores(benchmark_ret).items()})
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_c_{n}").alias("score"), F.lit(w).alias("weight"),
                               (F.col(f"_c_{n}") * w).alias("weighted_score")) for n, w in weights.items()])
    total = _score(sum(F.col(f"_c_{n}") * w for n, w in weights.items()))
    return (df.withColumns({"components": parts, "total_score": total, "btc_regime": benchmark_regime(benchmark_ret)})
            .withColumn("recommendation", recommend(F.col("total_score"), threshold))
            .drop(*[f"_c_{n}" for n in weights]))


def recommend(score: Column, threshold: float = ALERT_THRESHOLD) -> Column:
    return (F.when(score >= threshold, "SHORT_CANDIDATE").when(score >= threshold - 20, "WATCH")
            .otherwise("WAIT"))


def pump_magnitude(size: Column) -> Column:
    return _score(F.when(size <= 0.10, 0.0).when(size <= 0.30, 30.0 + (size - 0.10) / 0.20 * 30.0)
                  .when(size <= 0.80, 60.0 + (size - 0.30) / 0.50 * 30.0)
                  .otherwise(95.0 + F.least(F.lit(5.0), (size - 0.80) * 5.0)))


def two_tier(df: DataFrame, benchmark_ret: Column, pump: Column | None = None) -> DataFrame:
    """Slow context score, fast trigger score and their combination."""
    def falsy(name: str, default: float) -> Column:
        # a zero counts as absent here, as a missing value does
        x = F.col(name).cast("double")
        return F.when(x.isNull() | (x == 0), F.lit(default)).otherwise(x)
    ret = falsy("price_ret_24h", 0.0)
    size = F.greatest(ret, pump) if pump is not None else F.greatest(ret, F.lit(0.0))
    slow = _score((pump_magnitude(size) * 0.35 + distance_high(falsy("distance_from_high_24h", 0.0)) * 0.25
                   + price_volume(ret, falsy("volume_percentile_24h", 0.5)) * 0.25
                   + fake_breakout(falsy("fake_breakout_1h", 0.0)) * 0.15))
    fast = _score((taker_pressure(falsy("taker_buy_ratio", 0.5), falsy("taker_buy_ratio_change_1h", 0.0)) * 0.30
                   + oi_divergence(ret, falsy("oi_change_24h", 0.0)) * 0.25
                   + funding_spike(falsy("funding_zscore_30d", 0.0)) * 0.25
                   + momentum(falsy("momentum_deceleration_4h", 0.0), falsy("price_ret_4h", 0.0)) * 0.20))
    df = df.withColumns({"htf_score": slow, "ltf_score": fast, "_fomo": benchmark_regime(benchmark_ret) == "FOMO"})
    h, l = F.col("htf_score"), F.col("ltf_score")
    df = df.withColumns({"htf_state": F.when(h >= 50, "ARMED").otherwise("NORMAL"),
                         "ltf_state": F.when(l >= 48, "FIRED").when(l >= 30, "WATCH").otherwise("STANDBY")})
    armed, fired = F.col("htf_state") == "ARMED", F.col("ltf_state") == "FIRED"
    boost = F.least(F.lit(18.0), (h - 50.0) * 0.2 + (l - 48.0) * 0.2)
    penal = lambda x, cut: F.when(F.col("_fomo"), F.greatest(F.lit(0.0), x - cut)).otherwise(x)
    mixed = _score(0.40 * h + 0.60 * l)
    total = (F.when(armed & fired, penal(_score(0.40 * h + 0.60 * l + boost), 15.0))
             .when(armed, penal(_score(0.65 * h + 0.35 * l), 10.0)).otherwise(mixed))
    df = df.withColumn("tier_score", total)
    t = F.col("tier_score")
    return df.withColumns({
        "tier_recommendation": F.when(armed & fired, F.when(t >= 55, "SHORT_CANDIDATE").otherwise("WATCH"))
                                .when(armed, "WATCH").otherwise(F.when(t < 40, "WAIT").otherwise("WATCH")),
        "tier_probability": clamp(1.0 / (1.0 + F.exp(-0.075 * (t - 48.0))), 0.01, 0.99),
    }).drop("_fomo")


def evidence(df: DataFrame, components: str = "components", *, min_groups: int = 2, min_score: float = 50.0,
             usable: Column | None = None) -> DataFrame:
    """Independent evidence groups with a strong component, and whether they suffice."""
    usable = F.lit(True) if usable is None else usable
    strong = lambda names: F.exists(components, lambda c: c["name"].isin(*names) & (c["score"] >= min_score))
    df = df.withColumn("evidence_groups", flag_list(*[(strong(names), g) for g, names in EVIDENCE.items()]))
    n = F.size("evidence_groups")
    return df.withColumns({
        "evidence_count": n, "evidence_passed": usable & (n >= min_groups),
        "evidence_reasons": flag_list((~usable, "quality_gate_failed"),
                                      (n < min_groups, "insufficient_independent_evidence"))})


def risk_tier(probability: Column, passed: Column, usable: Column, high: float, watch: float) -> Column:
    ok = usable & probability.isNotNull()
    return (F.when(ok & (probability >= high) & passed, "HIGH_CONFIDENCE")
            .when(ok & (probability >= F.lit(min(high, watch))) & ((probability >= high) | (probability >= watch)),
                  "WATCH").otherwise("WAIT"))


def risk_bucket(percent: Column) -> Column:
    return F.when(percent >= 85, "CRITICAL").when(percent >= 70, "HIGH").when(percent >= 50, "MEDIUM").otherwise("SAFE")


def threshold_level(p: Column, threshold: Column) -> Column:
    """Four levels around a trained threshold."""
    return (F.when(p >= threshold * 1.5, "VERY_HIGH").when(p >= threshold, "HIGH")
            .when(p >= threshold * 0.5, "LOW").otherwise("VERY_LOW"))


def top_components(k: int, components: str = "components") -> Column:
    """Names of the k largest weighted components, larger first, ties in given order."""
    indexed = F.transform(components, lambda c, i: F.struct((-c["weighted_score"]).alias("w"), i.alias("i"),
                                                            c["name"].alias("name")))
    return F.transform(F.slice(F.array_sort(indexed), 1, k), lambda c: c["name"])


def position_metrics(price: Column, entry: Column, side: Column, quantity: Column, notional: Column,
                     leverage: Column) -> dict[str, Column]:
    """Signed change, profit and return on margin of a linear position."""
    side = F.upper(F.coalesce(side, F.lit("")))
    valid = (entry > 0) & (price >= 0) & side.isin("LONG", "SHORT")
    sign = F.when(side == "LONG", 1.0).otherwise(-1.0)
    change = F.when(valid, sign * (price - entry) / entry)
    lev = F.when(leverage.isNull() | (leverage == 0), 1.0).otherwise(leverage)
    pnl = F.when(notional > 0, F.round(change * notional, 8)).when(
        valid & (quantity > 0), F.round((price - entry) * quantity * sign, 8))
    return {"position_change_pct": F.round(change * 100.0, 2), "position_roi_pct": F.round(change * 100.0 * lev, 2),
            "position_pnl": pnl}


def alert_policy(df: DataFrame, *, mode: str = "canary", global_limit: int = 15, coin_limit: int = 2,
                 kill_switch: bool = False, bundle_valid: bool = True, shadow_sends: bool = False,
                 min_probability: float | None = None, allowed_tiers: Sequence[str] | None = None,
                 shadow_cooldown: bool = False) -> DataFrame:
    """First reason that denies an alert, or the pass reason.

    Needs ``tier``, ``quality_status``, ``probability``, ``threshold``,
    ``in_cooldown``, ``global_count`` and ``coin_count``.
    """
    tier, p = F.upper("tier"), F.col("probability")
    missing = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    rules: list[tuple[Column, str]] = []
    add = lambda cond, reason: rules.append((cond, reason))
    add(F.lit(mode == "research" or (mode == "shadow" and not shadow_sends)), "mode_no_action_alerts")
    add(F.lit(kill_switch), "kill_switch_active")
    add(F.lit(not bundle_valid), "bundle_contract_invalid")
    if min_probability is not None:
        add(missing, "telegram_probability_missing")
        add(p <= min_probability, "telegram_probability_below_threshold")
    if allowed_tiers is not None:
        add(~tier.isin(*[t.upper() for t in allowed_tiers]), "tier_not_allowed")
    passed = "policy_pass"
    if mode == "shadow":
        if shadow_cooldown:
            add(F.col("in_cooldown"), "cooldown_active")
        passed = "shadow_observation"
    else:
        add(F.lower("quality_status") != "valid", "data_quality_invalid")
        add(tier != "HIGH_CONFIDENCE", "tier_not_high_confidence")
        add(missing, "calibrated_probability_missing")
        add(F.col("threshold").isNull() | (p < F.col("threshold")), "probability_below_threshold")
        add(F.col("in_cooldown"), "cooldown_active")
        add(F.col("global_count") >= global_limit, "global_daily_budget_exhausted")
        add(F.col("coin_count") >= coin_limit, "coin_daily_budget_exhausted")
    reason = F.coalesce(*[F.when(c, F.lit(r)) for c, r in rules], F.lit(passed))
    return df.withColumn("policy_reason", reason).withColumn("alert_allowed", F.col("policy_reason") == passed)


def audit_trace(df: DataFrame, model_id: str, horizon_hours: int = 24, bundle: str = "bundle-1") -> DataFrame:
    """Serving audit columns: stable id, state, expiry and bundle hash."""
    stamp = F.date_format("feature_time", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return df.withColumns({
        "prediction_id": stable_id(F.col("symbol"), stamp, F.lit(horizon_hours).cast("string"), F.lit(model_id)),
        "state": F.when(F.col("recommendation") == "WAIT", "observed").otherwise("candidate"),
        "invalidation_time": F.col("feature_time") + F.make_interval(hours=F.lit(horizon_hours)),
        "bundle_checksum": F.sha2(F.lit(bundle), 256)})

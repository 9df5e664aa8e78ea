"""Training, calibration, frozen models and champion/challenger checks on Spark ML."""
from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.operators.quantiles import exact_percentiles

# Columns with these prefixes are answers, never inputs.
FORBIDDEN = ("label_", "target_", "is_distribution")
# Inputs a secondary model may use; path results such as excursions are not among them.
META_INPUTS = ("primary_probability", "regime_code", "volatility", "side")

# Groups of inputs that the ablation switches off, and its variants.
ABLATION_GROUPS = {
    "price": ("price_ret_5m", "price_ret_1h", "price_ret_4h", "price_ret_24h", "price_volatility_24h", "distance_from_high_24h",
              "momentum_deceleration_4h", "fake_breakout_1h"),
    "volume": ("volume_percentile_24h",), "funding": ("funding_rate_raw", "funding_zscore_30d"),
    "oi": ("oi_change_1h", "oi_change_4h", "oi_change_24h"), "taker": ("taker_buy_ratio", "taker_buy_ratio_change_1h"),
    "ratios": ("global_ls_ratio", "top_ls_ratio"),
}
ABLATION = {"full": (), "price_only": ("volume", "funding", "oi", "taker", "ratios"), "price_volume": ("funding", "oi", "taker", "ratios"),
            "price_derivs": ("volume",), "no_funding": ("funding",), "no_oi": ("oi",), "no_taker": ("taker",), "no_ratios": ("ratios",)}


def forbidden_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c.startswith(FORBIDDEN)]


def dropped_inputs(variant: str) -> list[str]:
    return [c for g in ABLATION[variant] for c in ABLATION_GROUPS[g]]


def ablate(df: DataFrame, variants: Sequence[str] = tuple(ABLATION)) -> DataFrame:
    """One copy of the rows per variant with the inputs of its dropped groups as NULL.

    A single projection makes all copies, so the input is computed once.
    """
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    inputs = [c for g in ABLATION_GROUPS.values() for c in g if c in types]
    gone = {c: [v for v in variants if c in dropped_inputs(v)] for c in inputs}
    df = df.selectExpr("*", f"explode(array({', '.join(repr(v) for v in variants)})) AS variant")
    swaps = [f"CASE WHEN variant NOT IN ({', '.join(repr(v) for v in gone[c])}) THEN {c} END AS {c}" for c in inputs if gone[c]]
    return df.selectExpr(f"* EXCEPT ({', '.join(c for c in inputs if gone[c])})", *swaps)


def null_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of NULLs per column from one aggregate row."""
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.selectExpr(f"stack({len(columns)}, {', '.join(f'{c!r}, {c}' for c in columns)}) AS (column_name, null_share)")


def usable_columns(df: DataFrame, columns: Sequence[str], max_share: float = 0.5) -> list[str]:
    """Columns that are filled often enough; reads one aggregate row."""
    row = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] <= max_share]


def train_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, bool]]:
    """Exact median per column and whether it had NULLs, from one long-form job."""
    pairs = ", ".join(f"{c!r}, CAST({c} AS DOUBLE)" for c in columns)
    long = df.selectExpr(f"stack({len(columns)}, {pairs}) AS (name, x)")
    med = exact_percentiles(long, ["name"], F.col("x"), {"median": 0.5})
    nulls = long.groupBy("name").agg(F.count_if(F.col("x").isNull()).alias("n_null"))
    # one row per column
    return {r["name"]: (r["median"] if r["median"] is not None else 0.0, r["n_null"] > 0) for r in nulls.join(med, "name", "left").collect()}


def imputer_sql(columns: Sequence[str], medians: dict[str, tuple[float, bool]]) -> tuple[str, list[str]]:
    """Statement that fills medians and adds indicators for columns that had NULLs in training."""
    out, names = [], []
    for c in columns:
        value, had = medians.get(c, (0.0, False))
        out.append(f"CAST(coalesce({c}, {value!r}) AS DOUBLE) AS x_{c}")
        names.append(f"x_{c}")
        if had:
            out.append(f"CAST({c} IS NULL AS DOUBLE) AS m_{c}")
            names.append(f"m_{c}")
    return f"SELECT *, {', '.join(out)} FROM __THIS__", names


def fit_classifier(train: DataFrame, columns: Sequence[str], *, kind: str = "logistic", label: str = "label_value", weight: str | None = None,
                   c: float = 1.0, balanced: bool = False, trees: int = 20, seed: int = 42) -> PipelineModel:
    """Impute on training medians, then fit a logistic or boosted-tree model."""
    bad = forbidden_columns(columns)
    if bad:
        raise ValueError(f"answers used as inputs: {bad}")
    statement, names = imputer_sql(columns, train_medians(train, columns))
    data = train.withColumn(label, F.col(label).cast("double"))
    n, pos = data.agg(F.count(F.lit(1)), F.sum(label)).first()
    if balanced:
        w = F.when(F.col(label) == 1, n / (2.0 * max(pos or 0, 1))).otherwise(n / (2.0 * max(n - (pos or 0), 1)))
        data = data.withColumn("_w", w * (F.col(weight) if weight else 1.0))
        weight = "_w"
    stages = [SQLTransformer(statement=statement), VectorAssembler(inputCols=names, outputCol="inputs")]
    if kind == "logistic":
        est = LogisticRegression(featuresCol="inputs", labelCol=label, regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=100)
    else:
        est = GBTClassifier(featuresCol="inputs", labelCol=label, maxIter=trees, maxDepth=4, seed=seed)
    if weight:
        est = est.setWeightCol(weight)
    return Pipeline(stages=[*stages, est]).fit(data)


def fit_concurrently(parts: dict[object, DataFrame], columns: dict[object, Sequence[str]], *, at_once: int = 4, **options) -> dict[object, PipelineModel]:
    """One model per part, fitted as concurrent jobs, so that small fits share the cluster instead of queueing."""
    with ThreadPoolExecutor(at_once) as pool:
        jobs = {k: pool.submit(inheritable_thread_target(df.sparkSession)(lambda df=df, k=k: fit_classifier(df, columns[k], **options))) for k, df in parts.items()}
        return {k: j.result() for k, j in jobs.items()}


def usable_by(df: DataFrame, key: str, columns: Sequence[str], max_share: float = 0.5) -> dict[object, list[str]]:
    """Usable columns of every key from one aggregate; keys are few (horizons, folds)."""
    shares = df.groupBy(key).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).collect()
    return {r[key]: [c for c in columns if r[c] is not None and r[c] <= max_share] for r in shares}


def fit_secondary(train: DataFrame, columns: Sequence[str], **options) -> PipelineModel:
    """A secondary model over inputs that are known at entry; any other column is refused."""
    other = [c for c in columns if c not in META_INPUTS]
    if other:
        raise ValueError(f"not known at entry: {other}")
    return fit_classifier(train, columns, **options)


def score(model: PipelineModel, df: DataFrame, out: str = "probability") -> DataFrame:
    scored = model.transform(df)
    added = [c for c in scored.columns if c not in df.columns]
    return scored.withColumn(out, vector_to_array("probability")[1]).drop(*[c for c in added if c != out])


def fit_isotonic(df: DataFrame, prob: str = "probability", label: str = "label_value"):
    return IsotonicRegression(featuresCol=prob, labelCol=label).fit(df.select(F.col(prob).cast("double"), F.col(label).cast("double")))


def apply_isotonic(model, df: DataFrame, prob: str = "probability", out: str = "calibrated") -> DataFrame:
    return model.transform(df).withColumn(out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("prediction")))).drop("prediction")


def fit_platt(df: DataFrame, prob: str = "probability", label: str = "label_value") -> PipelineModel:
    data = df.withColumn(label, F.col(label).cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=[prob], outputCol="inputs"),
                            LogisticRegression(featuresCol="inputs", labelCol=label, probabilityCol="p2", rawPredictionCol="r2", predictionCol="d2")]).fit(data)


def apply_platt(model: PipelineModel, df: DataFrame, out: str = "calibrated") -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("p2")[1]).drop("inputs", "p2", "r2", "d2")


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Centre and scale by the population deviation; a constant column keeps scale 1."""
    one = df.agg(*[F.avg(c).alias(f"a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    packed = one.select(F.struct(*one.columns)).scalar()
    df = df.withColumn("_m", packed)
    return df.withColumns({c: (F.col(c) - F.col(f"_m.a_{c}")) / F.when(F.col(f"_m.s_{c}") == 0, 1.0).otherwise(F.col(f"_m.s_{c}")) for c in columns}).drop("_m")


def evaluate(scored: DataFrame, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    return metrics.row_metrics(scored, keys, threshold=threshold)


def pick_threshold(scored: DataFrame, min_recall: float = 0.5) -> float:
    grid = [(5 + i) / 100.0 for i in range(90)]
    row = metrics.best_precision_threshold(metrics.threshold_sweep(scored, [], grid), min_recall=min_recall).first()
    return float(row["threshold"]) if row else 0.5


def pick_f1_threshold(scored: DataFrame) -> float:
    grid = [(5 + i) / 100.0 for i in range(90)]
    row = metrics.best_f1_threshold(metrics.threshold_sweep(scored, [], grid)).first()
    return float(row["threshold"]) if row and row["threshold"] is not None else 0.5


def promotion_gate(champion: DataFrame, challenger: DataFrame, *, min_gain: float = 0.0, max_recall_loss: float = 0.05, max_brier_loss: float = 0.0) -> DataFrame:
    """Checks of a challenger against the champion, one row each, and whether all hold."""
    pack = lambda d: d.select(F.struct("precision", "recall", "brier_score")).scalar()
    t = champion.select(pack(champion).alias("a"), pack(challenger).alias("b"))
    t = t.selectExpr("b.precision - a.precision AS dp", "b.recall - a.recall AS dr", "b.brier_score - a.brier_score AS db")
    return t.selectExpr(f"inline(array(named_struct('check', 'precision_improvement', 'actual', dp, 'passed', dp >= {min_gain}D), "
                        f"named_struct('check', 'recall_regression', 'actual', dr, 'passed', dr >= -{max_recall_loss}D), "
                        f"named_struct('check', 'brier_regression', 'actual', db, 'passed', db <= {max_brier_loss}D)))")


# Release floors.
RELEASE = {"precision": 0.35, "ci_lower": 0.25, "event_recall": 0.20, "lead_median": 240.0, "ece": 0.05, "relative_gain": 0.20, "n_events": 50}


def release_gates(summary: DataFrame) -> DataFrame:
    """The release checks of a one-row summary, long form; a missing value never passes.

    Needs precision, pr_auc, ci_lower, event_recall, lead_median, ece, n_events,
    n_thresholds, best_pr_auc and best_precision.
    """
    r = RELEASE
    rules = {
        "pr_auc_beats_all_baselines": ("pr_auc", "pr_auc > best_pr_auc"),
        "relative_precision_improvement": ("precision / nullif(best_precision, 0) - 1", f"precision / nullif(best_precision, 0) - 1 >= {r['relative_gain']}D"),
        "precision_floor": ("precision", f"precision >= {r['precision']}D"), "precision_ci_lower_floor": ("ci_lower", f"ci_lower >= {r['ci_lower']}D"),
        "event_recall_floor": ("event_recall", f"event_recall >= {r['event_recall']}D"), "median_lead_time_floor": ("lead_median", f"lead_median >= {r['lead_median']}D"),
        "ece_ceiling": ("ece", f"ece <= {r['ece']}D"), "threshold_policy_locked": ("CAST(n_thresholds AS DOUBLE)", "n_thresholds = 1"),
        "materialized_events": ("CAST(n_events AS DOUBLE)", f"n_events >= {r['n_events']}")}
    arms = ", ".join(f"named_struct('check', '{n}', 'actual', CAST({a} AS DOUBLE), 'passed', coalesce({p}, false))" for n, (a, p) in rules.items())
    return summary.selectExpr(f"inline(array({arms}))")
